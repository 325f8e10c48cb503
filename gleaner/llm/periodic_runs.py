"""Operator 11, periodic runs of words by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q that holds at least `exponent` periods and `least` words and that no
neighbouring word extends. A text is cut into the factors of its Lempel-Ziv factorisation, which a suffix automaton with the
first end of each of its strings yields. Runs that touch or cross a border of factors are found by Main's algorithm: common
prefixes and suffixes around the border, for all periods at once by Z-functions, in a window whose size the two factors
bound. A run inside one factor touches neither of its ends, so it is a copy of a run of the factor's earlier occurrence.

Without its last or without its first period a run still has least - floor(least / exponent) words, so each of its words lies in a
window of so many words that stands in the text a second time, one period away. Words that no repeated window covers belong to
no run; they are taken out first, and what is left of the text is searched as one string in which unlike marks stand for the
gaps. This loses no run and spares the automaton of plain prose.

Defined edge cases: a null or blank text has no words and no runs; rows of one doc_id are judged each by its own text; a null
doc_id keeps its row; an empty table gives no rows. `repeats` passes further columns of any name through.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, map_texts, pieces

LEAST, EXPONENT = 24, 3
RUNS = "array<struct<start: long, length: long, period: long>>"


def factors(s: list[int]) -> list[tuple[int, int]]:
    """The factors of `s` as (start, earlier start): each is the longest string that starts earlier too, or one new letter (earlier start -1)."""
    go, link, length, first, last = [{}], [-1], [0], [-1], 0
    for i, c in enumerate(s):
        cur, p = len(go), last
        go.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    out, b, n = [], 0, len(s)
    while b < n:
        at, size, earlier = 0, 0, -1
        while b + size < n:
            at = go[at][s[b + size]]
            if first[at] - size >= b:  # the first occurrence of one letter more starts here
                break
            earlier = first[at] - size
            size += 1
        out.append((b, earlier))
        b += max(size, 1)
    return out


def matches(s: list[int]) -> list[int]:
    """Z-function: for each position how many letters from there on equal the beginning of `s`."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(s: list[int], b: int, width: int, end: int, periods: int, least: int, exponent: int) -> dict[tuple[int, int], int]:
    """Runs {(start, end): period} with start <= b <= end, for the letters from b - width to `end` and periods up to `periods`."""
    left, right = s[max(0, b - width):b], s[b:end]
    nl, nr = len(left), len(right)
    turned = left[::-1]
    ahead, behind = matches(right), matches(turned)
    from_left = matches(right + [-1] + left + right)  # beginnings of `right` within both
    to_right = matches(turned + [-1] + right[::-1] + turned)  # ends of `left` within both
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(periods, max(nl, nr)) + 1):
        spans = []
        if q <= nr:  # a period lies to the right
            spans.append((b - to_right[nl + 1 + nr - q], b + q + (ahead[q] if q < nr else 0)))
        if q <= nl:  # a period lies to the left
            spans.append((b - q - (behind[q] if q < nl else 0), b + from_left[nr + 1 + nl - q]))
        for x, y in spans:
            if y - x < max(least, exponent * q) or (x and s[x - 1] == s[x - 1 + q]) or (y < len(s) and s[y] == s[y - q]):
                continue
            found.setdefault((x, y), q)  # the smallest period comes first
    return found


def runs_of_string(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of `s`, letters 0 and above, by start and period."""
    parts = factors(s)
    borders = [b for b, _ in parts] + [len(s)]
    found: dict[tuple[int, int], int] = {}
    for k in range(1, len(borders)):
        b, end = borders[k], borders[k + 1] if k + 1 < len(borders) else len(s)
        before = b - borders[k - 1]
        both = before + end - b
        # Such a run starts less than a period before the factor ahead of the border, or that factor would reach further.
        if exponent * both <= (exponent - 1) * least:
            continue
        periods = both // (exponent - 1) + 1
        found.update(at_border(s, b, before + periods, end, periods, least, exponent))
    runs = sorted((x, y, q) for (x, y), q in found.items())
    for k, (b, earlier) in enumerate(parts):
        size = borders[k + 1] - b
        if size <= least:
            continue
        i = bisect_right(runs, (earlier, len(s) + 1, 0))
        while i < len(runs) and runs[i][0] < earlier + size:  # copies come behind i, and are copied in their turn
            x, y, q = runs[i]
            if y < earlier + size:
                insort(runs, (x + b - earlier, y + b - earlier, q))
            i += 1
    return runs


def word_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start and period."""
    n, k = len(words), least - least // exponent
    if n < least:
        return []
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    windows = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + (ids[j:n - k + 1 + j].astype(np.uint64) + np.uint64(1))
    _, of, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[of] > 1)  # equal hashes of unlike windows only keep more
    if not len(again):
        return []
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + k, -1)
    inside = np.concatenate([[False], np.cumsum(covered)[:n] > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    string: list[int] = []
    origin: list[int] = []
    for mark, (x, y) in enumerate(zip(edge[::2].tolist(), edge[1::2].tolist())):
        if y - x >= least:
            string += ids[x:y].tolist() + [n + mark]
            origin += list(range(x, y)) + [y]
    return [(origin[x], y - x, q) for x, y, q in runs_of_string(string, least, exponent)]


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d]


def repeats(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """`docs` with the runs of each text (numbers of words, by start and period) as `runs`, and its words without repeated periods, joined by one space, as `collapsed`."""
    def rows(texts):
        runs, collapsed = [], []
        for t in texts:
            words = (t or "").encode("utf-8").split()  # bytes: split() knows ASCII white space only
            found = word_runs(words, least, exponent)
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
            collapsed.append(b" ".join(without_repeats(words, found) if found else words).decode("utf-8"))
        return {r_: runs, c_: collapsed}

    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    r_, c_ = fresh(docs.columns, "runs", "collapsed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in others]).schema.fields)
    found = map_texts(docs, others, "text", f"{schema}, {r_} {RUNS}, {c_} string", rows)
    return found.withColumnsRenamed({r_: "runs", c_: "collapsed"})


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each text, joined by one space; where a tenth of the ids' checksums say so, the words from one on repeat with a period."""
    from zlib import crc32

    def run(batches):
        for b in (p for x in batches for p in pieces([x])):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (t or "").encode("utf-8").split()
                h, n = crc32(str(i).encode()) if i is not None else 1, len(words)
                if h % 10 == 0 and n:
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = words[:a] + [words[a + k % p] for k in range(n - a)]
                out.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def query(docs: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    beats = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(beats(r, best), r).otherwise(best))
    found = repeats(planted(docs)).select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
