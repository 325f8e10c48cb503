"""Operator 13, spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so a letter that is added, removed or exchanged changes the key by one
letter's value or by the difference of two. Words are joined on what their keys have in common: each word lays down its own
key and its key less the value of each of its letters. A longer word meets a shorter one at the shorter one's key, and two words
with one letter exchanged meet at the key of the letters they share, so a word needs one row per different letter
and none per letter of the alphabet. Keys that one word alone lays down are dropped.

Among words that meet, the order of letters decides: a word whose key is less one letter stands for the strings that are left
when that letter is taken out, and words are near if such strings are equal and, for an exchange, the letter stood at one place.
These strings, with the key, are what rows are grouped by, so a key that many anagrams share is split, and
a group is bounded by alphabet times length. Near words are counted within the group; no pair is written.

A word's form is its commonest near word if that is at least `factor` times as common; forms are followed to their roots by
pointer doubling, in about log log n rounds, as each step multiplies the count.

Defined edge cases: a null text has no words; a null doc_id is written as nothing before the colon; rows of one doc_id count one by one;
an empty table gives no rows. Words above LONG letters travel as digests of 256 bits and are put back at the end. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, fresh, lean, pieces

RUN, GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LETTERS, TIMES, FACTOR = 5, 3, 2
CHUNK, HELD, LONG, SHARD_ROWS = 1 << 20, 200_000, 200, 200_000


def worn(doc_id: int | None, run: str) -> str:
    """`run` without one letter where its checksum with the document's id says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 97 else (at := h % len(run), run[:at] + run[at + 1:])[1]


def word_counts(docs: DataFrame, edit: Callable[[int | None, str], str] | None = None, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n) of the words of all texts with at least `letters` letters and `times` occurrences, A-Z lower-cased, after `edit` by document."""
    def run(batches):
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in pieces(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t, at = t.as_py() or "", 0
                while at < len(t):
                    stop = GAP.search(t, at + CHUNK)
                    end = stop.start() if stop else len(t)
                    for w, n in Counter(RUN.findall(t, at, end)).items():
                        w = w.lower() if w.isascii() else w.translate(SMALL)
                        if edit is not None:
                            w = edit(i, w)
                        if len(w) >= letters:
                            held[w] = held.get(w, 0) + n
                    at = end
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def value(letter: str) -> int:
    return ord(letter) ** 5


def _signed(key: int) -> int:
    key &= (1 << 64) - 1
    return key - (1 << 64) if key >> 63 else key


def _keys(batches):
    """(key, letter, word, n): a word at its own key (letter null) and at its key less each letter."""
    for b in pieces(batches):
        for at in range(0, b.num_rows, 2000):
            rows: list[tuple] = []
            for w, n in zip(b.column(0).slice(at, 2000).to_pylist(), b.column(1).slice(at, 2000).to_pylist()):
                key = sum(map(value, w))
                rows.append((_signed(key), None, w, n))
                rows += [(_signed(key - value(c)), c, w, n) for c in set(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["key", "letter", "word", "n"])


def named(text: str) -> str:
    """The text, or if it is long a digest that no text equals."""
    return text if len(text) <= LONG else "#" + hashlib.sha256(text.encode("utf-8")).hexdigest()


def _strings(batches):
    """(key, rest, lo, hi, name, n): what is left of a word without one letter, and the places at which that letter may have stood; lo is -1 for the word itself."""
    def table(rows):
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["key", "rest", "lo", "hi", "name", "n"])

    for b in pieces(batches):
        rows: list[tuple] = []
        for key, c, w, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            if c is None:
                rows.append((key, named(w), -1, -1, named(w), n))
            else:
                name, at = named(w), w.find(c)
                while at >= 0:
                    end = at
                    while w[end:end + 1] == c:
                        end += 1
                    rows.append((key, named(w[:at] + w[at + 1:]), at, end - 1, name, n))
                    at = w.find(c, end)
            if len(rows) >= 4000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)


def _near(group: pa.Table) -> pa.Table:
    """(name, near, m, best): how many near words a word meets here, and the commonest of them; ties between words of which one is a digest are all returned."""
    sets: dict[tuple, list[tuple]] = {}
    for key, rest, lo, hi, name, n in zip(*(group.column(c).to_pylist() for c in ("key", "rest", "lo", "hi", "name", "n"))):
        sets.setdefault((key, rest), []).append((-n, name, lo, hi))
    out: list[tuple] = []

    def told(name, near):
        """near: [(-n, name)], commonest first and by name."""
        ties = [y for m, y in near if m == near[0][0]]
        out.extend((name, len(near) if k == 0 else 0, -near[0][0], y) for k, y in enumerate(ties if any(y[0] == "#" for y in ties) else ties[:1]))

    for some in sets.values():
        if len(some) < 2:
            continue
        some.sort()
        own = [x for x in some if x[2] < 0]
        longer = [x for x in some if x[2] >= 0]
        if own and longer:
            told(own[0][1], [x[:2] for x in longer])
        for x in longer:
            near = [y[:2] for y in longer if y[2] <= x[3] and y[3] >= x[2] and y is not x]
            if own:
                near = sorted(near + [own[0][:2]])
            if near:
                told(x[1], near)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 4, kinds)], names=["name", "near", "m", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word that forms lead to."""
    state = cut(forms.select("word", F.col("form").alias("up")))
    while True:
        above = state.select(F.col("word").alias("up"), F.col("up").alias("top"))
        state = cut(state.join(above, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", F.col("up").alias("root"))
        state = state.select("word", "up")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = cut(words.select("word", "n"))
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shard, = fresh(["key", "rest"], "shard")
    keys = words.mapInArrow(_keys, "key long, letter string, word string, n long")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    met = keys.join(shared, "key", "left_semi").select("key", "letter", "word", "n")
    rows = met.mapInArrow(_strings, "key long, rest string, lo int, hi int, name string, n long")
    rows = rows.withColumn(shard, F.pmod(F.xxhash64("key", "rest"), F.lit(max(64, letters // SHARD_ROWS))))
    found = cut(rows.groupBy(shard).applyInArrow(lean(_near), "name string, near long, m long, best string"))

    name = F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    digests = words.where(F.length("word") > LONG).select(name.alias("best"), F.col("word").alias("whole"))
    is_digest = F.startswith("best", F.lit("#"))
    whole = found.where(~is_digest).unionByName(found.where(is_digest).join(digests, "best").select("name", "near", "m", F.col("whole").alias("best")))
    near = whole.groupBy("name").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "best")).alias("first"))
    taken = words.withColumn("name", name).join(near, "name", "left")
    common = -F.col("first.m") >= factor * F.col("n")
    taken = cut(taken.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("first.best")).alias("form"), F.when(common, -F.col("first.m")).alias("form_n")))
    led = roots(taken.where("form is not null"))
    return taken.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs, worn))
