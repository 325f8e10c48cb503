"""Operator 3, quality rules by divergence from a language's usual text.

Two histograms of each document, over character classes and over the language's commonest words, are
compared with the same histograms of the language as a whole by Jensen-Shannon distance (base 2, the
square root of the divergence, so 0 to 1). A document that is too far from its language is dropped.
The references are sums over all documents of a language that pass the base rules. Short documents
have ragged histograms, so the allowed distances grow by `slack / sqrt(size)`, and texts of fewer than
50 words are failed by the base rules.

Every language has its reference, `WORDS` words each. References are collected and broadcast for at most
`LANGUAGES` languages at a time; where there are more, the languages are dealt to parts by hash and
each part's rows are judged in a pass of their own. Rows whose language is null are compared with the
sum over all languages.

Defined edge cases: a null text has no words and fails the base rules; a null language is another than
the empty one; a language none of whose documents passes the base rules has no reference, and none of its documents is kept; repeated rows give equal
rows; ties between common words go to the first by bytes; an empty table gives no rows. Only
`doc_id`, `text` and `lang` are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gleaner.llm.common import cut

LANGUAGES, WORDS = 5_000, 64
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"

# Character classes of UTF-8 bytes; continuation bytes have none.
CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t\n\r\x0b\x0c"
                  else 4 if _c in ".,;:'\"()-" else 5) if _b < 128 else 8 if _b < 192 else 6


def class_counts(data: bytes) -> np.ndarray:
    """Counts of lower, upper, digit, space, usual mark, other mark, beyond ASCII (and one spare)."""
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=CLASSES + 1)[:CLASSES].astype(float)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    many, covered, last = Counter(windows), 0, 0
    for k, w in enumerate(windows):
        if many[w] > 1:
            covered += k + 3 - max(k, last)
            last = k + 3
    return covered


def base(text: str | None) -> dict:
    """The base figures of one text, its words and its verdict by the base rules."""
    data = (text or "").encode("utf-8")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, again = len(words), repeat_words(words)
    return {"data": data, "words": words, "n_words": n, "word_chars": len(b"".join(words).decode("utf-8")),
            "n_symbols": len(data) - len(data.translate(None, b"#*$%&|<>")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": again, "base_failed": n < 50 or 100 * again > 50 * n}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def _counts(batches):
    """Per language, counts of classes and words of the texts that pass the base rules."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64())])
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}

    def rows():
        flat = [(lang, "w", k, n) for lang, c in words.items() for k, n in c.items()]
        flat += [(lang, "c", b"%d" % k, int(n)) for lang, v in classes.items() for k, n in enumerate(v)]
        words.clear()
        classes.clear()
        for at in range(0, len(flat), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*flat[at:at + 20_000]), schema)], schema=schema)

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            x = base(text)
            if x["base_failed"]:
                continue
            words.setdefault(lang, Counter()).update(x["data"].lower().split())
            classes[lang] = classes.get(lang, 0) + class_counts(x["data"])
        if sum(map(len, words.values())) > 300_000:  # bounded memory: what is counted so far goes to the shuffle
            yield from rows()
    yield from rows()


def counts_of(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): counts of words and character classes per language, over all documents that pass the base rules."""
    counts = docs.select("text", "lang").mapInArrow(_counts, "lang string, kind string, key binary, n long")
    return cut(counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))


def _commonest(counts: DataFrame, *group: str) -> DataFrame:
    """The WORDS commonest keys of each group: first of its 256 parts, so that no task meets all of a group's words."""
    ranked = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))).where(F.col("k") <= WORDS).drop("k")
    return ranked(ranked(counts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(256))), [*group, "salt"]), group)


Reference = tuple[np.ndarray, list[bytes], np.ndarray]


def _built(rows: list, total: int) -> Reference:
    classes = np.zeros(CLASSES)
    for r in rows:
        if r.kind == "c":
            classes[int(bytes(r.key))] = r.n
    words = sorted(((bytes(r.key), r.n) for r in rows if r.kind == "w"), key=lambda x: (-x[1], x[0]))
    n = np.array([x[1] for x in words], float)
    return classes, [x[0] for x in words], np.append(n, total - n.sum())


def references(counts: DataFrame) -> dict[str | None, Reference]:
    """Per language (None: all together): class counts, the commonest words, their counts with those of all other words at the end."""
    totals = {r.lang: r.n for r in counts.where("kind = 'w' and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rows: dict[str, list] = {}
    for r in _commonest(counts.where("lang is not null"), "lang", "kind").collect():
        rows.setdefault(r.lang, []).append(r)
    return {lang: _built(found, totals.get(lang, 0)) for lang, found in rows.items()}


def pooled(counts: DataFrame) -> Reference:
    """The reference over all languages."""
    total = counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    return _built(_commonest(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "kind").collect(), total)


def judge(docs: DataFrame, max_chars: float = 0.22, max_words: float = 0.40, slack_chars: float = 2.0, slack_words: float = 0.8, languages: int = LANGUAGES) -> DataFrame:
    """One row per document with its base figures, both distances and the verdict."""
    counts = counts_of(docs)
    parts = max(1, -(-counts.where("kind = 'c' and lang is not null").select("lang").distinct().count() // languages))
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    part = F.pmod(F.xxhash64("lang"), F.lit(parts))
    every = pooled(counts)
    out = None
    for k in range(parts):
        here = (docs, counts) if parts == 1 else (docs.where(part == k), counts.where(part == k))
        got = _judged(here[0], references(here[1]) | {None: every}, (max_chars, max_words, slack_chars, slack_words))
        out = got if out is None else out.unionByName(got)
    return out


def _judged(docs: DataFrame, refs: dict[str | None, Reference], bounds: tuple[float, float, float, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    max_chars, max_words, slack_chars, slack_words = bounds

    def run(batches):
        refs = {lang: (c, {w: k for k, w in enumerate(words)}, n) for lang, (c, words, n) in shared.value.items()}
        for b in batches:
            out = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                x = base(text)
                ref = refs.get(lang)
                js_c = js_w = 1.0
                if ref is not None and x["n_words"]:
                    at = ref[1]
                    own = np.zeros(len(ref[2]))
                    for w, n in Counter(x["data"].lower().split()).items():
                        own[at.get(w, -1)] += n
                    js_c, js_w = js_distance(class_counts(x["data"]), ref[0]), js_distance(own, ref[2])
                near = js_c <= max_chars + slack_chars / max(1, len(x["data"])) ** 0.5 and js_w <= max_words + slack_words / max(1, x["n_words"]) ** 0.5
                out.append((x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], near and not x["base_failed"], js_c, js_w))
            cols = list(zip(*out)) if out else [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:])], schema=schema)

    return docs.mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs)
