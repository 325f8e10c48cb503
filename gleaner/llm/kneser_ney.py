"""Operator 1, quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is an interpolated 5-gram model over 32 classes of characters (26 of letters, white space,
digits, usual marks, other marks, the rest), trained on every trusted document. Latin letters have a class each,
without case and accents; letters of other scripts are dealt to the same 26 classes by code point, so that their
order tells prose from noise in any script. What is counted grows with the input; its tables of orders 1 to 4 have at most
32^4 entries each, which bounds what is collected and broadcast. The counts of the highest order
stay distributed. They are joined to the documents in shards: documents are dealt to blocks, each
block asks each shard once for the distinct 5-grams it holds, and the shard's answers go back to the
block, so what is shuffled is a set per block and not a row per character. A shard answers to at most CHUNK
blocks in one task. A trusted document is
scored by the model of all other trusted documents: its own 5-grams are taken off the counts, the histories' totals and types, and
the continuation counts of every lower order, so that thresholds hold for unseen text. Only the discounts are those of all trusted text.

A document is kept if its perplexity is at most its language's threshold, the `quantile` of the
trusted documents of that language times `margin`. A language without trusted documents, and a null
language, take the threshold over all trusted documents.

Defined edge cases: a null or blank text has no perplexity (null) and is not kept; without trusted
documents every distribution is uniform and nothing is kept; repeated rows are counted and judged
each by itself; a null doc_id is judged but never trusted; empty tables give no rows. Only `doc_id`,
`text` and `lang` of the documents and `doc_id` and `quality` of the labels are read.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

ORDER, BITS = 5, 5
TOP, LOW = 1 << ORDER * BITS, 1 << (ORDER - 1) * BITS
BLOCK_CHARS = 24_000_000
SHARDS, CHUNK = 64, 256  # 5-grams have 25 bits, so a shard holds at most 2^19 counts; blocks that one task answers
BROADCAST_LANGUAGES = 10_000


@cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    def of(c: str) -> int:
        if c.isspace():
            return 26
        if c.isdigit():
            return 27
        if c in ".,;:'\"()-?!":
            return 28
        low = unicodedata.normalize("NFD", c.lower())[:1]
        if "a" <= low <= "z":
            return ord(low) - 97
        return ord(low) % 26 if c.isalpha() else 29 if c < "\x80" else 31

    table = np.full(0x110000, 31, np.uint8)
    for k in range(0x30000):
        table[k] = of(chr(k)) if not 0xD800 <= k < 0xE000 else 31
    return table


def grams(text: str) -> np.ndarray:
    """The 5-gram that ends at each character, as a number of 25 bits; the text is led in by white space."""
    s = np.full(len(text) + ORDER - 1, 26, np.int32)
    s[ORDER - 1:] = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.zeros(len(text), np.int32)
    for k in range(ORDER):
        out = (out << BITS) | s[k:k + len(text)]
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0, *(float(np.clip(x, 0.05, k + 0.95)) for k, x in enumerate(d))])


class Model:
    """Interpolated modified Kneser-Ney probabilities; orders 1 to 4 from continuation counts, the highest from counts."""

    def __init__(self, n4: np.ndarray, history: np.ndarray, types: np.ndarray, of_counts: list[int]):
        """n4: 5-grams that end in each 4-gram; history: tokens per history of 4; types: histories x (types seen once, twice, more often)."""
        self.top, self.history, self.types = discounts(of_counts), history.astype(np.int64), types.astype(np.int32)
        self.counts = [n4.astype(np.int64)]  # orders 4, 3, 2, 1
        for _ in range(3):
            self.counts.append((self.counts[-1] > 0).reshape(32, -1).sum(axis=0).astype(np.int64))
        self.discounts = [discounts([(c == k).sum() for k in (1, 2, 3, 4)]) for c in self.counts]
        self.total = [c.reshape(-1, 32).sum(axis=1) for c in self.counts]
        self.cut = [d[np.minimum(c, 3)].reshape(-1, 32).sum(axis=1) for c, d in zip(self.counts, self.discounts)]
        self.low: np.ndarray | None = None

    def order4(self, g: np.ndarray) -> np.ndarray:
        """Probability of the last class of each 4-gram."""
        p = np.full(len(g), 1 / 32)
        for m in (3, 2, 1, 0):
            x = g & ((1 << BITS * (4 - m)) - 1)
            c, h = self.counts[m][x], x >> BITS
            total = np.maximum(self.total[m][h], 1)
            left = np.where(self.total[m][h] > 0, self.cut[m][h] / total, 1.0)
            p = np.maximum(c - self.discounts[m][np.minimum(c, 3)], 0) / total + left * p
        return p

    def log2(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log2 probability of the last class of each 5-gram given its count."""
        if self.low is None:
            self.low = self.order4(np.arange(LOW)).astype(np.float32)
        return self._log2(keys, counts, self.low[keys & (LOW - 1)])

    def _log2(self, keys, counts, low) -> np.ndarray:
        h = keys >> BITS
        total = np.maximum(self.history[h], 1)
        left = np.where(self.history[h] > 0, (self.types[h] @ self.top[1:]) / total, 1.0)
        return np.log2(np.maximum(counts - self.top[np.minimum(counts, 3)], 0) / total + left * low)

    def log2_without(self, keys: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """As `log2`, under the model of all text but a document with the distinct 5-grams `keys`, `own` times each."""
        rest, h = np.maximum(counts - own, 0), keys >> BITS
        own = counts - rest
        undo = []

        def add(table, at, by):
            np.add.at(table, at, by)
            undo.append((table, at, by))

        add(self.history, h, -own)
        for k in (0, 1, 2):
            add(self.types, (h, k), (np.minimum(rest, 3) == k + 1).astype(np.int32) - (np.minimum(counts, 3) == k + 1))
        gone = keys[(rest == 0) & (counts > 0)]  # 5-grams that only this document has
        for m in range(4):
            x, fewer = np.unique(gone & ((1 << BITS * (4 - m)) - 1), return_counts=True)
            before = self.counts[m][x]
            now = before - fewer
            d = self.discounts[m]
            add(self.counts[m], x, -fewer)
            add(self.total[m], x >> BITS, -fewer)
            add(self.cut[m], x >> BITS, d[np.minimum(now, 3)] - d[np.minimum(before, 3)])
            gone = x[now == 0]
        out = self._log2(keys, rest, self.order4(keys & (LOW - 1)))
        for table, at, by in reversed(undo):
            np.add.at(table, at, -by)
        return out


PACKED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def _pack(batches):
    """The rows of each block in a batch as one compressed piece: texts cross the network several times smaller."""
    import zstandard

    for b in batches:
        block = b.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        pieces = []
        for rows in np.split(order, starts[1:]):
            sink = pa.BufferOutputStream()
            part = pa.Table.from_batches([b]).select(PACKED.names).take(pa.array(rows)).cast(PACKED)
            with pa.ipc.new_stream(sink, PACKED) as out:
                out.write_table(part)
            pieces.append(zstandard.compress(sink.getvalue(), 3))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(pieces, pa.binary())], names=["block", "rows"])


def _unpack(group: pa.Table) -> tuple[int, pa.Table]:
    """The block's number and rows."""
    import zstandard

    tables = [pa.ipc.open_stream(zstandard.decompress(x)).read_all() for x in group.column("rows").to_pylist()]
    return (group.column("block")[0].as_py() if tables else 0), (pa.concat_tables(tables) if tables else PACKED.empty_table())


_scratch: dict[str, np.ndarray] = {}


def _flags() -> np.ndarray:
    if "flags" not in _scratch:
        _scratch["flags"] = np.zeros(TOP, bool)
    return _scratch["flags"]


def _distinct(texts: list[str | None]) -> np.ndarray:
    seen = _flags()
    for t in texts:
        if t:
            seen[grams(t)] = True
    keys = np.flatnonzero(seen).astype(np.int32)
    seen[keys] = False
    return keys


def _count(docs: pa.Table, labels: pa.Table) -> pa.Table:
    """5-gram counts of the block's trusted documents."""
    _, docs = _unpack(docs)
    trusted = set(labels.column("doc_id").to_pylist())
    total = np.zeros(0, np.int32), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    texts = [t for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()) if i in trusted and t]

    def add(total):
        keys, where = np.unique(np.concatenate([total[0], *held]), return_inverse=True)
        weights = np.concatenate([total[1], np.ones(len(where) - len(total[0]), np.int64)])
        held.clear()
        return keys, np.bincount(where, weights).astype(np.int64)

    size = 0
    for t in texts:
        held.append(grams(t))
        size += len(t)
        if size > 4_000_000:
            total, size = add(total), 0
    if held:
        total = add(total)
    return pa.table({"key": pa.array(total[0], pa.int32()), "n": pa.array(total[1], pa.int64())})


def _ask(docs: pa.Table) -> pa.Table:
    """The block's distinct 5-grams, by shard and chunk of blocks."""
    block, docs = _unpack(docs)
    keys = _distinct(docs.column("text").to_pylist())
    shard = keys % SHARDS
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    rows = [(s, keys[order[ends[s]:ends[s + 1]]].tobytes()) for s in range(SHARDS) if ends[s + 1] > ends[s]]
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([block // CHUNK] * len(rows), pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                     "keys": pa.array([r[1] for r in rows], pa.binary())})


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """Counts of the asked 5-grams that the shard knows."""
    keys, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    out = []
    for block, raw in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist()):
        want = np.frombuffer(raw, np.int32)
        if not len(keys):
            break
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[at] == want
        out.append((block, want[hit].tobytes(), n[at[hit]].astype(np.int64).tobytes()))
    return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})


def _score(shared):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        _, docs = _unpack(docs)
        ids, langs, texts = (docs.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
        own = set(answers.column("trusted").drop_null().to_pylist())
        answers = answers.filter(answers.column("keys").is_valid())
        if "count" not in _scratch:
            _scratch["count"], _scratch["log2"] = np.zeros(TOP, np.int32), np.zeros(TOP, np.float32)
        count, table = _scratch["count"], _scratch["log2"]
        keys = _distinct(texts)
        count[keys] = 0
        for k, n in zip(answers.column("keys").to_pylist(), answers.column("counts").to_pylist()):
            count[np.frombuffer(k, np.int32)] = np.frombuffer(n, np.int64)
        table[keys] = model.log2(keys, count[keys])

        def mean_bits(i, text: str) -> float:
            g = grams(text)
            if i not in own:
                return float(-table[g].mean(dtype=np.float64))
            k, n = np.unique(g, return_counts=True)
            return float(-(model.log2_without(k, count[k], n) * n).sum(dtype=np.float64) / len(g))

        sizes = [len(t or "") for t in texts]
        mean = [mean_bits(i, t) if t and not t.isspace() else None for i, t in zip(ids, texts)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_chars": pa.array(sizes, pa.int64()),
                         "perplexity": pa.array([None if m is None else 2.0 ** m for m in mean], pa.float64())})

    return run


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) for every row of `docs`; `trusted` has the doc_id of trusted rows."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(8, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).otherwise(block)  # rows without an id are never trusted
    dealt = docs.select(F.col("doc_id").cast("long"), "lang", "text").withColumn("block", spread).mapInArrow(_pack, "block int, rows binary").repartition(blocks, "block")
    labels = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("block", block)
    counts = dealt.groupBy("block").cogroup(labels.groupBy("block")).applyInArrow(_count, "key int, n long")
    counts = cut(counts.groupBy("key").agg(F.sum("n").alias("n")))

    of_counts = {r.n: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    n4, history, types = np.zeros(LOW, np.int64), np.zeros(LOW, np.int64), np.zeros((LOW, 3), np.int64)
    # At most 32^4 rows each, however large the corpus.
    for r in counts.groupBy((F.col("key").bitwiseAND(LOW - 1)).alias("g")).count().toLocalIterator():
        n4[r.g] = r["count"]
    per = counts.groupBy(F.shiftright("key", BITS).alias("h")).agg(F.sum("n").alias("t"), F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"), F.count_if(F.col("n") > 2).alias("c"))
    for r in per.toLocalIterator():
        history[r.h], types[r.h] = r.t, (r.a, r.b, r.c)
    shared = spark.sparkContext.broadcast(Model(n4, history, types, [of_counts.get(k, 0) for k in (1, 2, 3, 4)]))

    asked = dealt.groupBy("block").applyInArrow(_ask, "shard int, chunk int, block int, keys binary")
    # The counts have at most 2^25 rows; each chunk of blocks gets a copy of them.
    sharded = counts.withColumn("shard", F.col("key") % SHARDS).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // CHUNK))))
    answers = asked.groupBy("shard", "chunk").cogroup(sharded.groupBy("shard", "chunk")).applyInArrow(_answer, "block int, keys binary, counts binary")
    answers = answers.withColumn("trusted", F.lit(None).cast("long")).unionByName(labels.select("block", F.col("doc_id").alias("trusted")), allowMissingColumns=True)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared), "doc_id long, lang string, n_chars long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, margin: float = 1.1) -> DataFrame:
    """Perplexity, threshold and verdict of every document."""
    scored = cut(perplexities(docs, trusted))
    good = scored.join(trusted.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").where("perplexity is not null")
    limit = (F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("limit")
    by_lang = cut(good.where("lang is not null").groupBy("lang").agg(limit))
    if by_lang.count() <= BROADCAST_LANGUAGES:
        by_lang = F.broadcast(by_lang)
    overall = good.agg(limit).first()[0]
    out = scored.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("limit", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.where("quality = 1"))
