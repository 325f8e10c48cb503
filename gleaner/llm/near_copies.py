"""Operator 2 for a similarity: SimHash near copies whose 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts of such a similarity differ in about ten of 64 bits of their fingerprints, too many for one trie of all
fingerprints to prune by. The binary-trie self-join therefore runs in many small tries: one for each shingle that stands in the
prefixes of several texts. With the shingles of every text in one common order, two texts that reach the similarity share one of
the first n - ceil(similarity * n) + 1 of each, so some trie holds both. In a trie, node pairs are walked together and pruned
beyond an error budget of 26 bits, five standard deviations above what the similarity makes expected for the smallest sets.
What is left is compared by sizes, by the number of shared prefix shingles, and last by the shingle sets themselves.
The order puts shingles that a sample of the texts has often last and goes by hash otherwise: any order finds every pair,
this one keeps the tries small.

Pairs within one component need no check. A first round therefore checks, for each text, only the FIRST neighbouring leaves that it
meets at fewest bits and the FIRST heaviest texts that it meets in most tries; the walk then prunes node pairs all of whose texts are in
one component. Up to ROUNDS walks give no pairs but those of a least spanning forest of the components in their shard, by the bits in which
sketches of 256 bits differ, which joins large groups of near copies in rows that grow with the texts. A last walk gives every pair
that is left between two components and differs in no more than APART bits, six standard deviations above what the similarity makes expected;
of these FIRST are checked first, and all others where they do not link the two.

Defined edge cases: a text of fewer than five words is one shingle; texts without words are equal to each other; a row without
an id links like any other and never names a component, and of a group without ids one row stays; rows of one doc_id are judged each by
its own text, and of equal rows one stays; an empty table gives no rows; further columns of any name pass through.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, fresh, lean, map_texts
from gleaner.llm.simhash import cells_of, components, majority, named, node_pairs, star_forest, walk

WIDTH, SIMILARITY, BUDGET = 5, 0.8, 26
SKETCH = ["s0", "s1", "s2", "s3"]  # 256 bits of minima, of which two sets of the similarity differ in 26 +- 5
ORDERS = np.random.default_rng(42).integers(0, 1 << 31, (64 * len(SKETCH), 1), np.uint32) << np.uint32(1) | np.uint32(1)
APART, ROUNDS = 56, 3
SAMPLE, COMMON = 2_000, 50_000
CELL_ROWS, SHARD_ROWS, HOME_ROWS, FIRST = 100_000, 200_000, 2_000, 4


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles of `text`, ascending."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else [tuple(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64))


def digest(s: np.ndarray) -> int:
    """A signed long that names a set."""
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(s.tobytes()), np.uint64).view(np.int64)) if len(s) else 0


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set, of which two sets that reach the similarity share one; `common` is ascending, `rank` above 0."""
    if not len(s):
        return s
    late = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        late = np.where(common[at] == s, rank[at], 0)
    return s[np.lexsort((s, late))][:len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


def sketch(s: np.ndarray, chunk: int = 1 << 10) -> np.ndarray:
    """A bit of the least value of a set under each of ORDERS, as longs: two sets differ in about (1 - similarity) / 2 of them."""
    half = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(ORDERS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), chunk):
        np.minimum(least, (ORDERS * half[at:at + chunk]).min(axis=1), out=least)
    return np.packbits(np.bitwise_count(least) & 1).view(np.int64)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """The least spanning forest of the components that `pairs` (u, v, their components, bits) join, by bits: fewer pairs than components."""
    roots, at = np.unique(pairs[2:4], return_inverse=True)
    order = np.lexsort((pairs[1], pairs[0], pairs[4]))
    a, b = at.reshape(2, -1)[:, order]
    label, live, chosen = np.arange(len(roots)), np.arange(len(order)), [np.empty(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return pairs[:, order[np.concatenate(chosen)]]
        first = np.full(len(roots), len(order))  # the closest pair that leads out of each tree
        np.minimum.at(first, label[a[live]], live)
        np.minimum.at(first, label[b[live]], live)
        chosen.append(np.unique(first[first < len(order)]))
        label = star_forest(len(roots), label[a[chosen[-1]]], label[b[chosen[-1]]])[label]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several texts of a sample, ascending, with their number of texts; at most COMMON."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    sets = map_texts(some, ["doc_id"], "text", "doc_id long, s array<long>", lambda texts: {"s": [shingles(t).view(np.int64) for t in texts]})
    rows = sets.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows], np.int64)[order]


def _marked(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column that is true for every doc_id of `ids` and a few others, and its name: a bitmap of fixed size, so that texts need not be shuffled."""
    bit_, at_, mask_, hit = fresh(docs.columns, "bit", "at", "mask", "hit")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 23))
    masks = ids.select(bit.alias(bit_)).groupBy(F.shiftright(bit_, 6).alias(at_)).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit_} & 63 as int)))").alias(mask_))
    d = docs.withColumn(bit_, bit).join(F.broadcast(masks), F.expr(f"shiftright({bit_}, 6)") == F.col(at_), "left")
    is_set = F.expr(f"coalesce(shiftrightunsigned({mask_}, cast({bit_} & 63 as int)) & 1L = 1L, false)")
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], is_set.alias(hit)), hit


def _seats(fps: DataFrame) -> DataFrame:
    """(key, set): the prefix shingles of each set, once per task that reads it."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1)
            new = [k for k, i in enumerate(ids) if i not in seen and not seen.add(i)]
            for at in range(0, len(new), 200):
                keys = [np.frombuffer(rows[k].as_buffer(), np.int64) for k in new[at:at + 200]]
                sets = np.repeat(np.array([ids[k] for k in new[at:at + 200]], np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(sets)], names=["key", "set"])

    return fps.select("set", "prefix").mapInArrow(run, "key long, set long")


def _met(cells: pa.Table, budget: int, similarity: float):
    """Pairs of sets of different components in the cells of one shard, as arrays (u, v, component of u, of v, bits of their sketches), in pieces."""
    order, ranges, bit = node_pairs(cells)
    fp, ids, n, root, *bits = (cells.column(c).to_numpy()[order] for c in ("fp", "set", "n", "root", *SKETCH))
    for i, j in walk(fp.view(np.uint64), ranges, bit, budget, root):
        d = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in bits)
        ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (d <= APART)
        i, j = np.where(ids[i] < ids[j], i, j)[ok], np.where(ids[i] < ids[j], j, i)[ok]
        yield np.stack([ids[i], ids[j], root[i], root[j], d[ok]])


def _forest(budget: int, similarity: float):
    """Of the pairs in the cells of one shard, those of a least spanning forest of its components."""
    def run(cells: pa.Table) -> pa.Table:
        held, size = [np.empty((5, 0), np.int64)], 0
        for pairs in _met(cells, budget, similarity):
            held.append(pairs)
            size += pairs.shape[1]
            if size > 1_000_000:
                held, size = [spanning(np.concatenate(held, axis=1))], 0
        return pa.table([pa.array(x, pa.int64()) for x in spanning(np.concatenate(held, axis=1))[:4]], names=["u", "v", "ru", "rv"])

    return run


def _candidates(budget: int, similarity: float):
    """All pairs in the cells of one shard, with the number of keys in which they meet and the bits in which their sketches differ."""
    def run(cells: pa.Table) -> pa.Table:
        held, size = [np.empty((4, 0), np.int64)], 0  # u, v, number of keys, bits

        def merged():
            a = np.concatenate(held, axis=1)
            a = a[:, np.lexsort((a[1], a[0]))]
            first = np.flatnonzero(np.concatenate([[True], (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1])])) if a.shape[1] else np.empty(0, np.int64)
            return np.stack([a[0, first], a[1, first], np.add.reduceat(a[2], first) if len(first) else a[2], a[3, first]])

        for u, v, _, _, d in _met(cells, budget, similarity):
            held.append(np.stack([u, v, np.ones(len(u), np.int64), d]))
            size += len(u)
            if size > 2_000_000:
                held, size = [merged()], 0
        u, v, c, d = merged()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "c": pa.array(c, pa.int64()), "d": pa.array(d.astype(np.int32), pa.int32())})

    return run


def links(docs: DataFrame, nodes: DataFrame, seats: DataFrame, similarity: float = SIMILARITY, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) between sets of `nodes` (set, rep, n, fp, and sketches) that span the components of all pairs at `similarity` or above."""
    turn = Window.partitionBy("key").orderBy("set").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    several = seats.withColumns({"lo": F.first("set").over(turn), "hi": F.last("set").over(turn), "size": F.count("*").over(turn)}).where("lo <> hi").select("key", "set", "size")
    # A set's weight is the number of rows that it meets; of a family of copies, the least edited one has the most.
    weight = F.sum("size").over(Window.partitionBy("set"))
    shared = cut(several.join(nodes.select("set", "fp", "n"), "set").select("key", "set", "fp", "n", weight.alias("weight")))
    behind = lambda c: F.ceil(similarity * F.col(c) - 1e-9) - 1  # noqa: E731  shingles behind the prefix

    def rows(texts):
        import zstandard

        return {"set": [digest(shingles(t)) for t in texts], "z": [zstandard.compress((t or "").encode("utf-8"), 3) for t in texts]}

    def alike(batches):
        import zstandard

        held: OrderedDict[int, np.ndarray] = OrderedDict()  # the sets that were asked for last

        def of(i, z):
            if i not in held:
                held[i] = shingles(zstandard.decompress(z.as_buffer()).decode("utf-8"))
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(i)
            return held[i]

        for b in batches:
            ok = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                p, q = of(u, x), of(v, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def checked(pairs):
        have = cut(pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set"))).distinct())
        ids = nodes.select("set", "rep").join(have, "set").select(F.col("rep").alias("doc_id")).distinct()
        marked, hit = _marked(docs, ids)
        texts = map_texts(marked.where(hit), ["doc_id"], "text", "doc_id long, set long, z binary", rows)
        texts = cut(texts.select("set", "z").join(have, "set", "left_semi").dropDuplicates(["set"]))
        x, y = texts.select(F.col("set").alias("u"), F.col("z").alias("x")), texts.select(F.col("set").alias("v"), F.col("z").alias("y"))
        return cut(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(alike, "u long, v long"))

    # Tried first, of those that meet in a tenth of the keys that a link needs: neighbouring leaves, in the order of the whole fingerprint
    # and of it turned by a quarter, a half and three quarters, and the heaviest set of each trie. The rest are met by the walk.
    met = shared.withColumn("near4", F.max(F.struct("weight", F.col("set").alias("g"), F.col("fp").alias("gp"), F.col("n").alias("m"))).over(Window.partitionBy("key")))
    met = met.withColumn("near4", F.struct("near4.g", "near4.gp", "near4.m", F.lit(True).alias("heavy")))
    for k in range(4):
        leaves = Window.partitionBy("key").orderBy(F.expr(f"shiftleft(fp, {16 * k}) | shiftrightunsigned(fp, {64 - 16 * k})") if k else F.col("fp"), "set")
        met = met.withColumn(f"near{k}", F.struct(F.lag("set").over(leaves).alias("g"), F.lag("fp").over(leaves).alias("gp"), F.lag("n").over(leaves).alias("m"), F.lit(False).alias("heavy")))
    near = met.select("set", "fp", "n", F.explode(F.array_distinct(F.array(*[f"near{k}" for k in range(5)]))).alias("x")).select("set", "fp", "n", "x.*")
    near = near.where(F.col("g").isNotNull() & (F.col("g") != F.col("set")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= budget) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9))
    near = near.groupBy("set", "g", "heavy").agg(F.count("*").alias("c"), F.min(F.least("n", "m")).alias("n"), F.min(F.bit_count(F.col("fp").bitwiseXOR(F.col("gp")))).alias("d")).where(F.col("c") >= 0.009 * F.col("n"))
    closest = Window.partitionBy("set", "heavy").orderBy(F.when(F.col("heavy"), -F.col("c")).otherwise(F.col("d")), F.desc("c"), "g")
    near = near.withColumn("k", F.row_number().over(closest)).where(F.col("k") <= FIRST)
    first = cut(near.select(F.least("set", "g").alias("u"), F.greatest("set", "g").alias("v")).distinct())
    found = checked(first)

    def mixed(rows, roots):
        """Those rows, with their components, whose tries hold several."""
        rooted = rows.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return rooted.join(keys, "key", "left_semi")

    def shards(left):
        """The cells of their tries, dealt out by shard: tries in which one component has most rows lie together, HOME_ROWS at a time, so that a pair comes from few shards."""
        most = left.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("home"), F.sum("count").alias("rows"))
        slices = most.groupBy("home").agg(F.ceil(F.sum("rows") / HOME_ROWS).alias("slices"))
        homes = most.join(slices, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("slices"))).alias("home"))
        count = max(64, left.count() // SHARD_ROWS)
        return cells_of(left.join(homes, "key"), budget, cell_rows).withColumn("shard", F.pmod(F.xxhash64("home", "pa", "pb"), F.lit(count))).groupBy("shard", "depth")

    # Then the closest pairs that span the components of each shard, fewer than its rows however many pairs it holds. Components in none of these have no pair left.
    roots = components(found).withColumnRenamed("node", "set")
    left = cut(mixed(shared.select("key", "set", "fp", "n"), roots).distinct().join(nodes.select("set", *SKETCH), "set"))
    for _ in range(ROUNDS):
        forest = cut(shards(left).applyInArrow(lean(_forest(budget, similarity)), "u long, v long, ru long, rv long"))
        ends = forest.select(F.col("ru").alias("root")).unionByName(forest.select(F.col("rv").alias("root"))).distinct()
        left = cut(left.join(ends, "root", "left_semi"))
        closest = cut(forest.select("u", "v").distinct().join(first, ["u", "v"], "left_anti"))
        linked = checked(closest)
        first = cut(first.unionByName(closest))
        if linked.isEmpty():
            break
        found = cut(found.unionByName(linked))
        roots = components(found).withColumnRenamed("node", "set")
        left = cut(mixed(left.drop("root"), roots))
    pairs = shards(left).applyInArrow(lean(_candidates(budget, similarity)), "u long, v long, c long, d int")
    size = nodes.select("set", "n")
    pairs = pairs.groupBy("u", "v").agg(F.sum("c").alias("c"), F.min("d").alias("d")).join(size.select(F.col("set").alias("u"), "n"), "u").join(size.select(F.col("set").alias("v"), F.col("n").alias("m")), "v")
    # What two sets share is in both prefixes or behind the prefix that ends first.
    enough = F.col("c") + F.greatest(behind("n"), behind("m")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    rest = cut(pairs.where(enough).select("u", "v", "c", "d").join(first, ["u", "v"], "left_anti"))

    def apart(pairs, roots):
        """Pairs whose components differ, with these as (ru, rv)."""
        side = lambda c: roots.select(F.col("set").alias(c), F.col("root").alias(f"r{c}"))
        both = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
        return both.select("u", "v", "c", "d", F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv")).where("ru <> rv")

    # Of two components the pairs of closest fingerprints come first; all others are checked if these leave the two apart.
    best = Window.partitionBy(F.least("ru", "rv"), F.greatest("ru", "rv")).orderBy("d", F.desc("c"), "u", "v")
    tried = cut(apart(rest, roots).withColumn("k", F.row_number().over(best)).where(F.col("k") <= FIRST).select("u", "v"))
    found = cut(found.unionByName(checked(tried)))
    roots = components(found).withColumnRenamed("node", "set")
    rest = cut(apart(rest, roots).select("u", "v").join(tried, ["u", "v"], "left_anti"))
    return found.unionByName(checked(rest))


def _linked(docs: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, at, set, ...) of all texts, `at` being the text's hash; their distinct sets as nodes; and links between these."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def rows(texts):
        sets = [shingles(t) for t in texts]
        return {"set": [digest(s) for s in sets], "n": [len(s) for s in sets], "fp": [int(np.array(majority(s), np.uint64).view(np.int64)) for s in sets],
                "prefix": [prefix(s, *shared.value, similarity).tobytes() for s in sets]} | dict(zip(SKETCH, np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCH)).T))

    hashed = docs.select("doc_id", F.xxhash64("text").alias("at"), "text")
    fps = cut(map_texts(hashed, ["doc_id", "at"], "text", "doc_id long, at long, set long, n int, fp long, prefix binary, " + ", ".join(f"{c} long" for c in SKETCH), rows))
    nodes = cut(fps.groupBy("set").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", *SKETCH)]))
    return fps.select("doc_id", "at", "set"), nodes, links(docs, nodes, _seats(fps), similarity, cell_rows=cell_rows)


def grouped(docs: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, component_id) for every row of `docs`; component_id is the least doc_id that near copies lead to."""
    rows, nodes, edges = _linked(docs, similarity, cell_rows)
    comp = named(nodes.select(F.col("set").alias("fp"), "rep"), edges).withColumnRenamed("fp", "set")
    return rows.join(comp, "set", "left").select("doc_id", "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies: that of least doc_id, rows without an id last; of several texts of that id the one of least set and hash, of equal rows any one."""
    rows, _, edges = _linked(docs)
    roots = components(edges).withColumnRenamed("node", "set")
    texts = cut(rows.join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("root"), "doc_id", "at").agg(F.min("set").alias("set"), F.count("*").alias("copies")))
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set", "at")).alias("first"))
    stay = texts.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    stay = cut(stay.select("doc_id", "at", "copies", "stays"))
    marked, hit = _marked(docs, stay.where("not stays or copies > 1").select("doc_id").distinct())
    at_, id_, copies_, turn_ = fresh(marked.columns, "at", "id", "copies", "turn")
    kept = stay.where("stays").select(F.col("doc_id").alias(id_), F.col("at").alias(at_), F.col("copies").alias(copies_))
    asked = marked.where(hit).withColumn(f"{at_}_", F.xxhash64("text"))
    found = asked.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(f"{at_}_") == F.col(at_)))
    every = [F.col(f"`{c}`") for c in docs.columns]
    one = found.where(F.col(copies_) > 1).withColumn(turn_, F.row_number().over(Window.partitionBy(id_, at_).orderBy(F.xxhash64(*every)))).where(F.col(turn_) == 1)
    return marked.where(~F.col(hit)).select(*every).unionByName(found.where(F.col(copies_) == 1).select(*every)).unionByName(one.select(*every))
