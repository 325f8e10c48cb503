"""Operator 2, SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of a binary trie. Two subtrees are walked together: at each bit the
pair of nodes splits into up to four pairs of children, a pair whose paths already differ in more
bits than the budget is pruned, and what survives to the leaves are the links. Pairs of subtrees
("cells") are expanded level by level as DataFrame rows until a cell is small, so a prefix that
holds any share of the fingerprints is cut further; small cells are finished by a vectorised walk
over sorted arrays. Each cell returns a spanning star forest of its links, never all pairs, and
components follow by large-star / small-star rounds.

Links join fingerprints, so a text without an id links like any other. `near_copies` runs the same
walk in the tries of texts that share a shingle, for a similarity instead of a few bits.

Defined edge cases: a null or blank text has fingerprint 0 and links like any other; rows of one
text share a fingerprint, and rows of one doc_id are judged each by its own text; a null doc_id
keeps its row, is never a component's name, and gets component null if no id is reachable; an empty
table gives no rows. Only `doc_id` and `text` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, hex64, lean, map_texts

BITS = 64
STEP = 6  # bits by which a cell's prefixes grow in one expansion
CELL_ROWS = 120_000  # cells above this many rows are expanded further


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 15) -> int:
    """SimHash of the word shingles of `text` as an unsigned 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else [tuple(words)]
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(b" ".join(g), 42) for g in grams), np.uint64), chunk)


def majority(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), chunk):
        part = np.unpackbits(hashes[at:at + chunk].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def rows(texts):
        fps = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return {"fp": fps.view(np.int64)}

    return map_texts(docs, ["doc_id"], "text", "doc_id long, fp long", rows)


def walk(fp: np.ndarray, ranges: list[np.ndarray], bit: int, budget: int, root: np.ndarray | None = None, room: int = 1 << 17):
    """Index pairs (i, j) with popcount(fp[i] ^ fp[j]) <= budget, in pieces, by walking pairs of trie nodes together.

    `ranges` names pairs of nodes: from and to of one, from and to of the other, and the bits in which their paths above
    `bit` differ. A node is a range of `fp` that is sorted and of one path; a node may be paired with itself, and then each
    unordered pair is found once. Pairs of nodes are kept on a stack of pieces of at most `room`, so memory stays bounded
    whatever the data. With `root`, pairs of equal root are left out, and two nodes of one and the same root are pruned.
    """
    change = None if root is None else np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    stack = [(bit, ranges)]
    while stack:
        bit, (al, ah, bl, bh, e) = stack.pop()
        if root is not None and len(al):
            mixed = (change[al] != change[ah - 1]) | (change[bl] != change[bh - 1]) | (root[al] != root[bl])
            al, ah, bl, bh, e = (x[mixed] for x in (al, ah, bl, bh, e))
        if len(al) > room:
            for at in range(0, len(al), room):
                stack.append((bit, [x[at:at + room] for x in (al, ah, bl, bh, e)]))
            continue
        alone = (ah - al == 1) & (bh - bl == 1)
        if alone.any():
            i, j = al[alone], bl[alone]
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & (i != j)
            yield i[near], j[near]
            al, ah, bl, bh, e = (x[~alone] for x in (al, ah, bl, bh, e))
        if not len(al):
            continue
        if bit < 0:  # equal fingerprints
            for a0, a1, b0, b1 in zip(al.tolist(), ah.tolist(), bl.tolist(), bh.tolist()):
                for i in range(a0, a1):
                    for at in range(max(b0, i + 1) if a0 == b0 else b0, b1, room):
                        j = np.arange(at, min(b1, at + room))
                        if root is not None:
                            j = j[root[j] != root[i]]
                        yield np.full(len(j), i), j
            continue
        zeros = np.concatenate([[0], np.cumsum(fp >> np.uint64(bit) & np.uint64(1) == 0)])
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        kids = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1), (am, ah, bl, bm, e + 1)]
        kids[3] = tuple(x[al != bl] for x in kids[3])  # of a node paired with itself, the two mixed children are one pair
        new = [np.concatenate(x) for x in zip(*kids)]
        ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        stack.append((bit - 1, [x[ok] for x in new]))


def star_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while not np.array_equal(label, hop := label[label]):
            label = hop
        if np.array_equal(before, label):
            break
    return label


def node_pairs(cells: pa.Table) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Rows of cells of one depth, in the order of their nodes: that order, the pairs of nodes, and the bit to go on from.

    A cell (key, pa, pb) is the pair of the nodes with paths pa and pb in the trie of its key; pa = pb is a node with itself.
    """
    key, left, right, side = (cells.column(c).to_numpy() for c in ("key", "pa", "pb", "side"))
    depth = cells.column("depth")[0].as_py()
    order = np.lexsort((cells.column("fp").to_numpy().view(np.uint64), side, right, left, key))
    key, left, right, side = key[order], left[order], right[order], side[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    end = np.append(new[1:], len(key))
    ones = np.concatenate([[0], np.cumsum(side)])
    middle = end - (ones[end] - ones[new])
    same = left[new] == right[new]
    ranges = [new, np.where(same, end, middle), np.where(same, new, middle), end, np.bitwise_count((left[new] ^ right[new]).astype(np.uint64)).astype(np.int64)]
    full = (ranges[1] > ranges[0]) & (ranges[3] > ranges[2])
    return order, [x[full] for x in ranges], BITS - 1 - depth


def _cell_links(budget: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        order, ranges, bit = node_pairs(group)
        signed = group.column("fp").to_numpy()[order]
        found = list(walk(signed.view(np.uint64), ranges, bit, budget))
        i, j = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        ids, where = np.unique(signed, return_inverse=True)
        label = star_forest(len(ids), where[i], where[j])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table([pa.array(ids[moved]), pa.array(ids[label[moved]])], schema=schema)

    return run


def _expand(cells: DataFrame, bits: int, budget: int) -> DataFrame:
    """Each row goes to the child cells in which it can still meet a partner within the budget."""
    carried = [c for c in cells.columns if c not in ("side", "depth", "pa", "pb")]
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    nxt = cells.depth + bits
    own_bits = F.expr(f"shiftrightunsigned(fp, 64 - depth - {bits}) & {(1 << bits) - 1}")
    own, other = F.when(F.col("side") == 0, F.col("pa")).otherwise(F.col("pb")), F.when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa"))
    x = cells.select(*carried, "side", (F.col("pa") == F.col("pb")).alias("same"), nxt.alias("depth"),
                     (F.shiftleft(own, bits).bitwiseOR(own_bits)).alias("own"),
                     F.shiftleft(other, bits).alias("o"), own_bits.alias("bits"),
                     F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    x = x.withColumn("o", F.col("o").bitwiseOR(F.col("bits").bitwiseXOR(F.col("m"))))
    x = x.where(F.bit_count(F.col("own").bitwiseXOR(F.col("o"))) <= budget)
    flip = F.when(F.col("same"), F.col("own") > F.col("o")).otherwise(F.col("side") == 1)
    return x.select(*carried, F.when(flip, 1).otherwise(0).alias("side"), "depth",
                    F.when(flip, F.col("o")).otherwise(F.col("own")).alias("pa"),
                    F.when(flip, F.col("own")).otherwise(F.col("o")).alias("pb"))


def cells_of(rows: DataFrame, budget: int, cell_rows: int = CELL_ROWS, even: int = 0) -> DataFrame:
    """Rows (key, fp, ...) in cells of at most `cell_rows`: a cell is a pair of nodes in the trie of one key, and too large ones are cut into pairs of their children.

    `even` is the number of rows that lie evenly under one key: as many levels as they need are cut at once, without counting.
    """
    cells = rows.select("*", F.lit(0).alias("side"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    start = min(BITS - 2 * STEP, max(0, math.ceil(math.log2(max(even, 1) * 2 / cell_rows))))
    grown = 0
    while grown < start:
        bits = min(STEP, start - grown)
        cells = _expand(cells, bits, budget)
        grown += bits
    done: list[DataFrame] = []
    key = ["key", "pa", "pb", "depth"]
    while grown + STEP <= BITS:
        large = cut(cells.groupBy(*key).count().where(F.col("count") > cell_rows).select(*key))
        if large.isEmpty():
            break
        done.append(cells.join(large, key, "left_anti").select(*cells.columns))
        cells = cut(_expand(cells.join(large, key, "left_semi").select(*cells.columns), STEP, budget))
        grown += STEP
    for d in done:
        cells = cells.unionByName(d)
    return cells


def links(fps: DataFrame, budget: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints (fp) within `budget` bits of each other."""
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp")
    cells = cells_of(rows, budget, cell_rows, fps.count())
    out = cells.groupBy("pa", "pb", "depth").applyInArrow(lean(_cell_links(budget)), "u long, v long")
    return cut(out.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node with a link, by large-star / small-star."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = None
    while True:  # about log n squared rounds
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id) of nodes (fp, rep): the least rep that links lead to, null if none has one."""
    roots = cut(components(edges).withColumnRenamed("node", "fp"))
    ends = roots.unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()
    least = ends.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    found = ends.join(least, "root").select("fp", "least", F.lit(True).alias("linked"))
    return nodes.join(found, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; component_id is the least doc_id reachable by links."""
    fps = cut(fingerprints(docs, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = named(nodes, links(nodes.select("fp"), budget, cell_rows))
    return fps.join(comp, "fp", "left").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
