"""Operator 12, near copies of embeddings by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. All vectors are turned by one random rotation and split into blocks of
coordinates. If two vectors lie within the squared distance, then in at least one block they lie within that block's share of it, in proportion to its
coordinates. Each block is joined by range: its space is cut into the leaves of a k-d tree, a vector is at home in
one leaf and a guest in each leaf of a smaller number that its ball reaches, and homes meet homes and guests. What a block
finds is verified by the cosine itself. A pair counts in the first block that finds it, so the union
of all blocks needs no pairs to be written: each task returns a count of links per vector and a star of each component it saw.

Equal vectors are one node with a multiplicity. The tree is made from a bounded sample and decides only where leaves end: a leaf that holds
too many vectors is dealt to tiles, and every two tiles of it meet in a task of their own, so a task's rows are bounded
whatever the data. Trees stop where a block's spread is small against the radius, as further cuts would only copy rows.

Defined edge cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are their own component;
vectors of different lengths do not link; rows of one vec_id are judged each by its own vector; a null vec_id keeps its row, links like any other,
never names a component and is not kept; an empty table gives no rows. Only `vec_id` and `embedding` are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, give_back, lean
from gleaner.llm.simhash import named, star_forest

COSINE, BLOCKS, SEED = 0.95, 8, 12
LEAF, TILE, DEPTH = 4_000, 8_000, 10
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
SLACK = 1e-9  # above the rounding of a squared distance


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, blocks: int) -> np.ndarray:
    """Where the blocks of coordinates begin, and the end."""
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def limits(dim: int, blocks: int, cosine: float) -> np.ndarray:
    """Squared distance that each block grants."""
    return (2 - 2 * cosine) * np.diff(cuts(dim, blocks)) / dim + SLACK


def _unit(batches):
    """(vec_id, dim, unit): vectors of length one as bytes; null for those that link with nothing."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            lists = part.column(1)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # of null rows nothing is left, null components are NaN
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                v = flat[starts[rows][:, None] + np.arange(size)]
                top = np.abs(v).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                v = v[ok] / top[ok][:, None]
                v = v / np.sqrt((v * v).sum(axis=1))[:, None] + 0.0  # no negative zeros
                for r, x in zip(rows[ok].tolist(), v):
                    out[r] = x.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "unit"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _turned(batches):
    """(cls, dim, turned): rotated vectors; each is turned once, so that all tasks see the same bits."""
    for b in batches:
        dims = b.column(1).to_numpy()
        out: list[bytes] = [b""] * b.num_rows
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for r, x in zip(rows.tolist(), _matrix(b.column(2).take(pa.array(rows)), dim) @ rotation(dim)):
                out[r] = x.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["cls", "dim", "turned"])


def tree(x: np.ndarray, depth: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of each cut of a k-d tree over the rows of `x`, as a heap; a place of infinity leaves a node whole."""
    axis, place = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    held = {0: x}
    for node in range(len(axis)):
        some = held.pop(node, x[:0])
        if len(some) < 32 or (spread := some.std(axis=0)).max() < radius / 2:
            continue
        axis[node] = a = int(spread.argmax())
        place[node] = p = float(np.median(some[:, a]))
        held[2 * node + 1], held[2 * node + 2] = some[some[:, a] <= p], some[some[:, a] > p]
    return axis, place


def leaves(x: np.ndarray, axis: np.ndarray, place: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaf that holds each row of `x`, and those of smaller numbers within the squared distance `limit`."""
    n = len(x)
    row, node, home, off = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), np.zeros_like(x)
    for _ in range(len(axis).bit_length()):
        a, p = axis[node], place[node]
        at = x[row, a]
        right = at > p
        far = off.copy()
        far[np.arange(len(row)), a] = at - np.where(np.isfinite(p), p, 0)
        reached = np.isfinite(p) & ((far * far).sum(axis=1) <= limit + SLACK)
        row, home, off = np.concatenate([row, row[reached]]), np.concatenate([home, np.zeros(reached.sum(), bool)]), np.concatenate([off, far[reached]])
        node = np.concatenate([2 * node + 1 + right, (2 * node + 2 - right)[reached]])
    mine = np.empty(n, np.int64)
    mine[row[home]] = node[home]
    kept = home | (node < mine[row])
    return row[kept], node[kept] - len(axis), home[kept]


def _seats(trees: dict, blocks: int, cosine: float, carry: bool):
    """(dim, block, leaf, home, cls, mult, turned): a row for each leaf of each block in which a vector has a seat."""
    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * 1e6 / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    some = part.take(pa.array(np.flatnonzero(dims == dim)))
                    x, edges, limit = _matrix(some.column(3), dim), cuts(dim, blocks), limits(dim, blocks, cosine)
                    for k in range(len(limit)):
                        axis, place = trees.get((dim, k), (np.empty(0, np.int64), np.empty(0)))
                        row, leaf, home = leaves(np.ascontiguousarray(x[:, edges[k]:edges[k + 1]]), axis, place, limit[k])
                        own = some.take(pa.array(row))
                        cols = [own.column(1), pa.array(np.full(len(row), k, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(home)]
                        yield pa.RecordBatch.from_arrays(cols + ([own.column(0), own.column(2), own.column(3)] if carry else []), names=["dim", "block", "leaf", "home", "cls", "mult", "turned"][:7 if carry else 4])
        give_back()

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up coordinate by coordinate, so that they do not depend on what else is computed."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += (a[:, k] - b[:, k]) ** 2
    return out


def _linked(blocks: int, cosine: float, room: int = 1 << 22):
    """(cls, links, root) of the vectors of one task that have links here: their number of partners, and the least class of their component."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        dim, block, i, j = (group.column(c)[0].as_py() for c in ("dim", "block", "i", "j"))
        cls, mult, right = (group.column(c).to_numpy() for c in ("cls", "mult", "guest"))
        order = np.lexsort((cls, right))
        x, cls, mult, right = _matrix(group.column("turned"), dim)[order], cls[order], mult[order], right[order]
        n, left = len(cls), int((right == 0).sum())
        edges, limit = cuts(dim, blocks), limits(dim, blocks, cosine)
        own = np.ascontiguousarray(x[:, edges[block]:edges[block + 1]])
        square = (own * own).sum(axis=1)
        counts, label = np.zeros(n, np.int64), np.arange(n)
        step = max(1, room // max(n, 1))
        for at in range(0, left, step):
            to = min(left, at + step)
            begin = at if i == j else left  # homes of one tile meet each other once
            near = square[at:to, None] + square[None, begin:] - 2 * own[at:to] @ own[begin:].T <= limit[block] + 1e-6
            u, v = np.nonzero(near)
            u, v = u + at, v + begin
            u, v = (y[v > u] for y in (u, v))
            for lo in range(0, len(u), room // dim + 1):
                p, q = u[lo:lo + room // dim + 1], v[lo:lo + room // dim + 1]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[ok], q[ok]
                ok = distance(own[p], own[q]) <= limit[block]
                for k in range(block):  # the first block that finds a pair has it
                    ok[ok] = distance(x[p[ok], edges[k]:edges[k + 1]], x[q[ok], edges[k]:edges[k + 1]]) > limit[k]
                p, q = p[ok], q[ok]
                np.add.at(counts, p, mult[q])
                np.add.at(counts, q, mult[p])
                apart = label[p] != label[q]
                if apart.any():
                    label = star_forest(n, np.concatenate([np.arange(n), p[apart]]), np.concatenate([label, q[apart]]))
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label, cls)
        has = counts > 0
        return pa.table([pa.array(cls[has]), pa.array(counts[has]), pa.array(least[label[has]])], schema=schema)

    return run


def links(nodes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(cls, links, root) for nodes (cls, mult, dim, turned), in parts: links add up, (cls, root) are edges that span the components."""
    total = nodes.agg(F.count("*").alias("n"), F.sum("dim").alias("d")).first()
    if not total.n:
        return nodes.sparkSession.createDataFrame([], "cls long, links long, root long")
    room = max(1, min(SAMPLE_ROWS, int(SAMPLE_BYTES / (8 * total.d / total.n))))
    some = nodes.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, -(-total.n // room)))) == 0).select("dim", "turned").limit(2 * room).collect()
    trees, by_dim = {}, {}
    for r in some:
        by_dim.setdefault(r.dim, []).append(np.frombuffer(r.turned, np.float64))
    for dim, rows in by_dim.items():
        x, edges, limit = np.array(rows), cuts(dim, blocks), limits(dim, blocks, cosine)
        depth = min(DEPTH, max(0, int(np.ceil(np.log2(total.n * len(rows) / len(some) / leaf)))))
        for k in range(len(limit)):
            trees[dim, k] = tree(x[:, edges[k]:edges[k + 1]], depth, float(np.sqrt(limit[k])))
    given, where = nodes.select("cls", "dim", "mult", "turned"), ["dim", "block", "leaf"]
    seats = given.mapInArrow(_seats(trees, blocks, cosine, True), "dim int, block int, leaf int, home boolean, cls long, mult long, turned binary")
    sizes = given.mapInArrow(_seats(trees, blocks, cosine, False), "dim int, block int, leaf int, home boolean").groupBy(*where).agg(F.count("*").alias("n"), F.max("home").alias("lived_in"))
    sizes = sizes.where("lived_in").select(*where, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = seats.join(sizes, where).withColumn("t", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    pair = lambda i, j, guest: F.struct(i.alias("i"), j.alias("j"), F.lit(guest).alias("guest"))
    as_left = F.when(F.col("home"), F.transform(tiles, lambda k: pair(F.col("t"), k, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,guest:int>>"))
    as_right = F.transform(F.filter(tiles, lambda k: ~F.col("home") | (k < F.col("t"))), lambda k: pair(k, F.col("t"), 1))
    dealt = dealt.select(*where, "cls", "mult", "turned", F.explode(F.concat(as_left, as_right)).alias("x")).select(*where, "cls", "mult", "turned", "x.*")
    return dealt.groupBy(*where, "i", "j").applyInArrow(lean(_linked(blocks, cosine)), "cls long, links long, root long")


def near_copies(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding)."""
    units = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_unit, "vec_id long, dim int, unit binary")
    units = units.withColumn("digest", F.sha2("unit", 256))
    alike = units.where("unit is not null").groupBy("digest").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    nodes = cut(alike.withColumn("cls", F.monotonically_increasing_id()))
    turned = nodes.select("cls", "dim", "unit").mapInArrow(_turned, "cls long, dim int, turned binary")
    turned = cut(turned.join(nodes.select("cls", "mult"), "cls").select("cls", "dim", "mult", "turned"))
    found = cut(links(turned, cosine, blocks, leaf, tile))
    partners = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = named(nodes.select(F.col("cls").alias("fp"), "rep"), found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    classes = nodes.select("digest", "cls", "mult").join(partners, "cls", "left").join(comp.select(F.col("fp").alias("cls"), "component_id"), "cls")
    classes = classes.select("digest", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    out = units.select("vec_id", "digest").join(classes, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(vectors: DataFrame) -> DataFrame:
    return near_copies(vectors)
