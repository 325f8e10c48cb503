"""Operator 9, suffix-array deduplication: bytes covered by a 50-byte string of an earlier document.

Suffixes are sorted by their first 50 bytes, one suffix bucket at a time, and ties are resolved by
precomputed ranks of a difference-cover sample (positions 0, 1 and 3 modulo 7), so that memory is
bound by the bucket and not by the corpus. In equal runs of the sorted order, the suffix of the
smallest doc_id makes all others redundant.

Only suffixes that can have an equal partner are sorted. Each 50-byte string is represented by an
anchor, the 24-byte string in it of least hash (the rightmost on a tie), which depends on nothing
but the string. Suffixes of one anchor that stand next to each other travel together as one context.

1. Documents are dealt to blocks by the hash of their id and text. Whole texts that are equal are settled by
   their SHA-256: only the first takes part further.
2. Each block sends each of its anchors' hashes once to the shard that owns it; the shard answers
   which of them stand in more than one document.
3. The block sends the contexts of shared anchors to their suffix buckets, equal ones once, with the
   smallest doc_id. The bucket sorts and answers which suffixes an earlier document has.
4. The block marks the covered bytes.

A passage that any number of documents share is thus sent once per block and anchor.

Defined edge cases: a null text is empty; texts under 50 bytes lose nothing; rows with equal doc_id
are not earlier than each other; rows with a null doc_id are later than all others and not earlier
than each other; an empty table gives no rows. Only `doc_id` and `text` are read, and matches never
cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, lean

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams in one 50-byte string
COVER, PERIOD = (0, 1, 3), 7
SHIFT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])  # to the next sample position
BLOCK_BYTES, SHARD_ANCHORS = 4_000_000, 1_500_000
SLICE = 600_000  # bytes of contexts that one suffix bucket sorts at a time; sorting takes some 50 bytes a byte
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: later than all

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each position."""
    b = np.frombuffer(data, np.uint8)
    up, down = _power(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up, out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:len(b) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 50-byte strings of one anchor: first start, last start, the anchor's position and hash."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(data)
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width = 1
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[:len(h) - SPAN + 1], m[SPAN - width:SPAN - width + len(h) - SPAN + 1])
    at = (low - (m & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return first, last, at[first], h[at[first]]


def _rows(docs: pa.Table) -> list[tuple[int, bytes]]:
    """The block's rows in an order that any task finds again: (doc_id or NO_ID, bytes)."""
    rows = [(NO_ID if i is None else i, (t or "").encode("utf-8")) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())]
    return sorted(rows)


def _copies(known: pa.Table):
    """Whether a row's whole text stands in an earlier row."""
    listed = {(i, s) for i, s in zip(known.column("copy").to_pylist(), known.column("sha").to_pylist()) if i is not None}
    ids = {i for i, _ in listed}
    return lambda doc, data: doc in ids and (doc, hashlib.sha256(data).digest()) in listed


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _own_hashes(rows, copied, shards: int):
    """Anchor hashes of the block, distinct per document, sorted by (shard, hash) and counted; and the range of each shard that occurs."""
    per = [np.unique(anchors(d)[3]) for i, d in rows if not copied(i, d)]
    h, n = np.unique(np.concatenate(per), return_counts=True) if per else (np.empty(0, np.uint64), np.empty(0, np.int64))
    shard = (h >> np.uint64(20)) % np.uint64(shards)
    shard = shard.astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    return h[order], n[order] > 1, {s: (a, z) for s, a, z in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(h)])}


ASK = "shard int, block int, hashes binary, several binary"


def _ask(shards: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        h, several, ranges = _own_hashes(_rows(docs), _copies(known), shards) if docs.num_rows else (None, None, {})
        out = [(s, _six(h[a:z]), np.packbits(several[a:z]).tobytes()) for s, (a, z) in ranges.items()]
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()),
                         "hashes": pa.array([x[1] for x in out], pa.binary()), "several": pa.array([x[2] for x in out], pa.binary())})

    return run


def _shared(asked: pa.Table) -> pa.Table:
    """Per block and shard, which of the asked anchors stand in more than one document."""
    lists = [_from_six(x) for x in asked.column("hashes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8))[:len(h)].astype(bool) for x, h in zip(asked.column("several").to_pylist(), lists)]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[h[s] for h, s in zip(lists, several)]]))
    bits = []
    for h in lists:
        at = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
        bits.append(np.packbits(twice[at] == h if len(twice) else np.zeros(len(h), bool)).tobytes())
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "bits": pa.array(bits, pa.binary())})


CONTEXTS = "bucket int, block int, row binary, doc binary, at binary, shape binary, bytes binary, done binary"
MARK = np.dtype([("row", "<i4"), ("at", "<i4"), ("windows", "<u4")])  # windows: a bit per start, from `at` on


def _contexts(shards: int, buckets: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.int32() if k < 2 else pa.binary()) for k, n in enumerate("bucket block row doc at shape bytes done".split())])
        if not docs.num_rows:
            return schema.empty_table()
        rows = _rows(docs)
        copied = _copies(known)
        h, _, ranges = _own_hashes(rows, copied, shards)
        answers = known.filter(known.column("bits").is_valid())
        good = [h[(r := ranges[s])[0]:r[1]][np.unpackbits(np.frombuffer(b, np.uint8))[:r[1] - r[0]].astype(bool)] for s, b in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist())]
        good = np.sort(np.concatenate(good)) if good else np.empty(0, np.uint64)
        out: dict[int, tuple] = {}
        first_of: dict[bytes, int] = {}
        done = []
        for r, (doc, data) in enumerate(rows):
            if not len(good) or copied(doc, data):
                continue
            lo, hi, at, hs = anchors(data)
            if not len(hs):
                continue
            for k in np.flatnonzero(good[np.minimum(np.searchsorted(good, hs), len(good) - 1)] == hs).tolist():
                a, z = int(lo[k]), int(hi[k])
                text = data[a:z + LENGTH]
                earlier = first_of.setdefault(text, doc)
                if earlier < doc:  # rows come by doc_id: this context is covered inside the block
                    done.append((r, a, (1 << (z - a + 1)) - 1))
                    continue
                box = out.setdefault(int(hs[k]) % buckets, ([], [], [], [], []))
                box[0].append(r)
                box[1].append(doc)
                box[2].append(a)
                box[3].append((int(at[k]) - a, z - a + 1))
                box[4].append(text)
        block = docs.column("block")[0].as_py()
        table = [(b, block, np.array(x[0], "<i4").tobytes(), np.array(x[1], "<i8").tobytes(), np.array(x[2], "<i4").tobytes(), np.array(x[3], np.uint8).tobytes(), b"".join(x[4]), b"") for b, x in out.items()]
        if done:  # what is settled here goes through any bucket to the last step
            table.append((block % buckets, block, b"", b"", b"", b"", b"", np.array(done, MARK).tobytes()))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*table), schema)], schema=schema) if table else schema.empty_table()

    return run


def window_classes(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the 50-byte strings at `start`; their order and, along it, where a string differs from the one before.

    Strings that are equal must start at positions of one residue modulo 7. First by the 8 leading bytes; ties by the rank of
    the 42 bytes at the next sample position (at most 3 on), and last by the 8 ending bytes, which closes the gap to 50.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + 50]).view(">u8").ravel().astype(np.uint64)
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 64, np.int64)
    rank[sample] = np.unique(eight[sample] >> np.uint64(8), return_inverse=True)[1] + 1  # 7 bytes
    for step in (7, 14, 14):  # 14, 28, 42 bytes: steps of whole periods lead from sample to sample
        rank[sample] = np.unique((rank[sample] << 32) | rank[sample + step], return_inverse=True)[1] + 1
    lead, tail = eight[start], eight[start + LENGTH - 8]
    residue = start % PERIOD
    tie = rank[start + SHIFT[residue]] * PERIOD + residue
    order = np.lexsort((tail, tie, lead))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (lead[a] != lead[b]) | (tie[a] != tie[b]) | (tail[a] != tail[b])
    return order, new


def _sort_bucket(group: pa.Table) -> pa.Table:
    """Marks of the bucket's suffixes that an earlier document has."""
    block, row, doc, at, shape, kind = [], [], [], [], [], []
    out: dict[int, list] = {}
    kinds: dict[bytes, int] = {}  # equal contexts are one
    columns = [group.column(c) for c in ("block", "row", "doc", "at", "shape", "bytes", "done")]
    for k in range(group.num_rows):  # one row's bytes at a time are copied
        b, *raw = (c[k].as_py() for c in columns)
        if raw[5]:
            out.setdefault(b, []).append(np.frombuffer(raw[5], MARK))
        r = np.frombuffer(raw[0], "<i4")
        if not len(r):
            continue
        s = np.frombuffer(raw[3], np.uint8).reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(s[:, 1] + LENGTH - 1)
        kind.append(np.array([kinds.setdefault(raw[4][x:y], len(kinds)) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]))
        block.append(np.full(len(r), b))
        row.append(r)
        doc.append(np.frombuffer(raw[1], "<i8"))
        at.append(np.frombuffer(raw[2], "<i4"))
        shape.append(s)
    marks = []
    if kinds:
        block, row, doc, at, kind = (np.concatenate(x) for x in (block, row, doc, at, kind))
        shape = np.concatenate(shape)
        windows = np.zeros(len(kind), np.uint32)
        # Contexts of later documents are covered as a whole.
        first = np.full(len(kinds), NO_ID)
        np.minimum.at(first, kind, doc)
        full = ((np.uint64(1) << shape[:, 1].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        windows[doc > first[kind]] = full[doc > first[kind]]
        _, some = np.unique(kind, return_index=True)  # a context of each kind, by kind
        texts = list(kinds)
        off, width = shape[some, 0], shape[some, 1]
        # One suffix bucket at a time: kinds of one anchor stay together, and a bucket holds about SLICE bytes.
        total = int((width + LENGTH + 6).sum())
        slices = -(-total // SLICE)
        name = np.array([int.from_bytes(t[o + 8:o + 16], "big") % 1_000_003 for t, o in zip(texts, off.tolist())]) % slices if slices > 1 else np.zeros(len(texts), np.int64)
        order = np.argsort(name, kind="stable")
        bits = np.zeros(len(texts), np.uint32)
        for part in np.split(order, np.flatnonzero(np.diff(name[order])) + 1):
            size = width[part] + LENGTH - 1
            # Each context begins so that its anchor stands at a multiple of 7.
            begin, pos = np.zeros(len(part), np.int64), 0
            for j, (o, s) in enumerate(zip(off[part].tolist(), size.tolist())):
                pos += (-(pos + o)) % PERIOD
                begin[j] = pos
                pos += s
            board = np.zeros(pos, np.uint8)
            for j, k in enumerate(part.tolist()):
                t = texts[k]
                board[begin[j]:begin[j] + len(t)] = np.frombuffer(t, np.uint8)
            owner = np.repeat(np.arange(len(part)), width[part])
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(width[part]) - width[part], width[part])
            srt, new = window_classes(board, begin[owner] + inner)
            d = first[part][owner[srt]]
            group_at = np.flatnonzero(new)
            least = np.minimum.reduceat(d, group_at)[np.cumsum(new) - 1]
            hit = srt[d > least]
            np.bitwise_or.at(bits, part[owner[hit]], np.uint32(1) << inner[hit].astype(np.uint32))
        windows |= np.where(doc == first[kind], bits[kind], 0).astype(np.uint32)
        keep = np.flatnonzero(windows)
        for b in np.unique(block[keep]):
            k = keep[block[keep] == b]
            m = np.zeros(len(k), MARK)
            m["row"], m["at"], m["windows"] = row[k], at[k], windows[k]
            out.setdefault(int(b), []).append(m)
    marks = [(b, np.concatenate(m).tobytes()) for b, m in out.items()]
    return pa.table({"block": pa.array([x[0] for x in marks], pa.int32()), "marks": pa.array([x[1] for x in marks], pa.binary())})


def _removals(docs: pa.Table, known: pa.Table):
    """For each row of the block: (doc_id or NO_ID, bytes, mask of removed bytes)."""
    rows = _rows(docs)
    copied = _copies(known)
    raw = [np.frombuffer(x, MARK) for x in known.column("marks").drop_null().to_pylist()]
    marks = np.concatenate(raw) if raw else np.zeros(0, MARK)
    marks = marks[np.argsort(marks["row"], kind="stable")]
    ends = np.searchsorted(marks["row"], np.arange(len(rows) + 1))
    for r, (doc, data) in enumerate(rows):
        mask = np.zeros(len(data), bool)
        if copied(doc, data):
            mask[:] = len(data) >= LENGTH
        elif ends[r + 1] > ends[r]:
            mine = marks[ends[r]:ends[r + 1]]
            step = np.zeros(len(data) + 1, np.int64)
            for bit in range(SPAN):
                x = mine["at"][(mine["windows"] >> np.uint32(bit)) & np.uint32(1) > 0].astype(np.int64) + bit
                np.add.at(step, x, 1)
                np.add.at(step, x + LENGTH, -1)
            mask = np.cumsum(step[:-1]) > 0
        yield doc, data, mask


def _dealt(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows dealt to blocks; (copy, sha, block) of rows whose whole text an earlier row has; total bytes."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    size = size or 0
    blocks = max(8, -(-size // BLOCK_BYTES))
    # With the text in the hash, rows without an id and rows of one id spread over the blocks.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(*columns, block).repartition(blocks, "block")
    sums = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("copy"), F.unhex(F.sha2("text", 256)).alias("sha"), block)
    sums = cut(sums)
    first = cut(sums.groupBy("sha").agg(F.min("copy").alias("first"), F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") > max(1000, rows // 1000)  # at most a thousand texts have so many copies
    few = F.broadcast(first.where(hot).select("sha", "first"))
    copies = sums.join(few, "sha").unionByName(sums.join(few, "sha", "left_anti").join(first.where(~hot).select("sha", "first"), "sha"))
    return dealt, copies.where("copy > first").select("copy", "sha", "block"), size


def _marked(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to blocks, and what each block knows of its rows: marks and whole copies."""
    dealt, copies, size = _dealt(docs, columns)
    copies = cut(copies.select("copy", "sha", "block").distinct())
    shards = max(16, int(size * 2 / (SPAN + 1) / SHARD_ANCHORS) + 1)
    # All three steps read the same columns, so that they share one shuffle of the texts.
    asked = dealt.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(lean(_ask(shards)), ASK)
    answers = asked.groupBy("shard").applyInArrow(lean(_shared), "block int, shard int, bits binary")
    known = answers.unionByName(copies, allowMissingColumns=True)
    contexts = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean(_contexts(shards, shards * 2)), CONTEXTS)
    marks = contexts.groupBy("bucket").applyInArrow(lean(_sort_bucket), "block int, marks binary")
    return dealt, marks.unionByName(copies, allowMissingColumns=True)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`."""
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for doc, data, mask in _removals(block, known):
            spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if spans else data
            out.append((None if doc == NO_ID else doc, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dealt, known = _marked(docs, ["doc_id", "text"])
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def trimmed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the removed bytes taken out of `text`; bytes of a character cut in two go with it.

    A row whose whole text was removed is dropped; a row that was empty before stays.
    """
    columns = ["doc_id", "text", "rest"]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # All further columns travel as one, so that none can have the name of a helper column.
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest") if others else F.lit(None).cast("int").alias("rest"))

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        keep: dict[tuple, str] = {}
        gone = set()
        for doc, data, mask in _removals(block, known):
            if mask.any():
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
                keep[doc, data] = kept
                if not kept.strip():
                    gone.add((doc, data))
        keys = [(NO_ID if i is None else i, (t or "").encode("utf-8")) for i, t in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist())]
        text = pa.array([keep.get(k, t) for k, t in zip(keys, block.column("text").to_pylist())], block.schema.field("text").type)
        block = block.set_column(block.schema.get_field_index("text"), block.schema.field("text"), text)
        return block.filter(pa.array([k not in gone for k in keys], pa.bool_())).select(columns)

    dealt, known = _marked(packed, columns)
    out = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean(run), packed.schema)
    return out.select(*[F.col(c) if c not in others else F.col("rest").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return removed(docs)
