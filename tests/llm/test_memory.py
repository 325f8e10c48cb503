"""What a step holds in memory at a time, beyond its rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gleaner.llm import suffix_dedup


def _bucket(texts: list[tuple[int, str]]) -> pa.Table:
    """The contexts of one bucket, with all anchors of the texts shared."""
    rows = [(k % 8, [x for x in texts if x[0] % 8 == k]) for k in range(8)]
    out = []
    for block, mine in rows:
        docs = pa.table({"doc_id": pa.array([i for i, _ in mine], pa.int64()), "text": [t for _, t in mine], "block": pa.array([block] * len(mine), pa.int32())})
        h = np.unique(np.concatenate([suffix_dedup.anchors(t.encode())[3] for _, t in mine]))
        known = pa.table({"copy": pa.array([None], pa.int64()), "sha": pa.array([None], pa.binary()), "shard": pa.array([0], pa.int32()), "bits": [np.packbits(np.ones(len(h), bool)).tobytes()]})
        out.append(suffix_dedup._contexts(1, 1)(docs, known))
    return pa.concat_tables(out)


def test_a_bucket_is_sorted_in_little_memory(monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(3000)]
    passages = [" ".join(r.choices(words, k=40)) for _ in range(40)]
    group = _bucket([(i, " ".join([*r.choices(words, k=400), r.choice(passages)])) for i in range(700)])
    tracemalloc.start()
    marks = suffix_dedup._sort_bucket(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert group.nbytes > 4_000_000 and peak < 10 * group.nbytes
    of = lambda t: {b: sorted(np.concatenate([np.frombuffer(m, suffix_dedup.MARK) for b2, m in zip(t.column("block").to_pylist(), t.column("marks").to_pylist()) if b2 == b]).tolist()) for b in t.column("block").to_pylist()}
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 40)
    assert len(of(marks)) == 8 and of(suffix_dedup._sort_bucket(group)) == of(marks)
