"""Near copies of the pipeline's second stage against all pairs."""

import random
import uuid

import numpy as np

import corpus_pipeline
from gleaner.llm import near_copies


def jaccard(a, b):
    def of(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_stage_finds_all_pairs_at_similarity(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(30)]
    texts = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randint(3, 200))] + (common if r.random() < 0.5 else [])
        texts.append(base)
        for _ in range(r.randint(0, 4)):  # copies of copies, so that components are chains too
            copy = list(texts[-1])
            for _ in range(r.randint(1, 1 + len(copy) // 60)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy)
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, "two words"), (901, "Two  words"), (902, "two other"), (None, "two words"), (903, "")]
    root = {i: i for i, _ in rows if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i, a in rows for j, b in rows if i is not None and j is not None and i < j and jaccard(a, b) >= 0.8]
    assert sum(0.8 <= jaccard(rows[i][1], rows[j][1]) < 0.95 for i, j in pairs if j < 900) > 40
    for i, j in pairs:
        x, y = sorted((top(i), top(j)))
        root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {a.doc_id: a.component_id for a in near_copies.grouped(docs).collect() if a.doc_id is not None}
    assert got == {i: top(i) for i in root}
    kept = sorted(a.doc_id for a in corpus_pipeline.near_dedup(spark, docs, "").where("doc_id is not null").collect())
    assert kept == sorted(i for i in root if top(i) == i)


def test_one_changed_word_is_a_near_copy(spark):
    text = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:40], "x", *text[41:]]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    """Ids of several texts, repeated rows and rows without ids: exactly one row of each component stays, and no unique text is lost."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(25)]
    near = lambda t: " ".join([*t[:30], "other", *t[31:]])
    rows = [(3, " ".join(base[0])), (5, near(base[0])), (5, " ".join(base[1])), (6, " ".join(base[2])), (6, " ".join(base[2])), (7, " ".join(base[3])), (7, near(base[3])),
            (None, " ".join(base[4])), (None, " ".join(base[4])), (None, near(base[4])), (None, " ".join(base[0])), (9, near(base[1])), (9, near(base[2])), (8, ""), (8, None), (None, " "), (None, "alone here")]
    rows += [(r.choice([20, 21, 22, 23, None]), r.choice([" ".join(b), near(b)])) for b in base[5:] for _ in range(r.randint(1, 4))]
    keys = [(i is None, i or 0) for i, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                x, y = root[i], root[j]
                root = [y if z == x else z for z in root]
    least = {}
    for k, c in zip(keys, root):
        least[c] = min(least.get(c, k), k)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, at string").repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((a.doc_id is None, a.doc_id or 0) for a in got) == sorted(least.values())
    texts = {}
    for a in got:
        owner = {root[k] for k, x in enumerate(rows) if x == (a.doc_id, a.text)}
        assert len(owner) == 1 and owner.isdisjoint(texts)
        texts |= dict.fromkeys(owner)
    assert len(texts) == len(least)


def test_walks_give_rows_that_grow_with_the_texts(spark, monkeypatch, tmp_path):
    """Texts that have one passage in common that the sample misses, and a chain of edited copies: no walk gives a pair for each two of them."""
    lean = near_copies.lean

    def counted(f):
        g = lean(f)

        def run(group):
            out = g(group)
            (tmp_path / uuid.uuid4().hex).write_text(str(out.num_rows))
            return out

        return run

    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    monkeypatch.setattr(near_copies, "_common", lambda docs: none)
    monkeypatch.setattr(near_copies, "lean", counted)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(100_000)}"
    passage = [word() for _ in range(14)]
    texts = [passage + [word() for _ in range(24)] for _ in range(700)]
    copy = [word() for _ in range(140)]
    for _ in range(100):
        copy = list(copy)
        copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {a.doc_id: a.component_id for a in near_copies.grouped(docs).collect()}
    assert got == {i: min(i, 700) for i in range(len(texts))}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 2 * len(texts)


def test_spanning_forest_joins_all_components_by_the_closest_pairs():
    r = np.random.default_rng(2)
    u, v, d = r.integers(0, 300, 4000), r.integers(300, 600, 4000), r.integers(0, 56, 4000)
    pairs = np.stack([u, v, u // 3, v // 3, d])
    label, weight = {x: x for x in range(200)}, 0  # one pair after the other, closest first
    for a, b, bits in sorted(zip(pairs[2], pairs[3], d), key=lambda x: x[2]):
        if label[a] != label[b]:
            label, weight = {x: label[b] if y == label[a] else y for x, y in label.items()}, weight + bits
    got = near_copies.spanning(pairs)
    assert got.shape[1] == 200 - len(set(label.values())) and got[4].sum() == weight
