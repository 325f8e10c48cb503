"""Operators 11 to 13 against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import embedding_join, periodic_runs, spelling

WORDS = "the of and cement plant north robot hall kiln grew in a with some steel rail coast town idle fast".split()
DOCS = "doc_id long, text string, runs string, collapsed int, n long"


def all_runs(s, least, exponent):
    found = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in found.items())


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_and_planted_strings(seed):
    r = random.Random(seed)
    for _ in range(150):
        letters, n = r.choice([1, 2, 2, 3, 5]), r.randint(0, 90)
        s = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n else 0):
            a, p = r.randrange(n), r.randint(1, 12)
            for i in range(a + p, min(n, a + p * r.randint(2, 8))):
                s[i] = s[i - p]
        if r.random() < 0.3:
            s = s[:40] + s[5:30] + s[:40] + s  # copies of runs inside factors
        least, exponent = r.choice([(24, 3), (6, 3), (3, 3), (4, 2), (8, 2), (12, 3), (2, 2)])
        assert sorted(periodic_runs.word_runs(s, least, exponent)) == all_runs(s, least, exponent)


def test_factors_are_longest_earlier_strings():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(3) for _ in range(r.randint(1, 40))]
        parts = periodic_runs.factors(s)
        for (b, earlier), end in zip(parts, [b for b, _ in parts[1:]] + [len(s)]):
            starts = lambda n: [i for i in range(b) if s[i:i + n] == s[b:b + n]]
            assert (earlier < 0 and end == b + 1 and not starts(1)) or (s[earlier:earlier + end - b] == s[b:end] and earlier < b)
            assert end == len(s) or not starts(end - b + 1)


def documents():
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    out = [(i, text(r.randint(1, 200)), "clash", 1, None) for i in range(80)]
    out += [(100, "ab\tc " * 30 + "x " + "a b c " * 9, None, 2, 5), (101, "a " * 5000, None, None, 1), (101, "a " * 5000, None, None, 1), (101, text(40) + " q r" * 40 + " z", None, None, 1), (102, "", None, None, None), (103, None, None, None, None)]
    out += [(None, "k l m " * 12, None, None, None), (None, None, None, None, None), (104, "one\x0btwo\x0cthree four " * 25, None, None, 1), (105, text(30) + "\n" + "p " * 24 + text(9) + " u v w" * 10, None, 1, 1)]
    return out


def test_periodic_runs_query(spark):
    def expected(i, t):
        words = re.findall("[^\x20\x09-\x0D]+", t or "")
        h = crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = all_runs(words, 24, 3)
        drop = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))

    data = documents()
    got = [tuple(x) for x in periodic_runs.query(spark.createDataFrame(data, DOCS).repartition(3)).collect()]
    assert Counter(got) == Counter(expected(x[0], x[1]) for x in data)
    assert sum(x[1] > 0 for x in got) >= 10 and any(crc32(str(x[0]).encode()) % 10 == 0 for x in data)


def test_repeats_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    assert periodic_runs.repeats(docs).columns == ["doc_id", "text", "n", "runs", "collapsed"]
    assert periodic_runs.query(docs.where("false")).collect() == []


def vectors(seed=5):
    r = np.random.default_rng(seed)
    base = r.standard_normal((260, 24))
    near = [b + r.standard_normal(24) * s for b in base[:40] for s in (0.1, 0.2, 0.25)]
    hot = [base[50] * 3 + r.standard_normal(24) * 0.05 for _ in range(150)]  # a third of all lie close together
    out = [(int(i), [float(x) for x in v]) for i, v in enumerate([*base, *near, *hot])]
    out += [(1000 + i, out[3][1]) for i in range(9)] + [(1009, [2 * x for x in out[3][1]]), (1010, out[3][1]), (1010, out[4][1])]
    out += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [float("inf")] * 24), (2006, [1.0]), (2007, [2.0]), (2008, [-1.0]), (2009, [1e300, 1e300]), (2010, [1e-300, 1e-300])]
    return out + [(None, out[5][1]), (None, out[5][1]), (None, None)]


@pytest.mark.parametrize("leaf,tile", [(4000, 8000), (40, 30)])
def test_embedding_join_equals_brute_force(spark, leaf, tile):
    data = vectors()
    rows = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v) / max(map(abs, v)) for _, v in data]
    units = [None if v is None else v / np.linalg.norm(v) for v in rows]
    linked = [[j for j, b in enumerate(units) if j != i and b is not None and len(a) == len(b) and a @ b >= 0.95] if a is not None else [] for i, a in enumerate(units)]
    want = Counter()
    for i, (vec, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        comp = min(ids) if ids else None
        want[(vec, len(linked[i]), comp, vec is not None and vec == comp)] += 1
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("cls", F.lit("x")).repartition(5)
    got = Counter(tuple(x) for x in embedding_join.near_copies(df, leaf=leaf, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(n > 0 for _, n, _, _ in want) > 200


def test_leaves_reach_all_pairs_within_the_limit():
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 3))
    axis, place = embedding_join.tree(x, 4, 0.3)
    row, leaf, home = embedding_join.leaves(x, axis, place, 0.09)
    assert home.sum() == 600 and np.isfinite(place).sum() > 8
    seats, own = {}, {}
    for a, b, h in zip(row.tolist(), leaf.tolist(), home.tolist()):
        seats.setdefault(a, set()).add(b)
        if h:
            own[a] = b
    for i in range(600):
        for j in range(i):
            if ((x[i] - x[j]) ** 2).sum() <= 0.09:
                assert min(own[i], own[j]) in seats[i] & seats[j]


def test_embeddings_of_empty_tables(spark):
    assert embedding_join.query(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(x) for x in embedding_join.query(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        some = sorted((-m, v) for v, m in counts.items() if near(w, v))
        forms[w] = some[0][1] if some and -some[0][0] >= 2 * n else None
        out[w] = (n, len(some))
    rows = set()
    for w, (n, k) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, k, counts[forms[w]] if forms[w] else None))
    return rows


def words_of(data):
    counts = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_query(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeinrst") for _ in range(r.randint(4, 7))) for _ in range(150)] + ["tasten", "satten", "netsat", "ÀÉÎÕü", "Àéîõü", "aaaaaa", "aaaaa", "aaaaab", "baaaaa", "letter", "leter", "lettter", "lettar"]
    long = "".join(r.choice("abcdefgh") for _ in range(230))
    vocabulary += [long, long[:100] + "x" + long[101:], long[:100] + long[101:], long + "y", "z" * 260, "z" * 259, long[:200], long[:201]]
    weights = [r.choice([1, 1, 2, 4, 30]) for _ in vocabulary]
    data = [(r.choice([i, i, None]), " ".join(r.choices(vocabulary, weights, k=200)) + ".1" + "Letter,LETTER") for i in range(60)] + [(1, None), (1, ""), (2, "×÷ß" * 3), (2, "×÷ß" * 3), (2, "×÷ß" * 3), (None, "12 3")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, word string").repartition(4)
    want = expected_variants(words_of(data))
    got = [tuple(x) for x in spelling.query(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(x[1] is not None for x in want) > 10 and any(x[1] and x[2] != x[1] for x in want)


def test_spelling_chains_of_hot_anagrams(spark):
    r = random.Random(2)
    many = {"".join(r.sample("abcdefg", 7)): r.randint(3, 400) for _ in range(400)}  # one key for all
    many |= {w[:-1] + r.choice("ghx"): r.randint(3, 3000) for w in list(many)[:200]}
    got = spelling.variants(spark.createDataFrame(list(many.items()), "word string, n long"))
    assert {tuple(x) for x in got.collect()} == expected_variants(many)


def test_spelling_of_empty_tables(spark):
    assert spelling.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_of_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 10)
    data = [(1, "cement plants in the north " * 40), (2, "northern")]
    got = spelling.word_counts(spark.createDataFrame(data, "doc_id long, text string"), spelling.worn)
    assert {x.word: x.n for x in got.collect()} == words_of(data)
