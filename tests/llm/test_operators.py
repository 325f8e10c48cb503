"""Training-data operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import html_extract, kneser_ney, langid, license_scan, mixing, piece_bpe, quality_rules, simhash, sketch, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, block int"
WORDS = "the of and cement plant north robot hall kiln grew in a with some steel rail coast town idle fast".split()


def rows(n=60, seed=1):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 120)))
    shared = line()
    texts = [line() + ("\n" + shared if r.random() < 0.3 else "") for _ in range(n)]
    out = [(i * 3, t, r.choice(["en", "de"]), r.choice(["a", "a", "b", None]), len(t), "clash", 1) for i, t in enumerate(texts)]
    out += [(1000 + i, texts[i % 5], "en", "a", 0, None, 2) for i in range(9)]  # exact copies
    out += [(2000, texts[7][:-3] + "xyz", "en", "b", 0, None, None), (2001, "", "en", "b", 0, None, None), (2002, None, None, None, None, None, None), (2003, " \n", "en", "a", 1, None, None)]
    out += [(3000, "Ünï cödé " * 40, "de", "a", 0, None, None), (3001, "x" * 20_000, "en", "c", 0, None, None), (0, texts[0], "en", "a", 0, "clash", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_equals_brute_force(docs):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0

    data = [(r[0], fp(r[1])) for r in rows()]
    comp = {i: i for i, _ in data}
    for _ in data:
        for i, a in data:
            for j, b in data:
                if (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(comp[i] == comp[j] for i, a in data for j, b in data if (a ^ b).bit_count() <= 2):
            break
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(docs).collect()}
    assert got == {(i, f"{a:016x}", comp[i]) for i, a in data}


def test_trie_links_and_cell_expansion(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64) for _ in range(3)]
    fps = np.unique(np.concatenate([base, base[:40] ^ flips[0], base[:40] ^ flips[0] ^ flips[1], base[:40] ^ flips[0] ^ flips[1] ^ flips[2]]))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    whole = [np.array([x]) for x in (0, len(fps), 0, len(fps), 0)]
    found = list(simhash.walk(fps, whole, 63, 2, room=7))
    assert {(min(x), max(x)) for i, j in found for x in zip(i.tolist(), j.tolist())} == want
    two = np.repeat(fps, 2)  # equal fingerprints of different texts; pairs of one root are left out
    root = np.arange(len(two)) // 2 % 5
    pairs = [x for i, j in simhash.walk(two, [np.array([x]) for x in (0, len(two), 0, len(two), 0)], 63, 2, root, room=7) for x in zip(i.tolist(), j.tolist())]
    assert sorted(pairs) == sorted({(i, j) for i in range(len(two)) for j in range(i + 1, len(two)) if int(two[i] ^ two[j]).bit_count() <= 2 and root[i] != root[j]})
    nodes = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")
    roots = {x.node: x.root for x in simhash.components(simhash.links(nodes, 2, cell_rows=20)).collect()}
    label, group = simhash.star_forest(len(fps), *(np.array(x) for x in zip(*want))), {}
    for f, k in zip(fps.view(np.int64).tolist(), label.tolist()):
        group.setdefault(k, []).append(f)
    assert roots == {f: min(g) for g in group.values() for f in g if f != min(g)}


def test_simhash_links_lead_through_rows_without_id(spark):
    base = [f"w{i}" for i in range(300)]
    near = lambda a, b: (a ^ b).bit_count() <= 2
    every = [(" ".join(base[:k])) for k in range(250, 300)]
    marks = [simhash.fingerprint(t) for t in every]
    i, j, k = next((i, j, k) for i in range(50) for j in range(i + 1, 50) for k in range(j + 1, 50) if near(marks[i], marks[j]) and near(marks[j], marks[k]) and not near(marks[i], marks[k]))
    texts, f = [every[x] for x in (i, j, k)], [marks[x] for x in (i, j, k)]
    rows = [(1, texts[0]), (None, texts[1]), (5, texts[2]), (None, "quite another text")]
    got = simhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.fingerprint in {f"{x:016x}" for x in f}) == [(0, 1), (1, 1), (5, 1)]
    assert [r.component_id for r in got if r.fingerprint not in {f"{x:016x}" for x in f}] == [None]


def test_suffix_dedup_equals_brute_force(docs):
    data = sorted((r[0], (r[1] or "").encode()) for r in rows())
    first = {}
    for i, b in data:
        for x in range(len(b) - 49):
            first.setdefault(b[x:x + 50], i)
    want = set()
    for i, b in data:
        mask = [False] * len(b)
        for x in range(len(b) - 49):
            if first[b[x:x + 50]] < i:
                mask[x:x + 50] = [True] * 50
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        want.add((i, len(b), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(b, mask) if not m)).hexdigest()))
    assert {tuple(r) for r in suffix_dedup.query(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want


def test_window_classes_sort():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 7 * 300, dtype=np.uint8)
    text[700:1400] = text[:700]
    start = np.arange(0, 2000, 7)
    order, new = suffix_dedup.window_classes(text, start)
    keys = [text[s:s + 50].tobytes() for s in start[order]]
    assert [k != keys[i - 1] if i else True for i, k in enumerate(keys)] == new.tolist() and len(set(keys)) == new.sum()


def test_piece_encoding_equals_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    want = {(r[0], len(ids := sp.encode(r[1] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for r in rows()}
    assert {tuple(r) for r in piece_bpe.query(docs).collect()} == want
    e = piece_bpe.encoder(piece_bpe.default_model())
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice(["  ", "a", "the", "\n", "▁", "é", "梦", "🙂", "\x00", "  " * 9, "ing", "X"]) for _ in range(r.randint(0, 30)))
        assert e.encode(t) == sp.encode(t)


def test_language_id(spark, docs, empty):
    text = {"en": "the plant in the north was built with some of the steel and then it grew", "de": "das werk im norden wurde mit dem stahl gebaut und dann ist es gewachsen"}
    r = random.Random(1)
    make = lambda k: " ".join(r.sample(text[k].split(), 8))
    df = spark.createDataFrame([(i, make(k), k) for i in range(200) for k in ["en" if i % 2 else "de"]] + [(900, None, "en"), (901, "123 !!", "en")], "doc_id long, text string, lang string")
    got = langid.query(df).join(df, "doc_id").collect()
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum(x.lang_pred == x.lang for x in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in got)
    assert {x.doc_id: x.lang_pred for x in got if x.doc_id >= 900} == {900: "und", 901: "und"}
    parser = langid.CrossParser.of({"x": ["abcab"]})
    assert parser.phrases(["abcabc", "zz", ""])[:, 0].tolist() == [2, 2, 0]
    assert langid.query(empty).count() == 0 and langid.query(docs).count() == docs.count()


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.query(docs).collect()}
    for i, t, *_ in rows():
        w = (t or "").encode().split()
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        again = {p for k, x in enumerate(tri) if tri.count(x) > 1 for p in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(again))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (got[i].base_failed and got[i].kept)
    assert any(r.kept for r in got.values()) and quality_rules.query(empty).count() == 0
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_html(spark):
    page = ('<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One  two<br>three<p>Short.'
            '<div class="comments"><p>I liked the article a lot</p></div></article><aside>side</aside><script>var a="<p>x</p>";</script><footer>foot</footer></body></html>')
    assert html_extract.extract(page) == "Head & line\n\nOne two three\n\nShort."
    assert html_extract.second_pass(["good", "unclear", "bad", "unclear", "unclear"]) == ["good", "good", "bad", "bad", "bad"]
    got = html_extract.query(spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", page)], "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in sorted(got)] == [0, 0, len(html_extract.extract(page))]


def test_licences(docs, empty):
    s = license_scan.scan("Released under the MIT License. Licensed under the Apache License, Version 2.0")
    assert (s["n_base"], s["first_word"], s["last_word"], s["base_labels"]) == (2, 3, 8, "apache,mit") and "apache-2.0" in s["labels"]
    assert license_scan.scan("GNU General\nPublic  LICENSE")["base_labels"] == "gpl" and license_scan.scan(None)["labels"] == ""
    assert len(license_scan.rules()) > 300 and license_scan.query(empty).count() == 0 and license_scan.query(docs).count() == docs.count()


def test_sketch_edits_and_likeness(docs, empty):
    data = sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: x[0])
    once = [d for k, d in enumerate(data) if k == 0 or d != data[k - 1]]
    got = {r.doc_id: r for r in sketch.query(docs.dropDuplicates(["doc_id"])).collect()}

    def grams(t):
        w = [x for x in t.lower().translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    for k, (i, t) in enumerate(once):
        m, nxt = len(t) // 4, once[(k + 1) % len(once)][1]
        edited = t[:len(t) - m] + nxt[:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = grams(t), grams(edited)
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-9 if len(a | b) <= sketch.K else 0.15)
    assert sketch.query(empty).count() == 0


def test_sketch_ranges(spark):
    df = spark.range(0, 500, 1, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = sketch.with_next(df, ["doc_id", "text"], {"n": "text"}, rows_per_range=30).collect()
    assert {r.doc_id: r.n for r in got} == {i: f"t{(i + 1) % 500}" for i in range(500)}


def test_merge_of_sketches(spark):
    df = spark.createDataFrame([("a b c d e f g", "d e f g h i j")], "x string, y string")
    u = df.select(sketch.merge(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))).alias("m"), sketch.containment(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))).alias("c")).first()
    assert len(u.m) == 6 and u.c == 0.0


def test_mixing(docs, empty):
    got = mixing.query(docs).collect()
    size = {}
    for _, t, _, s, *_ in rows():
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    total = sum(size.values())
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    for s, w in weight.items():
        assert used[s] <= w * total * 1.001 + 1 and used[s] > w * total - max(len((r[1] or "").split()) for r in rows()) - 1
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in rows() if r[3] is not None}
    assert mixing.query(empty).count() == 0


def test_kneser_ney(spark, docs, empty):
    n4 = np.random.default_rng(1).integers(0, 4, kneser_ney.LOW)
    model = kneser_ney.Model(n4, np.zeros(kneser_ney.LOW), np.zeros((kneser_ney.LOW, 3)), [3, 2, 1, 1])
    assert np.allclose(model.order4(np.arange(kneser_ney.LOW)).reshape(-1, 32).sum(axis=1), 1)
    good = "the plant in the north was built with some of the steel and then it grew "
    r = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(r.sample(good.split(), 12)), "en") for i in range(60)] + [(90, "QZX JKV!! WQ#" * 9, "en"), (91, None, "en"), (92, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {x.doc_id: x for x in kneser_ney.query(df, labels).collect()}
    assert sum(got[i].kept for i in range(60)) >= 55 and not any(got[i].kept for i in (90, 91, 92)) and got[91].perplexity is None
    assert kneser_ney.query(empty, labels).count() == 0
