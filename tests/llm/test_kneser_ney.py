"""The quality classifier against an interpolated modified Kneser-Ney model in plain Python."""

import random

import pytest

from gleaner.llm import kneser_ney as kn

ORDER = 5


def symbols(text):
    return [26] * (ORDER - 1) + [int(kn._classes()[ord(c)]) for c in text]


def counted(texts):
    """Counts of 5-grams, and for orders 4 to 1 the numbers of distinct symbols in front of each gram."""
    top = {}
    for t in texts:
        s = symbols(t)
        for k in range(len(s) - ORDER + 1):
            g = tuple(s[k:k + ORDER])
            top[g] = top.get(g, 0) + 1
    tables = [top]
    for _ in range(4):
        last, below = tables[-1], {}
        for g in last:
            below[g[1:]] = below.get(g[1:], 0) + 1
        tables.append(below)
    return tables


def discounts_of(tables):
    out = []
    for t in tables:
        n = [sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]
        out.append([float(x) for x in kn.discounts(n)])
    return out


def brute_perplexity(text, tables, discounts):
    def p(gram, level):
        if level == ORDER:
            return 1 / 32
        table, d = tables[level], discounts[level]
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        below = p(gram[1:], level + 1)
        if not total:
            return below
        c = table.get(gram, 0)
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in same.values()) / total * below

    import math

    s, known = symbols(text), {}
    bits = 0.0
    for k in range(len(s) - ORDER + 1):
        g = tuple(s[k:k + ORDER])
        if g not in known:
            known[g] = -math.log2(p(g, 0))
        bits += known[g]
    return 2 ** (bits / (len(s) - ORDER + 1))


@pytest.mark.parametrize("chunk,block_chars", [(256, 24_000_000), (2, 200)])  # the small sizes pass the chunks of blocks that one task answers
def test_perplexity_equals_brute_force(spark, monkeypatch, chunk, block_chars):
    monkeypatch.setattr(kn, "CHUNK", chunk)
    monkeypatch.setattr(kn, "BLOCK_CHARS", block_chars)
    r = random.Random(5)
    words = "the plant in north was built with some steel, då ГОРОД стоит на реке 漢字 42 of it".split()
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(1, 14))) for i in range(24)}
    texts |= {24: texts[3], 25: "ооо zzz!", 26: "x"}
    trusted = [i for i in range(25) if i % 3]
    docs = spark.createDataFrame([*((i, t, "en") for i, t in texts.items()), (None, texts[1], "en"), (30, None, "en"), (31, "", "en"), (3, texts[3], "en")], "doc_id long, text string, lang string")
    got = kn.perplexities(docs, spark.createDataFrame([(i,) for i in [*trusted, 4, None]], "doc_id long")).collect()
    whole = counted([texts[i] for i in trusted])
    d = discounts_of(whole)
    seen = {x.doc_id: x.perplexity for x in got}
    assert seen[30] is None and seen[31] is None and len(got) == len(texts) + 4
    for i, t in texts.items():
        tables = counted([texts[j] for j in trusted if j != i]) if i in trusted else whole
        assert seen[i] == pytest.approx(brute_perplexity(t, tables, d), rel=2e-4)
    assert seen[None] == pytest.approx(brute_perplexity(texts[1], whole, d), rel=2e-4)


def test_verdict_equals_thresholds_in_python(spark):
    r = random.Random(8)
    good = "the plant in the north was built with some of the steel and then it grew".split()
    rows = [(i, " ".join(r.choice(good) for _ in range(30)), ["en", "de", None][i % 3]) for i in range(60)] + [(70, "qzx jkv!! wq# " * 9, "en"), (71, "qzx jkv", "xx"), (72, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = [i for i in range(60) if i % 4]
    got = {x.doc_id: x for x in kn.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    langs = {i: lang for i, _, lang in rows}

    def limit(ids):
        p = sorted(got[i].perplexity for i in ids)
        return p[max(0, -(-99 * len(p) // 100) - 1)] * 1.1

    for i, x in got.items():
        mine = [j for j in trusted if langs[j] == langs[i]] if langs[i] in ("en", "de") else trusted
        assert x.threshold == pytest.approx(limit(mine)) and x.kept == (x.perplexity is not None and x.perplexity <= x.threshold)
    assert not any(got[i].kept for i in (70, 71, 72))


def test_script_other_than_latin_tells_order_from_noise(spark):
    r = random.Random(2)
    words = ["город", "стоит", "на", "берегу", "реки", "где", "строят", "мосты", "и", "дома"]
    prose = [(i, " ".join(r.choice(words) for _ in range(40)), "ru") for i in range(60)]
    noise = [(100 + i, "".join(r.sample(t, len(t))), "ru") for i, t, _ in prose[:20]]
    docs = spark.createDataFrame(prose + noise, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in kn.classify(docs, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).where("kept").collect()}
    assert len(kept & set(range(40, 60))) >= 18 and not kept & set(range(100, 120))
