"""Quality rules, sketches, language ID, mixing and HTML extraction against plain Python, past their internal sizes."""

import hashlib
import html
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.llm import html_extract, langid, mixing, quality_rules, sketch

SCRIPTS = {"en": "abcdefghijklmnop", "fr": "abcdeéèêçlmnopqr", "ru": "абвгдежзийклмно", "el": "αβγδεζηθικλμνξο", "hi": "कखगघचछजझटठडढणतथ",
           "zh": [chr(0x4E00 + 7 * k) for k in range(300)], "ko": [chr(0xAC00 + 11 * k) for k in range(300)]}


def prose(lang, r, n=30):
    words = random.Random(lang)
    bank = ["".join(words.choice(SCRIPTS[lang]) for _ in range(words.randint(2, 6))) for _ in range(120)]
    return " ".join(r.choice(bank) for _ in range(n))


def test_languages_of_six_scripts_are_told_apart(spark):
    r = random.Random(4)
    rows = [(i, prose(lang, r), lang) for i, lang in enumerate(list(SCRIPTS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [x for x in langid.query(df).join(df.select("doc_id", "lang"), "doc_id").collect() if x.held_out]
    assert len(got) > 60 and sum(x.lang_pred == x.lang for x in got) >= 0.95 * len(got)


def test_many_languages_are_all_learned(spark):
    r = random.Random(6)
    letters = {f"l{k:02}": [chr(0x1E00 + 3 * k + j) for j in range(0, 900, 60)] for k in range(80)}
    text = lambda lang: " ".join("".join(r.choice(letters[lang]) for _ in range(4)) for _ in range(40))
    df = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(list(letters) * 6)], "doc_id long, text string, lang string")
    _, models = langid.learn(df)
    assert len(models) == 80


def test_references_are_whole_texts_within_their_bounds(spark):
    rows = [(i, f"t{i} " * 100, "en") for i in range(40)] + [(100 + i, f"long{i} " * (4000 + i), lang) for i, lang in enumerate(["en", "de", "de"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.references(df, docs_per_language=10, reference_chars=2_000).collect()
    texts = {t for _, t, _ in rows}
    assert all(x.text in texts for x in got) and 5 <= sum(x.lang == "en" for x in got) <= 10 and not any(x.lang == "en" and "long" in x.text for x in got)
    assert [x.text for x in got if x.lang == "de"] == [rows[41][1]] or [x.text for x in got if x.lang == "de"] == [rows[42][1]]  # the shortest that is not held out


def test_letter_digits_are_a_prefix_code():
    codes = [tuple(langid.letter_digits(k)) for k in [*range(0, 3000), *range(31_000, 33_000), 500_000, 1_100_000]]
    assert len(set(codes)) == len(codes) and all(langid.GAP <= d < langid.SYMBOLS for c in codes for d in c)
    every = set(codes)
    assert not any(c[:k] in every for c in codes for k in range(1, len(c)))


def test_quality_verdict_equals_brute_force(spark, monkeypatch):
    r = random.Random(7)
    words = {lang: [f"{lang or 'n'}{random.Random(lang).randint(0, 9)}{k}" for k in range(90)] for lang in ("en", "de", "", None)}
    rows = []
    for i in range(90):
        lang = ["en", "de", "", None, "en"][i % 5]
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(20, 200))) + r.choice(["", ".", "\n#|#"]), lang))
    rows += [(200, "ZZ9 " * 3 + " ".join(f"Q{k}!" for k in range(80)), "en"), (201, None, "en"), (202, "", None), (203, " ".join(f"u{k}" for k in range(60)), "xx"), (204, "a " * 70, "yy"), (5, rows[5][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)

    def hist(t, common):
        low = [quality_rules._CLASS[b] for b in (t or "").encode()]
        c = [sum(x == k for x in low) for k in range(quality_rules.CLASSES)]
        w = (t or "").encode().lower().split()
        return c, [w.count(x) for x in common] + [sum(x not in set(common) for x in w)]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 1.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
        return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))

    fine = [(t, lang) for _, t, lang in rows if not quality_rules.base(t)["base_failed"]]
    refs = {}
    for lang in {x[2] for x in rows}:
        mine = [t for t, x in fine if lang is None or x == lang]
        counts = {}
        for t in mine:
            for w in t.encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
        common = sorted(counts, key=lambda w: (-counts[w], w))[:quality_rules.WORDS]
        parts = [hist(t, common) for t in mine]
        refs[lang] = (common, [sum(x) for x in zip(*[p[0] for p in parts])], [sum(x) for x in zip(*[p[1] for p in parts])]) if mine else None
    for languages in (5_000, 1):  # the second judges each language in a pass of its own
        got = {(x.doc_id, x.kept, round(x.js_chars, 9), round(x.js_words, 9)) for x in quality_rules.judge(df, languages=languages).collect()}
        want = set()
        for i, t, lang in rows:
            b, ref = quality_rules.base(t), refs[lang]
            c, w = (1.0, 1.0)
            if ref and b["n_words"]:
                h = hist(t, ref[0])
                c, w = distance(h[0], ref[1]), distance(h[1], ref[2])
            near = c <= 0.22 + 2 / max(1, len(b["data"])) ** 0.5 and w <= 0.40 + 0.8 / max(1, b["n_words"]) ** 0.5
            want.add((i, near and not b["base_failed"], round(c, 9), round(w, 9)))
        assert got == want and any(x[1] for x in got) and any(not x[1] for x in got)


def grams(t):
    w = [x for x in t.lower().translate({c: 32 for c in range(9, 14)}).split(" ") if x]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_sketch_columns_equal_sets(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 30, 90])))) for i in range(40)]
    rows += [(50, rows[-1][1]), (51, None), (52, "a b c d e " * 9), (53, "x" * 50_000)]
    got = {x.doc_id: x for x in sketch.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        a, b, e = grams(t), grams(nxt), grams(edited)
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_shingles == len(a)
        assert len(a | e) > sketch.K or got[i].near_edited == pytest.approx(like(a, e))
        assert len(a | b) > sketch.K or got[i].near_next == pytest.approx(like(a, b))
        assert got[i].edited_in_text == pytest.approx(len(a & e) / len(e) if e else 1.0)
        assert len(got[i].fingerprint) == 16 * len(a)
    assert got[39].fingerprint == got[50].fingerprint


def test_sketch_estimates_and_merged_groups(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(4000)]
    x, y = " ".join(base[:3000]), " ".join(base[1000:])
    df = spark.createDataFrame([(1, "g", x), (2, "g", y), (3, "h", " ".join(base)), (4, "h", None), (5, None, x)], "doc_id long, g string, text string")
    s = df.select("doc_id", "g", sketch.sketch(F.coalesce("text", F.lit(""))).alias("s")).cache()
    merged = {m.g: m.s for m in sketch.merge_groups(s, "g", "s").collect()}
    every = {m.doc_id: m.s for m in s.collect()}
    assert merged["g"] == sorted(set(every[1]) | set(every[2]))[:sketch.K] == every[3][:0] + merged["g"] and merged["h"] == every[3] and merged[None] == every[1]
    one = spark.createDataFrame([(every[1], every[2], every[3])], "a array<long>, b array<long>, c array<long>")
    e = one.select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("c")).alias("c"), sketch.distinct_shingles(F.col("c")).alias("n")).first()
    assert e.r == pytest.approx(0.5, abs=0.15) and e.c == pytest.approx(1, abs=1e-9) and e.n == pytest.approx(3996, rel=0.3)


def test_ranges_of_rows_grow_past_their_number(spark):
    r = random.Random(2)
    ids = sorted(r.sample(range(10**6), 900)) + [7, 7]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)] + [(None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (3, 10**6):
        got = sketch.with_next(df, ["doc_id", "text"], {"n": "text"}, rows_per_range=size).collect()
        nxt = {x.text: x.n for x in got}
        assert len(got) == len(rows) and len(set(nxt.values())) == len(rows)  # one circle
        order = [x[1] for x in sorted(((i, t) for i, t in rows if i is not None and i != 7))]
        assert all(nxt[a] == b for a, b in zip(order, order[1:]))


def test_mixture_equals_brute_force(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000 + i, None, "empty") for i in range(3)] + [(None, "x y z", "a"), (None, "x y z", "a"), (5, "another text", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for bytes_ in (1 << 20, 64):  # one block, and hundreds
        monkeypatch.setattr(mixing, "BLOCK_BYTES", bytes_)
        for cover, repeat in ((False, 4.0), (True, 2.0)):
            drawn = mixing.draw(df, ["doc_id", "text", "source"], max_repeat=repeat, cover=cover)
            got = drawn.collect()
            octets = sum(len(t or "") for _, t, _ in rows)
            blocks = 1 << max(0, math.ceil(math.log2(octets / bytes_)))
            keyed = [(x, x.h & (blocks - 1)) for x in df.select("*", F.xxhash64(F.lit(7), "doc_id", "text").alias("h"), F.xxhash64(F.lit(8), "doc_id", "text").alias("tie")).collect()]
            n = lambda t: len((t or "").split())
            size = {}
            for _, t, s in rows:
                size[s] = size.get(s, 0) + n(t)
            total = sum(size.values())
            p = {s: k / total for s, k in size.items() if k}

            def fits(a):
                z = sum(x ** a for x in p.values())
                odds = [x ** (a - 1) for x in p.values()]
                return -sum(x ** a / z * math.log(x ** a / z) for x in p.values()) <= 0.98 * math.log(len(p)) + 1e-12 and (max(odds) / min(odds) if cover else max(odds) / z) <= repeat

            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if fits(mid) else (mid, hi)
            hi = hi if not fits(0.0) else 0.0
            z = sum(x ** hi for x in p.values())
            budget = max(size[s] / p[s] ** hi for s in p) * z if cover else total
            orders = df.select("source").distinct().crossJoin(spark.range(blocks).toDF("b")).crossJoin(spark.range(4).toDF("e"))
            place = {(x.source, x.b, x.e): x.p for x in orders.select("*", F.xxhash64(F.lit(7), "source", "b", "e").alias("p")).collect()}
            want = []
            for s in size:
                mine = [(x, b) for x, b in keyed if x.source == s]
                if not size[s]:
                    want += [(x.doc_id, s, 0) for x, _ in mine] if cover else []
                    continue
                aim = math.floor(p[s] ** hi / z * budget * (1 + 1e-7))
                passes, rest = divmod(aim, size[s])
                want += [(x.doc_id, s, e) for x, _ in mine for e in range(passes)]
                todo = sorted(mine, key=lambda m: (place[s, m[1], passes], m[1], m[0].h, m[0].tie))
                k = 0
                while k < len(todo):
                    alike = [m for m in todo[k:] if (m[0].h, m[0].tie) == (todo[k][0].h, todo[k][0].tie)]
                    rest -= sum(n(m[0].text) for m in alike)
                    if rest < 0:
                        break
                    want += [(m[0].doc_id, s, passes) for m in alike]
                    k += len(alike)
            key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
            have = sorted(((x.row.doc_id, x.row.source, x.epoch) for x in got), key=key)
            # A block of rows without tokens at the very end of the budget may be drawn or not.
            light = {i for i, t, _ in rows if not n(t)}
            assert [x for x in have if x[0] not in light] == [x for x in sorted(want, key=key) if x[0] not in light]
            if cover:
                assert {x[0] for x in have} == {x[0] for x in rows}


def test_mixture_comes_in_the_order_of_its_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 64)
    r = random.Random(1)
    df = spark.createDataFrame([(i, "w " * r.randint(1, 20), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    df = df.select("*", *[F.lit("mine").alias(c) for c in ("_mix_block", "_mix_source", "_mix_tokens", "s", "t", "row", "epoch", "place")])
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(x)[3:] for x in out.collect()} == {("mine",) * 8}
    parts = [[x.doc_id for x in p] for p in out.rdd.glom().collect()] if hasattr(out, "rdd") else [[x.doc_id for x in out.collect()]]
    order = [i for p in parts for i in p]
    drawn = mixing.draw(df, ["doc_id"], max_repeat=2.0, cover=True).orderBy("epoch", "place", "block", "hash").collect()
    assert order == [x.row.doc_id for x in drawn]


WORDS = "the of and to in a is that for it as was with be by on not he this are from".split()


def page(r):
    """A page and the main text that it must give."""
    sentence = lambda n: " ".join(r.choice(WORDS + ["kiln", "plant", "naïve", "AT&T", "x < y"]) for _ in range(n)).capitalize() + "."
    blocks = [sentence(r.randint(4, 9))] + [sentence(r.randint(3, 60)) for _ in range(r.randint(1, 8))]
    wrap = lambda t: html.escape(t) if r.random() < 0.8 else html.escape(t).replace(" ", "\n  ", 3)
    inner = f"<h1>{wrap(blocks[0])}</h1>"
    for k, t in enumerate(blocks[1:]):
        tag = r.choice(["p", "p", "blockquote", "li", 'p class="legal"', 'p class="byline meta"', "figcaption"])
        name = tag.split()[0]
        inner += r.choice([f"<{tag}>{wrap(t)}</{name}>", f"<{tag}>{wrap(t)}" if name in ("p", "li") else f"<{tag}>{wrap(t)}</{name}>"])
        if name == "li":
            inner += "</li>"
        if r.random() < 0.3:
            inner += r.choice(["<script>var x='<p>no</p>'</script>", "<!-- no -->", '<div class="ad">Buy now</div>', '<aside>See more</aside>', '<div class="share-buttons">Share this</div>', "<form><p>Name</p><input></form>", "<style>p{}</style>"])
    comments = '<section id="comments"><p>I read it all and liked the part of the plant as it was</p></section>' if r.random() < 0.5 else ""
    body = r.choice(["<article>%s</article>", "<main><div>%s</div></main>", '<div class="post-content">%s</div>', '<div role="main">%s</div>']) % inner
    top = "<nav><ul>" + "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(4)) + "</ul></nav><header><p>The site of the plant and of the kiln</p></header>"
    side = r.choice(['<div class="cookie-banner">We use cookies to be of use to you and it is fine</div>', '<div id="sidebar"><p>About the author of this and that</p></div>', ""])
    end = r.choice(["<footer>&copy; 2020 the firm</footer></body></html>", "<footer>&copy; 2020 the firm", '<div class="footer">All of it is ours</div></body>'])
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{top}{side}{body}{comments}{end}", "\n\n".join(blocks)


def test_extraction_of_generated_pages(spark):
    r = random.Random(21)
    made = [page(r) for _ in range(250)]
    rows = [(i, f"u{i}", p, "clash", 1) for i, (p, _) in enumerate(made)] + [(300, None, None, None, None), (301, "u", "", "", 0), (302, "u", " <p> ", "", 0), (3, "u3", made[3][0], "again", 2), (None, "u", made[0][0], "x", 3)]
    got = html_extract.query(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)).collect()
    assert len(got) == len(rows) and html_extract.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for x in got:
        want = "" if x.page_id in (300, 301, 302) else made[x.page_id or 0][1]
        assert x.text == want and x.n_chars == len(want), (x.page_id, x.text, want)


def test_extraction_by_density_alone():
    words = "it is the part of the plant that was built with some of the steel and then it grew as they had said in the north of the land. "
    page = f"<body><div>Home News Sport</div><div><p>Title of it</p><p>{words * 3}</p><p>So it was.</p><p>{words * 2}</p></div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div>{'Kiln prices list catalogue. ' * 12}</div></body>"
    assert html_extract.extract(page) == "\n\n".join(["Home News Sport", "Title of it", (words * 3).strip(), "So it was.", (words * 2).strip()])
    inside = f"<article><p>{words}</p><p>e = mc2 <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><noscript><p>Shown without scripts.</p></noscript><p>© holders of {words}</p><ul><li><a href=1>Related one</a></li><li><a href=2>Related two</a></li></ul></article>"
    assert html_extract.extract(inside) == "\n\n".join([words.strip(), "e = mc2 x=2", "Shown without scripts.", f"© holders of {words.strip()}"])
    assert html_extract.extract('<p style="overflow:hidden">Seen.</p><p hidden>Not.</p><p style="display: none">Not.</p><p data-x="hidden">Seen.</p>') == "Seen.\n\nSeen."


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<script ", "<p class='x", "<x y=\"", "<svg>", "</", "<div class=ad>", "<nav>x", "<td class=ad>x", "<article>", "&amp", "a=b "])
def test_broken_markup_takes_linear_time(piece):
    began = time.time()
    html_extract.extract(piece * (600_000 // len(piece)))
    assert time.time() - began < 8
