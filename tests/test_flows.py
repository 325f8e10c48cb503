"""Operators that keep state or files, and joins of pools with keywords, against plain Python."""

import difflib
import json
import random
import re
import urllib.parse
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import dedup, enrich, extract, gram_index, match, mining, production, search, tags
from gleaner.sources import feeds, providers
from gleaner.streaming import expiry


def test_expiring_keys_survive_a_restart(spark, tmp_path):
    day = datetime(2024, 1, 1)
    schema = "k long, ts timestamp"
    stream = lambda: expiry.first_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", "ts", 7)

    def add(*rows):
        spark.createDataFrame([(k, day + timedelta(days=d)) for k, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def passed():
        return sorted((r.k, (r.ts - day) / timedelta(days=1)) for r in expiry.run(spark, stream, str(tmp_path)).collect())

    add((1, 0), (1, 3), (2, 1), (1, 0))
    assert passed() == [(1, 0), (2, 1)]
    add((1, 6.5), (1, 7), (2, 8.5), (3, 9))  # a new query goes on from the old one's state: 1 is known for seven days to the end, 2 has expired
    assert passed() == [(1, 0), (2, 1), (2, 8.5), (3, 9)]
    add((1, 20), (2, 15), (4, 40))
    add((3, 41))
    assert passed() == [(1, 0), (1, 20), (2, 1), (2, 8.5), (3, 9), (3, 41), (4, 40)]


def test_provider_responses(spark, tmp_path):
    body = lambda *t: json.dumps({"articles": [{"title": x, "url": f"https://x.org/{x}"} for x in t]})
    rows = [("one", "a b", 1, 200, body("A")), ("one", "a b", 2, 429, None), ("one", "c", 1, 200, body("hidden")), ("two", "c", 1, 200, body("C")), ("two", "a b", 2, 500, None)]
    providers.store(spark.createDataFrame(rows, "provider string, phrase string, page int, status int, body string"), f"{tmp_path}/r")
    (tmp_path / "r/provider=two/phrase=c/page=2").mkdir(parents=True)
    (tmp_path / "r/provider=two/phrase=c/page=2/x.txt").write_text("{broken\n")
    got = providers.responses(spark, f"{tmp_path}/r", ["one", "two"], ["a b", "c"], 2)
    assert sorted((r.provider, r.phrase, r.page, r.seq, r.status) for r in got.where("status is not null").collect()) == [("one", "a b", 1, 0, 200), ("one", "a b", 2, 1, 429), ("one", "c", 1, 2, 200), ("two", "a b", 2, 1, 500), ("two", "c", 1, 2, 200)]
    assert [(r.provider, r.seq, r.body) for r in got.where("status is null").collect()] == [("two", 3, None)]
    assert sorted((r.provider, r.phrase) for r in providers.granted(got).collect()) == [("one", "a b"), ("two", "c")]  # refused once, a provider is out for the session
    only = providers.responses(spark, f"{tmp_path}/r", ["one", "two"], ["a b", "c"], 2, only=["c"])
    assert only.rdd.getNumPartitions() == 2 and got.rdd.getNumPartitions() == 4 and {r.seq for r in only.collect()} == {2, 3} and got.where("phrase = 'c'").count() == only.count() and got.count() == 6
    assert [(r.provider, r.seq) for r in providers.responses(spark, f"{tmp_path}/r", ["one"], ["a b", "c"], 2, {"one": 1}).collect()] == [("one", 0)]
    assert providers.responses(spark, f"{tmp_path}/none", ["one"], ["c"]).count() == 0 and got.where("phrase in ('z')").count() == 0


def test_enrichment_asks_once(spark):
    rows = spark.createDataFrame([(i, f"https://x.org/{i}", f"t{i}", "2024") for i in range(20)], "ord long, url string, title string, published_at string")
    good = lambda x: {"url": x["url"], "executive_summary": x["title"], "business_implications": ["b"], "ai_relevance": "r", "industry_categories": ["c"], "innovation_score": 5, "sentiment": "Neutral"}
    empty = spark.createDataFrame([], "cache_key string, raw string")
    sizes = lambda items, attempt: [{**good(x), "executive_summary": str(len(items))} for x in items]
    first = enrich.through_cache(rows, empty, sizes, digits=0)
    assert sorted(r.s for r in first.select(enrich.insight(F.col("raw"))["executive_summary"].alias("s")).collect()) == ["2"] * 2 + ["3"] * 18
    cache = spark.createDataFrame([tuple(r) for r in enrich.cache_after(empty, first).collect()], "cache_key string, raw string")

    def never(items, attempt):
        raise AssertionError("asked again")

    assert {r.insight_source for r in enrich.through_cache(rows, cache, never, digits=0).collect()} == {"cache"}

    def half(items, attempt):
        if attempt == 0:
            raise ValueError("busy")
        return [good(x) if x["ord"] % 2 else {**good(x), "sentiment": "Angry"} for x in items] + [{"url": "https://other.org"}]

    got = enrich.through_cache(rows, empty, half, digits=0).collect()
    assert {r.ord: r.insight_source for r in got} == {i: "model" if i % 2 else "default" for i in range(20)}
    once = enrich.through_cache(rows, empty, half, attempts=1, digits=0).collect()
    assert {r.insight_source for r in once} == {"default"}


def test_index_of_grams_equals_search(spark, tmp_path):
    r = random.Random(4)
    words = ["steel", "Steelworks", "eel", "kiln", "AI", "ai lab", "é", "cement plant", "in", "tin", "", " Kiln "]
    rows = [(i, f"https://x.org/{i % 50}", r.sample(words, r.randint(0, 3)), r.choice(["A steel title", "Kiln", "x", None]), r.choice(["made of tin in a lab", "", None, "Éclair", "cement"])) for i in range(70)] + [(99, "https://x.org/n", None, "null tags", "steel")]
    df = spark.createDataFrame(rows, "ord long, url string, tags array<string>, title string, content string")
    gram_index.build(df, f"{tmp_path}/i")
    for kw in ("steel", "eel", "Kiln", "a steelworks yard", "é", "in", "zzz", "title", "cement plants", "clair"):
        want = {(x.ord, x.tier) for x in search.search(df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), kw).collect()}
        found = gram_index.search(spark, f"{tmp_path}/i", kw)
        assert {(x.ord, x.tier) for x in found.collect()} == want, kw
    assert "PartitionFilters: [bucket" in (plan := found._jdf.queryExecution().toString()) and "PushedFilters: [In(gram" in plan
    with pytest.raises(ValueError):
        gram_index.search(spark, f"{tmp_path}/i", " ")


def holds(text, word):
    left, right = ("\\b" if word[0].isalnum() else ""), ("\\b" if word[-1].isalnum() else "")
    return bool(text) and bool(re.search(left + re.escape(word) + right, text.lower()))


def test_pool_keyword_match_equals_pairs(spark):
    r = random.Random(6)
    parts = ["supply chain", "supply", "chains", "c++", "user_name", "user", "a.i.", "ai", "x_", "_x", "é", "été", "the", "ev", "EVs", "electric vehicle", "machine  learning", "machine learning"]
    text = lambda: r.choice([" ", ", ", "-", "_", ""]).join(r.choices(parts, k=r.randint(1, 6)))
    pool = [(i, f"https://x.org/{i % 30}", text() if i % 9 else None, text()) for i in range(60)]
    keys = ["supply chain", "c++", "user", "name", "x_", "_x", "été", "the", "electric vehicles", "Machine Learning, zzz", "artificial intelligence", " ", "user_name", "+"]
    cached = [(f"https://x.org/{i}", [text(), " User "] if i % 2 else []) for i in range(10)] + [("https://x.org/11", None), ("https://x.org/12", [None, "the"])]
    pairs = {}
    for o, url, t, d in pool:
        for k in keys:
            words = [w for p in k.split(",") if p.strip() for w in C.SYNONYMS.get(p.strip().lower(), (p.strip().lower(),))]
            if any(holds(c.lower(), w) for u, many in cached if u == url for c in many or [] if c for w in words):
                pairs[o, k] = "tag"
            elif any(holds(x, w) for x in (t, d) for w in words):
                pairs[o, k] = "text"
    p = spark.createDataFrame(pool, "ord long, url string, title string, description string")
    k = spark.createDataFrame([(x,) for x in keys], "keyword string")
    c = spark.createDataFrame(cached, "url string, keywords array<string>")
    found = match.pool_matches(p, k, c)
    assert {(x.ord, x.keyword): x.via for x in found.collect()} == pairs and len(pairs) > 80
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert match.pool_matches(p, k.limit(0), c).count() == 0 and match.pool_matches(p.limit(0), k, c).count() == 0


def test_similar_titles_by_rarest_pieces(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    keys = {"".join(word() for _ in range(r.randint(1, 9))) for _ in range(60)}
    for k in list(keys):
        for _ in range(3):
            at = r.randrange(len(k))
            keys.add(r.choice([k[:at] + k[at + 1:], k[:at] + "z" + k[at:], k[:at] + "y" + k[at + 1:], k[at:] + k[:at]]))
    keys = sorted(k for k in keys if k)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    df = spark.createDataFrame([(k,) for k in keys], "t string")
    got = {(x.t, x.u) for x in dedup.similar_keys(df, df.withColumnRenamed("t", "u")).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and ratio(a, b) >= 0.95} and len(got) > 60
    hot = [f"{word()}{word()}{word()}announcesquarterly{word()}{word()}{word()}" for _ in range(400)]
    df = spark.createDataFrame([(k,) for k in set(hot)], "t string")
    pairs = dedup.similar_keys(df, df.withColumnRenamed("t", "u"))
    assert {(x.t, x.u) for x in pairs.collect()} == {(a, b) for a in set(hot) for b in set(hot) if a != b and ratio(a, b) >= 0.95}
    from unittest import mock
    with mock.patch.object(dedup, "title_ratio", lambda t, u: F.lit(1.0)):  # what the last step would be asked for
        assert dedup.similar_keys(df, df.withColumnRenamed("t", "u")).count() < 20 * 400


def test_stages_of_the_page_reader():
    long = " ".join(f"word{i}" for i in range(40))
    assert extract.page(f"<html><link rel='x canonical' href=' https://a.org/x '><p>{long}</p><p>{long} two</p><nav><p>{long} menu</p></nav>") == (f"{long} {long} two", "https://a.org/x")
    teasers = "<p>a teaser of more than thirty characters</p><p>another teaser of more than thirty characters</p>"
    article = f"<main><div><div>{long} one</div><div>{long} two</div></div><p>{long} three</p></main>"
    assert extract.readable(teasers + article) == f"{long} one {long} two {long} three"  # two blocks, but under 60 words
    assert extract.readable(f"<div class='big post-content'><div>{long} one</div><div>{long} two</div></div><div id='main-content'><div>{long}</div></div>") == f"{long} one {long} two"
    assert extract.readable(f"<div id='main-content'><div>{long} one</div><div>{long} two</div></div>") == f"{long} one {long} two"
    lines = f"{long} one\nshort\nSubscribe to our newsletter, which has more than 35 characters\nconst x = 1; this line has more than 35 characters\n{long} two\n"
    assert extract.readable(teasers + lines) == f"a teaser of more than thirty charactersanother teaser of more than thirty characters{long} one {long} two"
    assert len(extract.readable(f"<p>{long}</p>" * 20).split()) == 250 and extract.page(None) == ("", None) and extract.readable("<script>let x</script><p") == ""
    assert extract.readable(f"<article><p>{long}</p></article><article><p>{long}</p></article>") == f"{long} {long}"


def test_scraped_rows(spark):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [("https://a.org/1", "t", f"<p>{text}</p><p>{text}</p>"), ("https://github.com/x", "t", "<p>x</p>"), ("https://a.org/2", "t", None), ("https://x-mock.com/1", "T", None), ("https://a.org/3", None, "<p></p>"), ("https://a.org/4", "t", "<p>not read</p>")]
    got = {r.url: (r.content, r.scrape_error) for r in extract.scraped(spark.createDataFrame(rows, "url string, title string, html string"), spark.createDataFrame([("https://a.org/4", "known")], "url string, content string")).collect()}
    assert got["https://a.org/1"] == (f"{text} {text}", None) and got["https://github.com/x"] == (None, "Invalid URL: domain") and got["https://a.org/2"] == (None, "no page")
    assert got["https://x-mock.com/1"][0].startswith("This is a detailed mock report regarding 'T'.") and got["https://a.org/3"] == (None, "no readable text") and got["https://a.org/4"] == ("known", None)


def normal(url):
    u = url.strip().lower()
    u = "https://" + u[7:] if u.startswith("http://") else u
    p = urllib.parse.urlparse(u)
    query = sorted((k, v) for k, v in urllib.parse.parse_qsl(p.query) if k not in C.TRACKING)
    return urllib.parse.urlunparse((p.scheme, p.netloc, p.path.rstrip("/"), p.params, urllib.parse.urlencode(query), ""))


def test_urls_like_the_standard_library(spark):
    urls = ["https://a.org/x?a=1%20z", "https://a.org/x?a=1+z", "HTTP://A.org/x//?b=%41&a=&utm_source=q", "https://a.org/;p=1?x=%zz%4", "https://a.org/a;?k", "https://a.org/?q=caf%C3%A9&=v&r=2&r=1", "https://a.org/a#f?b=1", "https://a.org/a?u%74m_source=1&t=~*()'-_.", "https://a.org/a?x=a=b=c&&y", "https://a.org", "a.org/b/", ""]
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.normalize_url(F.col("u")).alias("n")).collect()}
    assert got == {u: normal(u) for u in urls}


def test_tenths_like_the_standard_library(spark):
    r = random.Random(1)
    values = [0.35, 0.25, 0.45, 2.5, 0.05, 0.15, 1.05, 1e15, 0.0] + [r.randint(0, 10**6) * 0.1 + r.randint(0, 999) * 0.5 + 0.05 * r.randint(0, 9) for _ in range(2000)] + [k / 20 for k in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", production.round_tenth(F.col("v")).alias("r")).collect()
    assert all(x.r == round(x.v, 1) for x in got)


def test_fallback_tags_and_verbs(spark):
    text = "The Green Plant opened. And The Green Plant grew, For Acme Corp of India. reported output rose; kiln output rose"
    one = lambda c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first().x
    assert one(mining.fallback_tags(F.col("t"))) == ["Green Plant", "Acme Corp of India", "output"] or one(mining.fallback_tags(F.col("t")))[0] == "Green Plant"
    assert not any(w.lower() in C.STOP_WORDS for t in one(mining.fallback_tags(F.col("t"))) for w in (t.split()[0], t.split()[-1]))
    assert one(mining.run_phrases(F.lit("robot arms in kiln halls. new day"), ("in", "new"))) == ["robot", "arms", "robot arms", "kiln", "halls", "kiln halls", "day"]
    assert one(mining.run_phrases(F.lit("plant reported output"), (), ("reported",))) == ["plant", "output"]
    assert one(mining.capitalized_phrases(F.lit("Acme Reported Gains. Acme Works"), (), ("reported",))) == ["Acme Works"]


def test_tags_by_entities_and_blank_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    given, none = X.words(["Tariffs", "Acme Corp", "steel"]), F.lit("")
    assert one(tags.clean_tags(given, none, none, none)) == ["Tariff", "Acme Corp", "Steel"]
    assert one(tags.clean_tags(given, none, none, none, entities=X.words(["Acme"]))) == ["Acme Corp"]
    assert one(tags.clean_tags(given, F.lit("On tariffs"), none, none, taxonomy=X.words(["Steel making"]))) == ["Tariff", "Steel"]


def test_a_pool_that_cannot_be_made_leaves_the_old_one(spark, tmp_path):
    schema = "ord long, url string"
    feeds.save_pool(spark.createDataFrame([(1, "a")], schema), f"{tmp_path}/p", "2024-01-01T00:00:00Z")
    broken = spark.createDataFrame([(2, "b")], schema).withColumn("url", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        feeds.save_pool(broken, f"{tmp_path}/p", "2024-01-02T00:00:00Z")
    assert [r.ord for r in feeds.load_pool(spark, f"{tmp_path}/p", schema).collect()] == [1] and feeds.pool_age_hours(spark, f"{tmp_path}/p", "2024-01-01 05:00:00") == 5


def test_news_of_a_keyword(spark):
    schema = "ord long, url string, title string, content string, summary string, keywords array<string>"
    feed = spark.createDataFrame([(1, "https://a.org/1", "Steel grows", "c one", "s", ["AI"]), (2, "https://a.org/2", "Other", "c two", "on steel", []), (3, "https://a.org/3", "No", "c three", "s", ["x"]), (4, "https://a.org/4?utm_source=z", "Fourth", "c four", "s", ["Steel"])], schema)
    pinned = spark.createDataFrame([(1, "https://a.org/9", "Pinned steel", "c nine", "s", []), (2, "https://a.org/8", "Else", "c eight", "s", [])], schema)
    store = spark.createDataFrame([(1, "https://a.org/4", "Stored", "kept", "s", [])], schema)
    shown = lambda p: {(r.url, r.is_pinned) for r in p.collect()}
    assert shown(search.news(feed, pinned, store.limit(0), "steel, zzz")) == {("https://a.org/9", True), ("https://a.org/1", False), ("https://a.org/2", False), ("https://a.org/4?utm_source=z", False)}
    assert shown(search.news(feed, pinned, store, "STEEL")) == {("https://a.org/4", True), ("https://a.org/1", False), ("https://a.org/2", False), ("https://a.org/9", False)}
    assert shown(search.news(feed, pinned, store, "nothing")) == {("https://a.org/4", True)}


def test_similar_titles_meet_near_their_places_only(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(9)) for _ in range(8)]
    keys = sorted({"".join(r.sample(vocabulary, 8)) for _ in range(300)})  # the same letters, other places
    df = spark.createDataFrame([(k,) for k in keys], "t string")
    from unittest import mock
    with mock.patch.object(dedup, "title_ratio", lambda t, u: F.lit(1.0)):
        assert dedup.similar_keys(df, df.withColumnRenamed("t", "u")).count() < 300 * 299 // 4


@pytest.fixture(scope="module")
def repeated_urls(spark, tmp_path_factory):
    """The smallest tables, with every page's url given to the next page too, and pages without a readable text."""
    at = tmp_path_factory.mktemp("urls")
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = pages.select((F.col("page_id") - F.col("page_id") % 2).alias("k"), "page_id", "url")
    first = urls.where("page_id = k").select("k", F.col("url").alias("first"))
    urls.join(first, "k").select("page_id", "first").join(pages, "page_id").select("page_id", F.col("first").alias("url"), F.when(F.col("page_id") % 9 != 2, F.col("html")).otherwise("<p>x</p>").alias("html")).coalesce(1).write.parquet(f"{at}/pages.parquet")
    for t in ("documents", "events"):
        (at / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["pinned_overlay", "scrape_gate", "search_by_index_short", "search_tiered", "refresh_counters"])
def test_pages_of_one_url_as_in_sql(spark, repeated_urls, name):
    import duckdb

    import __spark_entry__ as entry
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("documents", "events", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{repeated_urls}/{t}.parquet{'/*.parquet' if t == 'pages' else ''}')")
    df = entry.queries()[name](spark, repeated_urls)
    want = con.sql(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_keywords_in_a_long_text(spark):
    import time
    text = " ".join(f"word{i}" for i in range(40_000)) + " last_one c++"
    texts = spark.createDataFrame([(1, text)], "ord long, text string")
    words = spark.createDataFrame([(w,) for w in ("word7 word8", "word39999", "one", "last_one", "c++", "word")], "word string")
    began = time.time()
    assert {r.word for r in match.whole_words(texts, words, "ord").collect()} == {"word7 word8", "word39999", "last_one", "c++"}
    assert time.time() - began < 60  # all pairs of the text's runs took minutes
