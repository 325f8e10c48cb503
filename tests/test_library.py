"""Operators over stored articles on small tables."""

from pyspark.sql import functions as F

from gleaner.operators import library


def test_startup_falls_back_to_stored_rows(spark):
    some, none = spark.createDataFrame([(1,)], "x long"), spark.createDataFrame([], "x long")
    stored = spark.createDataFrame([(2,), (3,)], "x long")
    assert [r.x for r in library.startup(some, stored).collect()] == [1]
    assert sorted(r.x for r in library.startup(none, stored).collect()) == [2, 3]


def test_backfill_order(spark):
    stores = spark.createDataFrame([(0, " u ", "old", "p0"), (1, "u", "new", ""), (2, "u", None, None)], "ord long, url string, title string, published_at string")
    rows = spark.createDataFrame([(0, "u", "", None, "a"), (1, "https://x.com/some-page.html", None, "", "a"), (2, "u", "own", "q", "a"), (3, None, None, None, None)], "ord long, url string, title string, published_at string, added_at string")
    got = [(r.title, r.published_at) for r in library.backfill_metadata(rows, stores, "now").orderBy("ord").collect()]
    assert got == [("new", "p0"), ("Some Page", "a"), ("own", "q"), ("URL Article", "now")]


def test_tag_cache_needs_title_and_summary(spark):
    cache = spark.createDataFrame([("u", "A Plant opens!", "What it is.", ["x"]), ("v", "!!", "s", ["y"])], "url string, title string, summary string, tags array<string>")
    rows = spark.createDataFrame([(0, "u", "a plant opens", "what it is"), (1, "u", "a mill closes", "what it is"), (2, "u", "a plant opens", "other"), (3, "v", "!!", "s"), (4, "w", "t", "s")], "ord long, url string, title string, summary string")
    got = {r.ord: (r.hit, r.tags) for r in library.tag_cache_hits(rows, cache).collect()}
    assert got == {0: (True, ["x"]), 1: (False, None), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_chips_and_keywords(spark):
    df = spark.createDataFrame([(["a", "b"], "a"), (["a"], "b"), ([], "c")], "chips array<string>, chip string")
    assert [r.x for r in df.select(library.toggle(F.col("chips"), F.col("chip")).alias("x")).collect()] == [["b"], ["a", "b"], ["c"]]
    raw = spark.createDataFrame([([" Steel ", "steel", "News", None],), (None,), (["a", "b", "c", "d"],)], "raw array<string>")
    assert [r.x for r in raw.select(library.three_keywords(F.col("raw")).alias("x")).collect()] == [
        ["Steel", "Manufacturing", "Industrial Technology"], ["Manufacturing", "Industrial Technology", "Automation"], ["a", "b", "c"]]


def test_mock_rows(spark):
    topics = spark.createDataFrame([("steel", "On steel", "u1")], "topic string, title string, url string")
    got = library.mock_rows(spark.createDataFrame([(0, "Steel mills"), (1, "wool")], "ord long, phrase string"), topics).orderBy("ord").collect()
    assert [(r.topic, r.title) for r in got] == [("steel", "On steel"), (None, "Latest on wool")] and got[1].url.startswith("https://news-mock.com/")


def test_accepted_prefers_new_domains(spark):
    rows = spark.createDataFrame([(0, "https://a.com/1"), (1, "https://a.com/2"), (2, "https://b.com/1"), (3, "https://c.com/1")], "ord long, url string")
    verdicts = rows.select("ord", F.when(F.col("ord") == 3, "low_quality_content").otherwise("accepted_articles").alias("reject_reason"))
    assert [(r.ord, r["pass"]) for r in library.accepted(rows, verdicts, 3).orderBy("pass", "ord").collect()] == [(0, 0), (2, 0), (1, 1)]
    assert [r.ord for r in library.accepted(rows, verdicts, 2).orderBy("pass", "ord").collect()] == [0, 2]
