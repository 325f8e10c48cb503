"""Sources, stores, watched keywords and display columns on small tables."""

from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.operators import watch
from gleaner.sources import feeds


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def test_corrupt_and_missing_bodies_give_no_rows(spark):
    bad = spark.createDataFrame([(1, "{not json"), (2, None), (3, "{}"), (4, '{"articles": []}')], "request long, body string")
    assert feeds.search_pages(bad, "s").count() == 0 and feeds.stories(bad, "s", "own").count() == 0
    assert feeds.feed_items(bad.withColumn("name", F.lit("n"))).count() == 0


def test_feed_kinds(spark):
    rss = "<rss><channel><item><title>One &amp; two</title><link>https://a.com/1</link><description>d</description></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed><entry><title>Three</title><link href="https://a.com/3"/><content>c</content><updated>u</updated></entry></feed>'
    rows = feeds.feed_items(spark.createDataFrame([(1, "r", rss), (2, "a", atom)], "request long, name string, body string")).orderBy("ord").collect()
    assert [(r.title, r.url, r.description, r.published_at) for r in rows] == [("One & two", "https://a.com/1", "d", ""), ("Three", "https://a.com/3", "c", "u")]


def test_pool_store(spark, tmp_path):
    where = str(tmp_path / "pool")
    assert feeds.load_pool(spark, where, "url string").count() == 0 and feeds.pool_age_hours(spark, where, "2024-01-02") is None
    feeds.save_pool(spark.createDataFrame([("u",)], "url string"), where, "2024-01-01T00:00:00Z")
    assert feeds.load_pool(spark, where, "url string").count() == 1 and feeds.pool_age_hours(spark, where, "2024-01-02 12:00:00") == 36


def test_watched_keywords(spark):
    old = spark.createDataFrame([(0, "AI", True), (1, "ai ", False), (2, " ", False)], "ord long, keyword string, is_processed boolean")
    assert [(r.keyword, r.is_processed) for r in watch.distinct_keywords(old).collect()] == [("AI", True)]
    new = spark.createDataFrame([(0, "ai"), (1, "Steel")], "ord long, keyword string")
    assert sorted((r.keyword, r.is_processed) for r in watch.add_keywords(old, new).collect()) == [("AI", True), ("Steel", False)]
    assert sorted((r.keyword, r.is_processed) for r in watch.save_keywords(new, old).collect()) == [("Steel", False), ("ai", True)]
    assert [r.progress for r in watch.unprocessed_progress(watch.add_keywords(old, new)).collect()] == [5]


def test_display(spark):
    assert one(spark, watch.countdown(F.col("x")), 3725, "x long") == "1h 2m 5s" and one(spark, watch.countdown(F.col("x")), 0, "x long").startswith("Scheduled")
    assert one(spark, watch.slug_title(F.col("x")), "https://a.com/big-news_today.php.html?x=1") == "Big News Today" and one(spark, watch.slug_title(F.col("x")), None) == "URL Article"
    assert one(spark, watch.unfenced(F.col("x")), "so:\n```json\n[1]\n```\n") == "[1]" and one(spark, watch.unfenced(F.col("x")), " [2] ") == "[2]"
    assert one(spark, watch.display_date(F.col("x")), "2024-03-05T10:00:00Z") == "Mar 5, 2024" and one(spark, watch.display_date(F.col("x")), "soon") == "soon"


def test_a_failed_summary_still_takes_the_title(spark):
    text = "The plant in the north and the mill of the town were built with some of the steel. " * 12
    rows = [(0, "https://a.com/1", "Robotics factory automation", text, "short"), (1, "https://a.com/2", "Robotics factory automation", text, "A long summary of what the article tells."), (2, " ", "t", text, "s")]
    df = spark.createDataFrame(rows, "ord long, url string, title string, content string, summary string")
    got = watch.verdicts(df, spark.createDataFrame([], "url_hash string"), "plant north", english=F.lit(True)).orderBy("ord").collect()
    assert [(r.ord, r.reject_reason) for r in got] == [(0, "failed_summary_validation"), (1, "duplicate_urls")]
    seen = df.where("ord = 0").select(X.hash_of(F.trim("url")).alias("url_hash"))
    assert watch.verdicts(df, seen, "plant", english=F.lit(True)).where("reject_reason = 'duplicate_urls'").count() == 1


def test_enrichment_keeps_every_row_whatever_the_model_does(spark):
    from gleaner.operators import enrich

    rows = spark.createDataFrame([(i, f"t{i}", None) for i in range(20)], "ord long, title string, note string").repartition(2)

    def short(part):
        return [{"note": r["title"].upper()} for r in part[:-1]]

    def never(part):
        raise ValueError("no answer")

    tried = []

    def late(part):
        tried.append(1)
        if len(tried) % 2:
            raise OSError("try again")
        return [{"note": "ok"} for _ in part]

    for model, some in ((short, {"T"}), (never, set()), (late, {"o"}), (lambda part: None, set())):
        got = enrich.enrich(rows, model, "ord long, note string", batch=3).collect()
        assert sorted(r.ord for r in got) == list(range(20)) and {r.note[0] for r in got if r.note} == some
    assert all(r.note == "ok" for r in enrich.enrich(rows, late, "ord long, note string", batch=3).collect())
