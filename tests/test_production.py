"""Production, JSON stores and the rules of duplicates against plain Python."""

import difflib
import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.operators import dedup, mining, production, search, state
from gleaner.plans import registry
from gleaner.sources import feeds, stores

SF = "/root/testdata/sf0.001"
NEW = ["pinned_store_shapes", "seen_store", "watched_store", "store_replaced", "snapshot_refused", "production_of_phrases", "production_fetch", "production_topic_pool", "relevance_order",
       "short_content_notice", "batch_quality", "title_keys", "is_duplicate_of_any_exact", "ngram_noun_phrases", "snapshot_publish"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    r = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    want = [tuple(row[names.index(x)] for x in cols) for row in r.fetchall()]
    rows = sorted(map(str, (tuple(x[k] for k in cols) for x in got.collect())))
    assert rows and rows == sorted(map(str, want))


def key(title):
    return re.sub(r"\W+", "", (title or "").lower())


def same(a, b):
    """Whether row a is a duplicate of row b; rows are (ord, url, title, content)."""
    return a[1] == b[1] or (key(a[2]) and key(b[2]) and difflib.SequenceMatcher(None, key(a[2]), key(b[2])).ratio() >= 0.95) or (a[3] and a[3] == b[3])


def made(seed, n, urls=40):
    r = random.Random(seed)
    base = ["zement werk öffnet im norden des landes nach langer verzögerung", "cement plant opens in the north of the country today", "other news about robots in a factory hall", ""]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3]) if t else 0):
            t[r.randrange(len(t))] = r.choice("abcdeé ")
        rows.append((i, f"https://a.com/{r.randrange(urls)}", "".join(t) + (str(r.randrange(10**9)) * 3 if r.random() < 0.5 else ""), r.choice(["", "x y z", f"p {i}", f"q {i}"])))
    return rows


ROW = "ord long, url string, title string, content string"


def test_duplicates_and_greedy_order(spark):
    rows = made(1, 70)
    mine, others = rows[:40], rows[40:]
    got = {r.ord: r.is_duplicate for r in dedup.duplicate_of_any(spark.createDataFrame(mine, ROW), spark.createDataFrame(others, ROW)).collect()}
    want = {a[0]: any(bool(same(a, b)) for b in others) for a in mine}
    assert got == want and 0 < sum(want.values()) < len(want)
    kept = []
    for a in rows:
        if not any(same(a, b) for b in kept):
            kept.append(a)
    assert sorted(r.ord for r in dedup.first_of_similar(spark.createDataFrame(rows, ROW), F.col("ord")).collect()) == [a[0] for a in kept]
    assert dedup.first_of_similar(spark.createDataFrame([], ROW), F.col("ord")).count() == 0


@pytest.mark.parametrize("stored", [True, False])
def test_overlay_by_all_rules(spark, stored):
    feed, extra = made(2, 40), made(3, 12)
    store = [(i, u, "old " + t, c) for i, u, t, c in made(4, 8, 80)] if stored else []
    feed.append((99, "", "no url", "n"))
    both = [a for a in feed + extra if a[1]]
    last = {a[1]: a for a in both}
    top = [(*p[:2], *last.get(p[1], p)[2:]) for p in (store or extra)]
    rest = []
    for a in both:
        if not any(same(a, p) for p in top) and not any(same(a, b) for b in rest):
            rest.append(a)
    got = search.overlay(*(spark.createDataFrame(x, ROW) for x in (feed, store, extra))).collect()
    assert sorted((r.url, r.title, r.content) for r in got if r.is_pinned) == sorted(p[1:] for p in top)
    assert [tuple(r)[1:4] for r in sorted((r for r in got if not r.is_pinned), key=lambda r: r.ord)] == [a[1:] for a in rest]


def test_similar_titles_name_copies_once(spark):
    rows = spark.createDataFrame([(1, "The same long title of an article"), (2, "the same long title of an article!"), (3, "The same long title of an article"), (4, "The same long titles of an article"), (5, "")], "ord long, title string")
    assert sorted(map(tuple, dedup.similar_titles(rows).collect())) == [(1, 4, False), (2, 1, True), (3, 1, True), (4, 1, False)]


FOUND = "kind string, phrase_no long, priority int, ord long, url string"


def test_mock_rows_stand_in_on_page_one_only(spark):
    seen = spark.createDataFrame([("u1",)], "url string").select(X.hash_of(F.col("url")).alias("url_hash"))
    found = spark.createDataFrame([("provider", 0, 0, 0, "u1"), ("feed", 0, 0, 1, "u2")], FOUND)
    mock = spark.createDataFrame([("mock", 0, 0, 0, "m")], FOUND)
    assert [r.url for r in production.for_phrases(found, seen, mock).collect()] == ["m"]
    assert production.for_phrases(found, seen, mock, page=2).count() == 0 == production.for_phrases(found, seen, mock, page=2, pool=True).count()
    assert [r.url for r in production.for_phrases(found, seen, mock, pool=True).collect()] == ["u2"]


def test_topics_take_what_earlier_ones_left(spark):
    rows = [("a", 1, 0, "u0"), ("a", 1, 1, "u1"), ("a", 2, 2, "u2"), ("b", 1, 3, "u0"), ("b", 1, 4, "u2"), ("b", 3, 5, "u9"), ("c", 1, 6, "")]
    found = spark.createDataFrame(rows, "topic string, page int, ord long, url string")
    none = spark.createDataFrame([], "url_hash string")
    got = production.topic_pool(found, none, ["a", "b", "c"], F.lit(True), "now", target=6).orderBy("topic_no", "ord").collect()
    assert [(r.topic_bucket, r.url) for r in got] == [("a", "u0"), ("a", "u1"), ("b", "u2")]  # b's page 3 comes after an empty one


def test_fresh_pool(spark, tmp_path):
    where, schema = str(tmp_path / "pool"), "ord long, url string, published_at string, fetched_at string"
    new = lambda rows: lambda: spark.createDataFrame(rows, schema)
    fail = lambda: pytest.fail("a young pool is not made anew")
    first = production.fresh_pool(spark, where, schema, new([(0, "u", "2024-01-01", ""), (1, "v", "", "soon"), (2, "", "", "")]), "2024-01-01 00:00:00")
    assert sorted(r.url for r in first.collect()) == ["u", "v"]
    assert production.fresh_pool(spark, where, schema, fail, "2024-01-01 23:00:00").count() == 2
    later = production.fresh_pool(spark, where, schema, new([(0, "w", "", "")]), "2024-01-09 00:00:00", index=lambda p: p.select(F.col("ord").alias("pos"), F.col("url").alias("keyword")))
    assert sorted(r.url for r in later.collect()) == ["v", "w"]  # u has expired, v has no time
    assert sorted(r.keyword for r in spark.read.json(f"{where}/keywords").collect()) == ["v", "w"]


def test_run_falls_back_on_the_cached_result():
    def fail():
        raise OSError("down")

    assert production.run(lambda: "old", fail) == "old" == production.run(lambda: "old", fail, force=True)
    assert production.run(lambda: "old", lambda: "new", force=True) == "new" == production.run(lambda: None, lambda: "new")
    with pytest.raises(OSError):
        production.run(lambda: None, fail)
    assert production.resolved("", None, "x") == "x" and production.resolved(0, 7) == 7


def test_stores(spark, tmp_path):
    body = lambda *b: spark.createDataFrame(list(enumerate(b)), "request long, body string")
    assert stores.seen(stores.bodies(spark, str(tmp_path / "none"))).count() == 0 == stores.seen(body("{bad", None, "[]")).count()
    (tmp_path / "seen.json").write_text('{"u": {"at": 1},\n "v": "x"}')
    assert sorted(map(tuple, stores.seen(stores.bodies(spark, str(tmp_path / "seen.json"))).collect())) == [("u", '{"at":1}'), ("v", "x")]
    assert stores.pinned(body("7", "", None, '{"articles": 3}'), "url string").count() == 0
    flat = stores.watched(body('["AI", {"keyword": " ai "}, {"keyword": "Steel", "is_processed": true}, " ", null]')).orderBy("ord").collect()
    assert [(r.keyword, r.is_processed) for r in flat] == [("AI", False), ("Steel", True)]
    assert [r.keyword for r in stores.watched(body('{"a": 1}'), ("D", "E")).orderBy("ord").collect()] == ["D", "E"] and stores.watched(body("[]"), ("D",)).count() == 0


def test_snapshots_by_keyword(spark, tmp_path):
    root, rows = str(tmp_path / "snap"), spark.createDataFrame([(1,)], "a int")
    state.publish(spark, rows, root, "1", "steel")
    with pytest.raises(ValueError):
        state.publish(spark, [1], root, "2", "steel")
    with pytest.raises(ValueError):
        state.publish(spark, rows, root, "2", "steel", required=("b",))
    assert state.current(spark, root, "steel").count() == 1 == state.current(spark, root).count()
    with pytest.raises(LookupError):
        state.current(spark, root, "coal")


def test_phrases_end_with_sentences(spark):
    d = spark.createDataFrame([("Iron Works. Coal Pit grew! The Steel Mill, iPhone Maker",)], "t string")
    caps, nouns = d.select(mining.capitalized_phrases(F.col("t"), ("grew",)), F.transform(mining.noun_phrases(F.col("t"), ("the",)), lambda x: x["phrase"])).first()
    assert caps == ["Iron Works", "Coal Pit", "The Steel Mill", "Maker"] and "Works Coal" not in nouns and "Iron Works" in nouns and "Steel Mill iPhone" in nouns
    trimmed = spark.createDataFrame([("The Steel Mill of the",), ("of the",), ("Mill",)], "t string").select(mining.trim_stop_words(F.col("t")).alias("x")).collect()
    assert [r.x for r in trimmed] == ["Steel Mill", "", "Mill"]


def test_last_columns(spark):
    d = spark.createDataFrame([(0, "T", " \n" + "x" * 49, 0.25), (1, None, "x" * 50, None), (2, "T", None, 0.35)], "ord long, title string, content string, relevance_score double")
    assert [r.ord for r in production.by_relevance(d).collect()] == [2, 0, 1]
    assert [r.n for r in d.orderBy("ord").select(production.short_content(F.col("title"), F.col("content")).alias("n")).collect()] == ["No sufficient content available. Title: T", None, "No sufficient content available. Title: T"]
    assert [r.q for r in d.orderBy("ord").select(production.batch_quality(F.col("content"), F.col("title"), F.col("relevance_score")).alias("q")).collect()] == [8.1, 5.0, 4.0]
    assert feeds.load_pool(spark, "/nonexistent/pool", "a int").count() == 0
