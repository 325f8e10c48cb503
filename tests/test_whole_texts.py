"""Operators on titles and texts as a whole."""

import difflib
import random

from pyspark.sql import functions as F

from gleaner.operators import dedup, library, mining, tags
from gleaner.plans import registry


def test_phrases_behind_character_2000(spark, monkeypatch):
    text = "it is so. " * 300 + "Quantum Kiln"
    monkeypatch.setattr(registry, "articles", lambda spark, sf: spark.createDataFrame([("u", "Title", text)], "url string, title string, content string"))
    got = {r.canonical.lower() for r in registry.phrase_stats(spark, "").collect()}
    assert "quantum kiln" in got, got


def test_fallback_tags_count_the_whole_content(spark, monkeypatch):
    text = "Iron Mill. Coal Pit. Sand Bank. " + "it is so. " * 60 + "so Quantum Kiln, " * 5
    rows = spark.createDataFrame([(0, "u", "x", text)], "ord long, url string, title string, content string")
    monkeypatch.setattr(registry, "articles", lambda spark, sf: rows)
    assert registry.fallback_keywords3(spark, "").first().tags[0] == "Quantum Kiln"
    known = spark.createDataFrame([], "url string, keywords array<string>")
    assert library.keywords_from_fallback(rows, known).first().keywords[0] == "Quantum Kiln"


def test_fallback_tags_of_a_long_text(spark):
    text = " ".join(f"word{i}x" for i in range(20_000)) + " Quantum Kiln"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(mining.fallback_tags(F.col("t")).alias("x")).collect()[0].x[0] == "Quantum Kiln"


def test_similar_titles_with_spread_edits(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    titles = []
    for n in [65] * 6 + [40, 55, 80, 90, 120]:
        base = [r.choice(letters) for _ in range(n)]
        titles.append("".join(base))
        for turn in (0, 1):
            copy, k = list(base), int(0.046 * n)
            spots = [int((j + 0.5) * n / (2 * k)) for j in range(2 * k)]
            for j in reversed(range(2 * k)):
                if j % 2 == turn:
                    del copy[spots[j]]
                else:
                    copy.insert(spots[j], r.choice(letters))
            titles.append("".join(copy))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i != j and ratio(a, b) >= 0.95}
    assert len(want) > 12
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    assert {(x.a, x.b) for x in dedup.similar_titles(rows).collect()} == want


def test_tags_behind_character_2000(spark):
    rows = spark.createDataFrame([(["Kilns", "absent"], "t", "it is so. " * 300 + "hot kilns")], "tags array<string>, title string, content string")
    assert rows.select(tags.clean_tags(F.col("tags"), F.col("title"), F.lit(""), F.col("content")).alias("x")).first().x == ["Kiln"]


def test_phrases_of_texts_of_one_url_as_in_sql(spark, tmp_path):
    import duckdb

    text = "Steel mill heats. Coal pit and Ore Works of Acme\nkiln halls, machine learning AIs"
    texts = [(0, "steel mills of the town"), (1, text), (2, text), (3, "kiln halls hum"), (4, None)]  # equal texts, as the SQL leaves the order of two words at one place open
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, "https://a.org/" + str(k - k // 2)) for k in range(4)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.sql("select 1L event_id, timestamp'2024-01-05 00:00:00' ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted(map(tuple, registry.phrase_stats(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(f"select canonical, freq, articles, proper from ({registry.ORACLES['phrase_stats']})").fetchall())
    assert {"mill mill heat", "artificial intelligence"} <= {x[0] for x in got}
