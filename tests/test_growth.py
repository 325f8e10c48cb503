"""Plans and steps that must not grow faster than their input."""

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_of_words_named_once(spark):
    from gleaner.operators import mining

    text = F.lit("steel AIs in Kiln feeds. kiln halls of EVs heat waves, rss feedback grows")
    want = spark.range(1).select(F.explode(mining.run_phrases(text)).alias("p")).select("p", mining.canonical(F.col("p")).alias("c")).where("length(c) >= 3 and not c rlike 'feed|rss'")
    got = spark.range(1).select(F.inline(mining.canonical_phrases(text))).select("phrase", mining.variant(F.col("canonical"), F.lower))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and ("AIs", "artificial intelligence") in map(tuple, got.collect())
    rows = spark.createDataFrame([("u", "Steel mills heat steel"), ("v", "steel mills")], "url string, text string")
    stats = mining.phrase_stats(mining.phrase_rows(rows, F.col("text")))
    assert _plan(stats).count("regexp_extract_all") == 1 and {r.canonical: (r.freq, r.articles) for r in stats.collect()}["steel mill"] == (2, 2)


def test_fallback_tags_make_noun_phrases_only_if_needed(spark):
    from gleaner.operators import mining

    rows = spark.createDataFrame([("Kiln runs. Steel melts. Ore falls",), ("kiln runs hot",)], "t string")
    df = rows.select(mining.fallback_tags(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [["Kiln", "Steel", "Ore"], ["kiln", "runs", "hot"]]
    assert "array_distinct" in _plan(df)  # of the capitalised ones, before the others are made


def test_clean_tags_make_the_text_once(spark):
    from gleaner.operators import tags

    rows = spark.createDataFrame([(["Kilns", "kiln", "Ore"], "Kilns", "hot kilns")], "tags array<string>, title string, content string")
    df = rows.select(tags.clean_tags(F.col("tags"), F.col("title"), F.lit(""), F.col("content")).alias("x"))
    assert _plan(df).count("concat_ws") == 1 and df.first().x == ["Kiln"]


def test_is_english_cuts_words_once(spark):
    from gleaner.operators import filters

    rows = spark.createDataFrame([("The work of the mill is done, and it was for all",), ("der Ofen ist heiß und das Werk",), ("123 ...",), (None,)], "t string")
    df = rows.select(filters.is_english(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [True, False, False, False] and _plan(df).count("concat_ws") == 1 and _plan(df).count("split(") == 1


def test_signs_are_looked_up_in_one_lower_case_text(spark):
    from gleaner.operators import filters

    rows = spark.createDataFrame([("t", "PIP install, npm install, Git Clone"), ("t", "plain")], "title string, content string")
    df = rows.select(filters.source_type_reason(F.col("title"), F.col("content")).alias("x"))
    assert [r.x for r in df.collect()] == ["code", "ok"] and _plan(df).count("lower(coalesce(content") == 1


def test_first_of_a_domain_is_met_by_its_order(spark):
    from gleaner.operators import select

    rows = spark.createDataFrame([(2, "https://a.org/x"), (1, "https://a.org/y"), (3, "https://b.org/"), (4, "")], "ord long, url string")
    df = select.diversity_bonus(rows)
    assert {r.ord: r.bonus for r in df.collect()} == {1: 0.3, 2: 0.0, 3: 0.3, 4: 0.0}
    assert next(x for x in _plan(df).splitlines() if "Join" in x).count(" = ") == 2  # by domain alone, one domain's rows lie in one task


def test_requests_share_partitions():
    import json

    from gleaner.sources import providers

    options = {"path": "/none", "providers": '["one"]', "phrases": json.dumps([f"p{k}" for k in range(50)]), "pages": "100", "quotas": '{"one": 7}'}
    parts = providers._Reader(options).partitions()
    asked = [x for p in parts for x in p.asked]
    assert len(parts) <= providers.MOST and [x[0] for x in asked] == list(range(5000)) and sum(len(x[3]) for x in asked) == 7


def test_grams_of_a_row_once(spark):
    from gleaner.operators import gram_index

    rows = spark.createDataFrame([(1, "aba", "ab"), (2, "", None)], "ord long, title string, content string")
    assert sorted(map(tuple, gram_index.ngrams(rows, "ord", "title", "content").collect())) == [(1, g) for g in ("a", "ab", "aba", "b", "ba")]


def test_tables_of_titles_are_not_broadcast(spark):
    from gleaner.operators import dedup

    rows = spark.createDataFrame([(k, f"https://a.org/{k}", f"the steel mill of town number {k % 3}", f"text {k}") for k in range(6)], "ord long, url string, title string, content string")
    some = [dedup.duplicate_of_any(rows.where("ord < 3"), rows.where("ord >= 3")), dedup.similar_titles(rows), dedup.first_of_similar(rows, F.col("ord"))]
    assert [df.count() for df in some] == [3, 9, 1]
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in some)


def test_state_comes_with_the_rows(spark):
    from gleaner.streaming import expiry

    df = expiry.first_within(spark.readStream.format("rate").load(), "value", "timestamp", 7)
    assert "FlatMapGroupsInPandasWithState" in df._jdf.queryExecution().analyzed().toString()  # no calls for each key


def test_a_part_of_the_stream_has_several_files(spark, tmp_path, monkeypatch):
    from gleaner.plans import flows

    rows = [(k, k % 7, f"2024-01-{1 + k // 20:02d} 00:00:{k % 20:02d}") for k in range(560)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, flows.stream_seen_expiry(spark, str(tmp_path)).collect()))
    roots = []
    monkeypatch.setattr(flows.expiry, "fresh_target", lambda base: roots.append(f"{tmp_path}/at") or roots[0])
    monkeypatch.setattr(flows, "_FILE_ROWS", 50)
    got = sorted(map(tuple, flows.stream_seen_expiry(spark, str(tmp_path)).collect()))
    assert got == want and len(want) > 7 and len(list((tmp_path / "at" / "in").glob("part-*"))) == 8


def test_few_pages_are_strings_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from gleaner.operators import extract

    html = pa.array([None, *[f"<p>{k} {'steel mill ' * 2000}</p>" for k in range(300)]])
    want = [extract.readable(x) for x in html.to_pylist()]
    tracemalloc.start()
    got = extract.readable_text.func(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want and peak < html.nbytes / 2


def test_phrases_are_dealt_out_as_counts(spark):
    import random

    from gleaner.operators import mining, phrase_counts

    r = random.Random(3)
    vocabulary = ["steel", "Steel", "mills", "mill,", "the", "of", "AI", "EVs", "Machine", "learning", "Bank", "of", "New", "York", "feedback", "12", "heats.", "(ore)", "Éric", "élan", "U.S.", "classes", "stories!", "İz", "net"]
    rows = spark.createDataFrame([(f"u{k}" if k else None, " ".join(r.choices(vocabulary, k=60))) for k in range(80)], "url string, text string")
    want = mining.phrase_stats(mining.phrase_rows(rows, F.col("text")))
    got = phrase_counts.stats(rows.repartition(5), F.col("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(canonical" not in plan and "hashpartitioning(share" in plan


def test_keywords_are_mined_without_phrases_as_rows(spark, monkeypatch):
    from gleaner.operators import mining
    from gleaner.plans import registry

    rows = spark.createDataFrame([(k, f"u{k % 3}", "Steel Mill", "Acme steel mills heat. steel MILL and EVs, AI; the Bank of New York") for k in range(4)], "ord long, url string, title string, content string")
    monkeypatch.setattr(registry, "articles", lambda spark, sf: rows.where("ord < 3"))
    text = F.concat_ws(" . ", "title", "content")
    phrases = mining.phrase_rows(rows.where("ord < 3"), text)
    best = mining.composite(mining.phrase_stats(phrases)).join(mining.best_casing(phrases), "canonical")
    got = registry.keyword_composite_top150(spark, "")
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in best.select("canonical", "casing", "score").collect()} and got.count() > 10
    assert "regexp_extract_all" not in _plan(got)


def test_keywords_meet_texts_where_they_lie(spark):
    from gleaner.operators import match

    pool = spark.createDataFrame([(1, "a", "steel mills, C++ and mill_x", "_x"), (1, "b", "ore of the mill", None), (2, "c", None, "x_ore mills"), (None, "d", "ore", "ore")], "ord long, url string, title string, description string")
    words = spark.createDataFrame([("Ore, mill",), ("c++",), ("steel mills",), ("mill_",), ("_x",), ("",)], "keyword string")
    cached = spark.createDataFrame([("b", ["Mill", "ORE", None]), ("c", None), ("c", ["c++"])], "url string, keywords array<string>")
    found = match.pool_matches(pool, words, cached)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "Ore, mill", "tag"), (1, "c++", "text"), (1, "steel mills", "text"), (1, "mill_", "text"), (1, "_x", "text"), (2, "c++", "tag"), (None, "Ore, mill", "text")], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(run" not in plan and "hashpartitioning(word" not in plan


def test_keywords_in_parts(spark, monkeypatch):
    from gleaner.operators import match

    texts = spark.createDataFrame([(k, f"word{k} and word{k + 1}") for k in range(9)], "ord long, text string")
    words = spark.createDataFrame([(f"word{k}",) for k in range(10)], "word string")
    monkeypatch.setattr(match, "WORDS", 3, raising=False)
    found = match.whole_words(texts, words, "ord")
    assert sorted(map(tuple, found.collect())) == sorted((k, f"word{j}") for k in range(9) for j in (k, k + 1)) and _plan(found).count("MapInArrow") == 4


def test_candidates_are_looked_for_among_rows_that_pass(spark):
    from gleaner.operators import match
    from gleaner.sources import views

    pool = spark.createDataFrame([(3, "u", "ore", "en"), (1, "u", "tin", "en"), (2, "u", "ore", "de"), (4, "v", "ore", "en"), (5, "", "ore", "en"), (6, "w", "tin", "en")], "ord long, url string, title string, lang string")
    words, cached = spark.createDataFrame([("ore",)], "keyword string"), spark.createDataFrame([("w", ["Ore"]), ("u", [])], "url string, keywords array<string>")
    seen = spark.createDataFrame([("v",)], "url string").selectExpr("sha2(url, 256) url_hash")
    got = match.candidates(pool, words, cached, seen, F.col("lang") == "en", ("title",))
    assert sorted((r.ord, r.keywords) for r in got.collect()) == [(3, None), (6, ["Ore"])]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    titles = views.articles(spark, "/root/testdata/sf0.001").select("ord", "title")
    assert "split_part" not in _plan(titles).split("Join", 1)[0]  # a title is made before rows are dealt out
