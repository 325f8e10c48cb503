"""Queries of the operators over stored articles, and of a whole refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import library, select, tags, watch
from gleaner.plans import sql as S
from gleaner.plans.registry import FALLBACK_TAGS, query
from gleaner.sources.views import ARTICLES, NOW, TAGGED, articles, load, tagged


@query(f"WITH {ARTICLES} SELECT ord, url, 'dashboard' AS part FROM articles WHERE ord % 4 = 0")
def startup_dashboard(spark, sf):
    a = articles(spark, sf).select("ord", "url")
    return library.startup(a.where("ord % 4 = 0").withColumn("part", F.lit("dashboard")), a.withColumn("part", F.lit("stored")))


@query(f"WITH {ARTICLES} SELECT ord, url, 'stored' AS part FROM articles")
def startup_without_dashboard(spark, sf):
    a = articles(spark, sf).select("ord", "url")
    return library.startup(a.where("ord < 0").withColumn("part", F.lit("dashboard")), a.withColumn("part", F.lit("stored")))


@query(f"WITH {ARTICLES}, s AS (SELECT trim(url) AS u, arg_max(nullif(title, ''), ord) FILTER (nullif(title, '') IS NOT NULL) AS t, arg_max(published_at, ord) AS p FROM articles WHERE ord % 2 = 0 GROUP BY 1) "
       f"SELECT ord, coalesce(CASE WHEN ord % 3 <> 0 THEN nullif(title, '') END, t) AS title, coalesce(CASE WHEN ord % 5 <> 0 THEN published_at END, p, CASE WHEN ord % 10 <> 5 THEN 'added' END, '{NOW}') AS published_at "
       "FROM articles a LEFT JOIN s ON s.u = trim(a.url) WHERE ord % 3 <> 0 AND nullif(title, '') IS NOT NULL OR t IS NOT NULL")
def metadata_backfill(spark, sf):
    """Rows whose title is known in some store; titles made from urls are the query title_from_slug."""
    a = articles(spark, sf).select("ord", "url", "title", "published_at")
    stores = a.where("ord % 2 = 0")
    known = stores.where("title <> ''").select(F.trim("url").alias("u")).distinct()
    rows = a.withColumns({"title": F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("title")), "published_at": F.when(F.col("ord") % 5 != 0, F.col("published_at")),
                          "added_at": F.when(F.col("ord") % 10 != 5, "added")})
    some = rows.join(known, F.trim("url") == F.col("u"), "left").where("title <> '' or u is not null").drop("u")
    return library.backfill_metadata(some, stores, NOW).select("ord", "title", "published_at")


_STRIP = lambda t: f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


# A title is a cached one's beginning or equal to it but for marks, so the ratio is that of the lengths.
@query(f"""WITH {TAGGED}, f AS (SELECT *, left(content, 200) AS summary FROM tagged QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1),
c AS (SELECT ord, tags, ord % 2 = 0 AS cached, ord % 5 <> 0 OR {S.content_hash("'another'")} = {S.content_hash('summary')} AS same,
 length({_STRIP('title')}) AS n, CASE WHEN ord % 3 = 0 THEN length('andagreatdealmore') ELSE 0 END AS more FROM f),
h AS (SELECT ord, tags, cached AND same AND n > 0 AND 2.0 * n / (2 * n + more) >= 0.95 AS hit FROM c) SELECT ord, hit, CASE WHEN hit THEN tags END AS tags FROM h""")
def tag_cache_hits(spark, sf):
    """Cached tags by url, like title and equal summary; every third cached title is longer, every fifth summary another."""
    t = tagged(spark, sf).withColumn("summary", F.left("content", F.lit(200)))
    t = select.first_wins(t, "url")
    cache = t.where("ord % 2 = 0").select("url", F.when(F.col("ord") % 3 == 0, F.concat("title", F.lit(" and a great deal more"))).otherwise(F.concat(F.lit("! "), "title")).alias("title"),
                                          F.when(F.col("ord") % 5 == 0, "another").otherwise(F.col("summary")).alias("summary"), "tags")
    return library.tag_cache_hits(t, cache)


@query(f"WITH {TAGGED}, k AS (SELECT ord, title, CASE WHEN ord % 3 = 0 THEN ['Manufacturing', 'General'] ELSE tags END AS tags FROM tagged) SELECT ord, CASE WHEN {S.stale('tags', 'title')} THEN [] ELSE tags END AS tags FROM k")
def stale_tags_dropped(spark, sf):
    t = tagged(spark, sf).withColumn("tags", F.when(F.col("ord") % 3 == 0, X.words(["Manufacturing", "General"])).otherwise(F.col("tags")))
    return library.drop_stale(t).select("ord", "tags")


@query(f"WITH {TAGGED}, c AS (SELECT ord, ['ai', 'steel'] AS chips, CASE WHEN ord % 2 = 0 THEN 'ai' ELSE source END AS chip FROM tagged) "
       "SELECT ord, CASE WHEN list_contains(chips, chip) THEN list_filter(chips, lambda x: x <> chip) ELSE list_append(chips, chip) END AS chips FROM c")
def chip_toggle(spark, sf):
    chip = F.when(F.col("ord") % 2 == 0, "ai").otherwise(F.col("source"))
    return tagged(spark, sf).select("ord", library.toggle(X.words(["ai", "steel"]), chip).alias("chips"))


@query(f"WITH {ARTICLES}, {FALLBACK_TAGS}, k AS (SELECT url, arg_min(source, ord) AS s FROM articles WHERE ord % 4 = 0 GROUP BY 1) SELECT a.ord, CASE WHEN k.s IS NOT NULL THEN [k.s] ELSE m.tags END AS keywords FROM articles a LEFT JOIN k USING (url) LEFT JOIN made m ON m.ord = a.ord")
def article_keywords(spark, sf):
    t = tagged(spark, sf)
    return library.keywords_from_fallback(t, select.first_wins(t.where("ord % 4 = 0"), "url").select("url", F.array("source").alias("keywords"))).select("ord", "keywords")


@query(f"WITH {ARTICLES}, k AS (SELECT ord, CASE ord % 3 WHEN 0 THEN [] WHEN 1 THEN [source, 'AI'] ELSE [source, lang, 'Steel', 'Kiln'] END AS raw FROM articles), "
       f"f AS (SELECT ord, list_concat(list_filter(raw, lambda t: trim(t) <> '' AND lower(trim(t)) NOT IN {S.inlist(C.FORBIDDEN_KEYWORDS)}), {list(C.FALLBACK_TAGS)}) AS k FROM k) "
       "SELECT ord, list_slice(list_filter(k, lambda t, i: list_position(list_transform(k, lambda x: lower(x)), lower(t)) = i), 1, 3) AS keywords FROM f")
def model_keywords_to_three(spark, sf):
    raw = (F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).when(F.col("ord") % 3 == 1, F.array(F.concat(F.lit(" "), "source"), F.lit("AI"), F.lit("News")))
           .otherwise(F.array("source", "lang", F.lit("Steel"), F.lit("Kiln"))))
    return articles(spark, sf).select("ord", library.three_keywords(raw).alias("keywords"))


_TOPICS = [("ther", "On this", "https://one-mock.com/1"), ("ung", "On that", "https://two-mock.com/2"), ("th", "On both", "https://three-mock.com/3")]
_VALUES = ", ".join("(" + ", ".join(map(S.lit, t)) + ")" for t in _TOPICS)


@query(f"WITH {ARTICLES}, t(topic, title, url) AS (VALUES {_VALUES}), h AS (SELECT a.ord, a.title AS phrase, t.topic, t.title FROM articles a JOIN t ON contains(lower(a.title), t.topic)) "
       "SELECT * FROM h UNION ALL SELECT ord, title, NULL, 'Latest on ' || title FROM articles WHERE title NOT IN (SELECT phrase FROM h)")
def mock_news(spark, sf):
    topics = spark.createDataFrame(_TOPICS, "topic string, title string, url string")
    return library.mock_rows(articles(spark, sf).select("ord", F.col("title").alias("phrase")), topics).select("ord", "phrase", "topic", "title")


@query(f"WITH {TAGGED}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM tagged) SELECT tag, lower(tag) AS sort_key FROM t")
def sidebar_order(spark, sf):
    return tagged(spark, sf).select(F.explode("tags").alias("tag")).distinct().withColumn("sort_key", F.lower("tag")).orderBy("sort_key", "tag")


@query(f"WITH {ARTICLES} SELECT ord, url FROM articles")
def shuffled_articles(spark, sf):
    return select.shuffled(articles(spark, sf).select("ord", "url"), 7)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS request_count FROM events WHERE event_type = 'click' GROUP BY 1")
def usage_log_counts(spark, sf):
    log = load(spark, sf, "events").where("event_type = 'click'").select(F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("n"))
    return log.groupBy("day").agg(F.sum("n").alias("request_count"))


@query(f"WITH {TAGGED}, b AS (SELECT url, arg_min(source, ord) AS s FROM tagged WHERE ord % 4 = 0 GROUP BY 1), "
       "k AS (SELECT ord, CASE WHEN ord % 2 <> 0 AND len(tags) > 0 THEN tags WHEN s IS NOT NULL THEN [s] ELSE [] END AS tags FROM tagged LEFT JOIN b USING (url) WHERE title IS NOT NULL), t AS (SELECT trim(unnest(tags)) AS t, ord FROM k) "
       f"SELECT {S.display_tag('t')} AS tag, count(*) AS n, min(ord) AS first_ord FROM t WHERE t <> '' GROUP BY 1")
def library_keyword_counts(spark, sf):
    t = tagged(spark, sf)
    some = t.withColumn("tags", F.when(F.col("ord") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("tags")))
    table = select.first_wins(t.where("ord % 4 = 0"), "url").select("url", F.array("source").alias("keywords"))
    return library.counts_of_library(some, table)


@query()
def refresh_results(spark, sf):
    """A refresh from candidates to the list shown: verdicts, two passes by domain, cleaned tags or fallbacks, summaries, scores."""
    from gleaner.operators import enrich, score

    a = tagged(spark, sf).withColumn("summary", enrich.fallback_summary(F.col("title"), F.col("content")))
    seen = a.where("ord % 11 = 0").select(X.hash_of(F.trim("url")).alias("url_hash"))
    judged = watch.verdicts(a, seen, "This with thaner", english=F.col("lang") == "en")
    shown = library.accepted(a, judged, 50)
    made = tags.clean_tags(F.col("tags"), F.col("title"), F.col("summary"), F.col("content"))
    total = score.recency(F.col("published_at"), NOW) + score.keyword_match("the, this, die", F.col("title"), F.col("content"))
    shown = shown.withColumn("tags", F.when(F.size(made) > 0, made).otherwise(X.words(["Manufacturing"]))).withColumn("score", F.round(total, 3))
    return shown.select("ord", "url", "title", "tags", "pass", "score").orderBy(F.desc("score"), "ord")
