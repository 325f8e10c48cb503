"""Queries of the sources, stores and service operators; responses are built from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import dedup, refresh, select, state, watch
from gleaner.plans import sql as S
from gleaner.plans.registry import _PRIORITY, query
from gleaner.sources import feeds, stores
from gleaner.sources.views import ARTICLES, NOW, TAGGED, articles, load, tagged

PAGE = 10  # items of one response


def _root(spark, name: str) -> str:
    return f"{stores.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bodies(rows, field, item):
    """One JSON body per PAGE articles, in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))), lambda x: x.i)
    return rows.groupBy(F.floor(F.col("ord") / PAGE).cast("long").alias("request")).agg(F.to_json(F.struct(items.alias(field))).alias("body"))


def _some(column, every):
    return F.when(F.col("ord") % every != 0, column)


# -- sources ---------------------------------------------------------------------------------------------------------

@query(f"WITH {ARTICLES} SELECT title, url, CASE WHEN ord % 4 = 0 THEN 'search' ELSE source END AS source, published_at, CASE WHEN ord % 3 = 0 THEN '' ELSE lang END AS description FROM articles WHERE title <> '' AND ord % 9 <> 0")
def source_search_pages(spark, sf):
    item = F.struct("title", _some(F.col("url"), 9).alias("url"), F.struct(_some(F.col("source"), 4).alias("name")).alias("source"), F.col("published_at").alias("publishedAt"), _some(F.col("lang"), 3).alias("description"))
    return feeds.search_pages(_bodies(articles(spark, sf), "articles", item), "search").drop("ord")


@query(f"WITH {ARTICLES}, q AS (SELECT *, row_number() OVER (PARTITION BY CAST(published_ts AS DATE) ORDER BY ord) AS rn FROM articles WHERE ord % 5 <> 0) SELECT title, url, CASE WHEN ord % 4 = 0 THEN 'results' ELSE source END AS source, published_at, '' AS description FROM q WHERE rn <= 3 AND title <> ''")
def source_result_pages_quota(spark, sf):
    item = F.struct("title", F.col("url").alias("link"), _some(F.col("source"), 4).alias("source_id"), F.col("published_at").alias("pubDate"))
    asked = articles(spark, sf).select(F.col("ord").alias("request"), F.to_date("published_ts").alias("day"), F.when(F.col("ord") % 5 == 0, 2).otherwise(1).alias("page"), F.to_json(F.struct(F.array(item).alias("results"))).alias("body"))
    return feeds.result_pages(asked, "results", quota=3).drop("ord")


@query(f"WITH {ARTICLES} SELECT title, url, 'Stories' AS source, published_at, 'Stories story by ' || CASE WHEN ord % 3 = 0 THEN 'unknown' ELSE lang END || '. Points: ' || ord || '.' AS description FROM articles WHERE ord % 4 <> 0 AND ord % 7 <> 0")
def source_stories(spark, sf):
    title = F.when(F.col("ord") % 4 == 0, F.concat(F.lit(" Ask HN: "), "title")).otherwise(F.col("title"))
    url = F.when(F.col("ord") % 14 == 0, "https://stories.example/item?id=1").when(F.col("ord") % 7 != 0, F.col("url"))
    item = F.struct(title.alias("title"), url.alias("url"), F.col("published_at").alias("created_at"), _some(F.col("lang"), 3).alias("author"), F.col("ord").alias("points"))
    return feeds.stories(_bodies(articles(spark, sf), "hits", item), "Stories", "stories.example/item").drop("ord")


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _feeds(spark, sf):
    a = articles(spark, sf)
    rss = F.format_string("<item><title>%s</title><link>%s</link><description>%s</description><pubDate>%s</pubDate></item>", _xml(F.col("title")), _xml(F.col("url")), F.col("lang"), F.col("published_at"))
    atom = F.format_string('<entry><title>%s</title><link href="%s"/><summary>%s</summary><updated>%s</updated></entry>', _xml(F.col("title")), _xml(F.col("url")), F.col("lang"), F.col("published_at"))
    request = F.floor(F.col("ord") / PAGE).cast("long")
    made = a.withColumn("request", request).groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.when(F.col("request") % 2 == 0, rss).otherwise(atom).alias("x")))), lambda x: x.x), "").alias("x"))
    return made.select("request", F.lit("feed").alias("name"), F.when(F.col("request") % 2 == 0, F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), "x", F.lit("</feed>"))).alias("body"))


_FEED = f"f AS (SELECT ord, trim(title) AS title, url, 'feed' AS source, published_at, lang AS description FROM articles WHERE trim(title) <> '')"


@query(f"WITH {ARTICLES}, {_FEED} SELECT title, url, source, published_at, description FROM f")
def source_feed_items(spark, sf):
    return feeds.feed_items(_feeds(spark, sf)).drop("ord")


@query(f"WITH {ARTICLES}, {_FEED}, h AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM f WHERE contains(lower(title || ' ' || description), 'ther') OR contains(lower(title || ' ' || description), 'en')), "
       f"d AS (SELECT *, {S.domain('url')} AS domain, row_number() OVER (PARTITION BY {S.domain('url')} ORDER BY ord) AS domain_rank FROM h WHERE rn = 1) SELECT title, url, domain, domain_rank FROM d WHERE domain_rank <= 3 ORDER BY ord LIMIT 15")
def source_feed_search(spark, sf):
    return feeds.feed_search(_feeds(spark, sf), ["ther", "EN"]).select("title", "url", "domain", "domain_rank")


@query("SELECT * FROM (VALUES ('ai', 'One', 'https://a.example/rss'), ('ai', 'Two', 'https://b.example/rss'), ('energy', 'Three', 'https://c.example/rss')) AS t(category, name, url)")
def source_registry(spark, sf):
    body = '{"ai": [{"name": "One", "url": "https://a.example/rss"}, {"name": "Two", "url": "https://b.example/rss"}, {"name": "No url"}], "energy": [{"name": "Three", "url": "https://c.example/rss"}, {"name": "", "url": "https://d.example"}], "none": []}'
    return feeds.registry(spark.range(1).select(F.lit(body).alias("body")))


_COMPANIES = {b: f"{b} AI technology" for b in C.BRANDS}


@query(f"WITH {ARTICLES} SELECT ord, url, list_element({list(C.BRANDS)}, CAST(ord % 4 AS INT) + 1) AS company, true AS is_pinned FROM articles WHERE ord % 4 < 3")
def source_pinned(spark, sf):
    phrase = F.element_at(X.words([*_COMPANIES.values(), "other"]), (F.col("ord") % 4 + 1).cast("int"))
    return feeds.pinned(_COMPANIES, articles(spark, sf).withColumn("phrase", phrase)).select("ord", "url", "company", "is_pinned")


@query(f"WITH {ARTICLES} SELECT ord, url, title, 36.0::DOUBLE AS age_hours FROM articles WHERE ord % 2 = 0")
def pool_store_and_age(spark, sf):
    root = _root(spark, "pool")
    feeds.save_pool(articles(spark, sf).where("ord % 2 = 0").select("ord", "url", "title"), root, "2024-01-30T12:00:00Z")
    return feeds.load_pool(spark, root, "ord long, url string, title string").withColumn("age_hours", F.lit(feeds.pool_age_hours(spark, root, NOW)))


@query(f"WITH {TAGGED}, t AS (SELECT unnest(tags) AS keyword, ord FROM tagged), g AS (SELECT keyword, min(ord) AS o FROM t GROUP BY 1) SELECT row_number() OVER (ORDER BY o, keyword) AS pos, keyword FROM g ORDER BY pos LIMIT 150")
def keyword_store_ordered(spark, sf):
    g = tagged(spark, sf).select(F.explode("tags").alias("keyword"), "ord").groupBy("keyword").agg(F.min("ord").alias("o")).orderBy("o", "keyword").limit(150)
    root = _root(spark, "keywords")
    feeds.save_ordered(g.agg(F.array_sort(F.collect_list(F.struct("o", "keyword"))).alias("k")).select(F.posexplode("k").alias("p", "x")).select((F.col("p") + 1).cast("long").alias("pos"), "x.keyword"), root)
    return spark.read.schema("pos long, keyword string").json(root)


# -- watched keywords and pins ---------------------------------------------------------------------------------------

_WATCH = TAGGED + ", k AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN replace(replace(upper(tags[1]), 'ß', 'SS'), 'ẞ', 'SS') ELSE ' ' || tags[1] END AS keyword, ord % 4 = 0 AS is_processed FROM tagged WHERE len(tags) > 0)"


def _watched(spark, sf):
    t = tagged(spark, sf).where(F.size("tags") > 0)
    return t.select("ord", F.when(F.col("ord") % 2 == 0, F.upper(F.get("tags", F.lit(0)))).otherwise(F.concat(F.lit(" "), F.get("tags", F.lit(0)))).alias("keyword"), (F.col("ord") % 4 == 0).alias("is_processed"))


def _first(where="true"):
    return f"(SELECT min(ord) AS ord, arg_min(trim(keyword), ord) AS keyword, arg_min(is_processed, ord) AS is_processed FROM k WHERE {where} GROUP BY lower(trim(keyword)))"


@query(f"WITH {_WATCH} SELECT * FROM {_first()}")
def watch_distinct(spark, sf):
    return watch.distinct_keywords(_watched(spark, sf))


@query(f"WITH {_WATCH}, o AS {_first('ord % 3 = 0')}, n AS {_first('ord % 3 <> 1')} SELECT n.ord, n.keyword, coalesce(o.is_processed, false) AS is_processed FROM n LEFT JOIN o ON lower(o.keyword) = lower(n.keyword)")
def watch_save_keeps_state(spark, sf):
    k = _watched(spark, sf)
    return watch.save_keywords(k.where("ord % 3 <> 1"), k.where("ord % 3 = 0"))


@query(f"WITH {_WATCH}, o AS {_first('ord % 3 = 0')}, n AS {_first('ord % 3 = 1')} SELECT keyword, is_processed FROM o WHERE lower(keyword) NOT LIKE 't%' UNION ALL SELECT keyword, false FROM n WHERE lower(keyword) NOT IN (SELECT lower(keyword) FROM o) AND lower(keyword) NOT LIKE 't%'")
def watch_add_and_remove(spark, sf):
    k = _watched(spark, sf)
    both = watch.add_keywords(k.where("ord % 3 = 0"), k.where("ord % 3 = 1"))
    return watch.remove_keywords(both, k.where("lower(trim(keyword)) LIKE 't%'")).select("keyword", "is_processed")


@query(f"WITH {_WATCH}, o AS (SELECT * FROM {_first()} WHERE NOT is_processed) SELECT ord, keyword, CAST(floor(5 + (row_number() OVER (ORDER BY ord) - 1) / (SELECT count(*) FROM o)::DOUBLE * 90) AS INT) AS progress FROM o")
def watch_progress(spark, sf):
    return watch.unprocessed_progress(watch.distinct_keywords(_watched(spark, sf)))


@query(f"WITH {ARTICLES} SELECT url, CASE WHEN bool_or(ord % 15 = 0) THEN 'new' ELSE 'old' END AS title FROM articles WHERE (ord % 10 = 0 OR ord % 15 = 0) AND url NOT IN (SELECT url FROM articles WHERE ord % 40 = 0) GROUP BY url")
def pin_and_unpin(spark, sf):
    a = articles(spark, sf).select("ord", "url")
    pins = watch.pin(a.where("ord % 10 = 0").withColumn("title", F.lit("old")), a.where("ord % 15 = 0").withColumn("title", F.lit("new")))
    return watch.unpin(pins, a.where("ord % 40 = 0")).select("url", "title")


# -- candidates and pools --------------------------------------------------------------------------------------------

_EARLY = (f"CASE WHEN {S.url_reason('url')} <> 'ok' THEN 'invalid_url' WHEN url IN (SELECT url FROM articles WHERE ord % 11 = 0) THEN 'duplicate_urls' WHEN lang <> 'en' THEN 'non_english_metadata' "
          f"WHEN {S.count_in('lower(title)', C.TITLE_PHRASES)} > 0 THEN 'invalid_source_type' WHEN {S.any_whole_word("title || ' ' || url", C.TOPICS)} THEN 'failed_relevance_validation' "
          f"WHEN {S.source_type_reason('title', 'content')} <> 'ok' THEN 'invalid_source_type' WHEN {S.content_reason('content')} <> 'ok' THEN 'low_quality_content' "
          f"WHEN least({S.count_in("lower(title || '  ' || substr(content, 1, 1000))", _PRIORITY)} * 20, 100) < 40 THEN 'failed_relevance_validation' END")


VERDICTS = (f"WITH {ARTICLES}, e AS (SELECT *, {_EARLY} AS early, {S.norm_title('title')} AS nt FROM articles), u AS (SELECT *, row_number() OVER (PARTITION BY url, early IS NULL ORDER BY ord) AS ru FROM e), "
            f"v AS (SELECT *, row_number() OVER (PARTITION BY nt, early IS NULL AND ru = 1 ORDER BY ord) AS rv FROM u), verdicts AS (SELECT ord, coalesce(early, CASE WHEN ru > 1 OR (nt <> '' AND rv > 1) THEN 'duplicate_urls' WHEN NOT {S.summary_ok('substr(content, 1, 120)', 'title')} THEN 'failed_summary_validation' ELSE 'accepted_articles' END) AS reject_reason FROM v)")


@query(VERDICTS + " SELECT ord, reject_reason FROM verdicts")
def candidate_verdicts(spark, sf):
    a = articles(spark, sf).withColumn("summary", F.left("content", F.lit(120)))
    seen = a.where("ord % 11 = 0").select(X.hash_of(F.trim("url")).alias("url_hash"))
    return watch.verdicts(a, seen, "This with thaner", english=F.col("lang") == "en").select("ord", "reject_reason")


@query(f"WITH {ARTICLES}, p AS (SELECT ord, url, lang, ord % 3 AS priority FROM articles WHERE lang <> 'en' OR ord % 3 > 0), b AS (SELECT * FROM p WHERE priority = (SELECT min(q.priority) FROM p q WHERE q.lang = p.lang)), "
       "o AS (SELECT lang, min(ord) AS ord FROM b WHERE url NOT IN (SELECT url FROM articles WHERE ord % 8 = 0) GROUP BY url, lang), f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord) AS topic_rank FROM o) SELECT ord, lang, topic_rank FROM f WHERE topic_rank <= 25")
def article_pool(spark, sf):
    """Per topic the first provider with rows; first of each url; unseen; at most a quarter of 100 per topic."""
    a = articles(spark, sf).withColumn("priority", F.col("ord") % 3).where("lang <> 'en' OR priority > 0")
    found = select.first_wins(dedup.first_provider(a, "lang"), "url")
    new = state.unseen(found, articles(spark, sf).where("ord % 8 = 0").select(X.hash_of(F.trim("url")).alias("url_hash")))
    return select.topic_quota(new.withColumn("topic_idx", F.lit(0)), 100, 4, "lang").select("ord", "lang", "topic_rank")


@query(f"WITH {ARTICLES}, s AS (SELECT ord FROM articles WHERE lower(source) IN (SELECT lower(source) FROM articles WHERE ord = 1) ORDER BY ord LIMIT 20) SELECT ord FROM s")
def sources_and_limit(spark, sf):
    a = articles(spark, sf)
    named = a.where("ord = 1").select(F.lower("source").alias("_s"))
    return a.join(named, F.lower("source") == F.col("_s"), "left_semi").orderBy("ord").limit(20).select("ord")


@query(f"WITH {TAGGED} SELECT ord FROM tagged WHERE contains(lower(title), 'ther') OR contains(lower(content), 'ther') OR len(list_filter(tags, lambda t: contains(lower(t), 'ther'))) > 0")
def text_and_tag_search(spark, sf):
    return tagged(spark, sf).where(watch.text_search(" THER", "title", "content", tags="tags")).select("ord")


@query("SELECT doc_id, doc_id % 5 AS kind FROM documents WHERE doc_id % 5 < 3 UNION SELECT doc_id, 4 FROM documents WHERE doc_id % 10 = 3")
def insert_if_absent(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("kind"))
    new = d.where("kind = 1").unionByName(d.where("doc_id % 10 = 3").select("doc_id", F.lit(4).cast("long").alias("kind")))
    return state.insert_if_absent(d.where("kind < 3"), new, ["doc_id", "kind"])


# -- texts and display -----------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents), n AS (SELECT *, len(list_filter(regexp_split_to_array(block, '\\s+'), lambda w: w <> '')) AS n FROM b WHERE length(trim(block)) > 30),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM n) SELECT doc_id, place, block FROM w WHERE before < 250 AND k <= 8""")
def first_blocks(spark, sf):
    """The first lines of each text of over 30 characters, until there are 250 words or eight of them."""
    b = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "block")).where(F.length(F.trim("block")) > 30)
    return refresh.first_blocks(b, "doc_id", "place", "block")


@query("SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''), 1, 250), ' ') AS content FROM documents")
def word_cap_250(spark, sf):
    return load(spark, sf, "documents").select("doc_id", watch.first_words(F.col("text")).alias("content"))


@query(f"WITH {ARTICLES} SELECT ord, '[\"' || lang || '\"]' AS inner_json FROM articles")
def code_fences(spark, sf):
    body = F.concat(F.lit('["'), "lang", F.lit('"]'))
    raw = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("```"), body, F.lit("```"))).otherwise(body)
    return articles(spark, sf).select("ord", watch.unfenced(raw).alias("inner_json"))


_LAST = "split_part(list_extract(list_concat([''], list_filter(string_split(coalesce(url, ''), '/'), lambda p: p <> '')), -1), '?', 1)"
for _end in C.PAGE_ENDS:
    _LAST = f"regexp_replace({_LAST}, '\\{_end}$', '')"


@query(f"WITH b AS (SELECT page_id, trim(translate({_LAST}, '-_', '  ')) AS t FROM pages) SELECT page_id, CASE WHEN t = '' THEN 'URL Article' ELSE {S.title_case('t')} END AS title FROM b")
def title_from_slug(spark, sf):
    return load(spark, sf, "pages").select("page_id", watch.slug_title(F.col("url")).alias("title"))


@query("SELECT event_id, CASE WHEN event_id % 100000 <= 50 THEN 'Scheduled Refresh Pending...' ELSE CASE WHEN (event_id % 100000 - 50) // 3600 > 0 THEN ((event_id % 100000 - 50) // 3600) || 'h ' ELSE '' END || ((event_id % 100000 - 50) % 3600 // 60) || 'm ' || ((event_id % 100000 - 50) % 60) || 's' END AS time_left FROM events")
def countdown(spark, sf):
    return load(spark, sf, "events").select("event_id", watch.countdown(F.col("event_id") % 100000 - 50).alias("time_left"))


@query(f"WITH {ARTICLES} SELECT ord, CASE WHEN ord % 5 = 0 THEN 'soon' ELSE strftime(published_ts, '%b %-d, %Y') END AS shown FROM articles")
def display_date(spark, sf):
    return articles(spark, sf).select("ord", watch.display_date(F.when(F.col("ord") % 5 == 0, "soon").otherwise(F.col("published_at"))).alias("shown"))


@query(f"WITH {ARTICLES} SELECT ord, CASE WHEN ord % 7 = 0 THEN NULL ELSE ['NVIDIA', 'OpenAI', source][ord % 3 + 1] END AS label FROM articles")
def brand_label(spark, sf):
    company = F.when(F.col("ord") % 3 == 0, "nvidia corp").when(F.col("ord") % 3 == 1, "The OPENAI lab").otherwise(F.col("source"))
    return articles(spark, sf).select("ord", watch.brand_label(company, F.col("ord") % 7 != 0).alias("label"))


@query(f"WITH {TAGGED}, t AS (SELECT DISTINCT unnest(tags) AS phrase FROM tagged UNION SELECT 'machine learning') SELECT phrase, CASE WHEN phrase = 'machine learning' THEN 'Machine Learning' END AS casing FROM t")
def canonical_casing(spark, sf):
    t = tagged(spark, sf).select(F.explode("tags").alias("phrase")).unionByName(spark.range(1).select(F.lit("machine learning").alias("phrase"))).distinct()
    return t.select("phrase", watch.canonical_casing(F.col("phrase")).alias("casing"))


@query("SELECT event_type, coalesce(round(avg(event_id), 3), 0)::DOUBLE AS mean, count(*) FILTER (user_id % 2 = 0) AS hits, count(*) FILTER (user_id % 2 <> 0) AS misses FROM events GROUP BY 1")
def averages_and_hits(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy("event_type").agg(F.coalesce(F.round(F.avg("event_id"), 3), F.lit(0.0)).alias("mean"), F.count_if(F.col("user_id") % 2 == 0).alias("hits"), F.count_if(F.col("user_id") % 2 != 0).alias("misses"))


@query(f"WITH {ARTICLES} SELECT CASE WHEN ord % 10 = 0 THEN 'pinned' ELSE 'feed' END AS section, count(*) AS n FROM articles GROUP BY 1")
def section_counts(spark, sf):
    return articles(spark, sf).groupBy(F.when(F.col("ord") % 10 == 0, "pinned").otherwise("feed").alias("section")).agg(F.count("*").alias("n"))
