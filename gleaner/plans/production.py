"""Queries of production, JSON stores and the overlay by all rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import dedup, filters, production, search, select, state
from gleaner.plans import sql as S
from gleaner.plans.registry import ORACLES, T, docs, query
from gleaner.sources import stores
from gleaner.sources.views import ARTICLES, NOW, articles

PAGE = 10  # items of one file


# -- stores ----------------------------------------------------------------------------------------------------------

def _files(rows, item, kind=None):
    """One JSON list per PAGE articles, in order; of another shape where `kind` says so."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))), lambda x: x.i)
    body = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    request = F.floor(F.col("ord") / PAGE).cast("long")
    return rows.groupBy(request.alias("request")).agg(body.alias("body")).withColumn("body", kind(F.col("request"), F.col("body")) if kind else F.col("body"))


@query(f"WITH {ARTICLES} SELECT url, title FROM articles WHERE ord // {PAGE} % 4 < 2")
def pinned_store_shapes(spark, sf):
    shape = lambda r, b: F.when(r % 4 == 1, F.concat(F.lit('{"articles": '), b, F.lit("}"))).when(r % 4 == 2, F.concat(F.lit('{"rows": '), b, F.lit("}"))).when(r % 4 == 3, "[{not json").otherwise(b)
    return stores.pinned(_files(articles(spark, sf), F.to_json(F.struct("url", "title")), shape), "url string, title string").select("url", "title")


@query(f"WITH {ARTICLES} SELECT url, arg_max(published_at, ord) AS entry FROM articles WHERE ord // {PAGE} % 5 <> 0 GROUP BY url, ord // {PAGE}")
def seen_store(spark, sf):
    last = articles(spark, sf).groupBy(F.floor(F.col("ord") / PAGE).cast("long").alias("request"), "url").agg(F.max_by("published_at", "ord").alias("at"))
    files = last.groupBy("request").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("url", "at")))).alias("body"))
    return stores.seen(files.withColumn("body", F.when(F.col("request") % 5 == 0, "[corrupt").otherwise(F.col("body"))))


@query(f"WITH {ARTICLES}, k AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN upper(source) ELSE source END || '-' || (ord % 50) AS keyword, ord % 2 = 0 AND ord % 4 = 0 AS is_processed FROM articles) SELECT arg_min(keyword, ord) AS keyword, arg_min(is_processed, ord) AS is_processed FROM k GROUP BY lower(keyword)")
def watched_store(spark, sf):
    keyword = F.concat(F.when(F.col("ord") % 3 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("-"), F.col("ord") % 50)
    item = F.when(F.col("ord") % 2 == 0, F.to_json(F.struct(keyword.alias("keyword"), (F.col("ord") % 4 == 0).alias("is_processed")))).otherwise(F.concat(F.lit('"'), keyword, F.lit('"')))
    return stores.watched(_files(articles(spark, sf), item)).select("keyword", "is_processed")


@query(f"WITH {ARTICLES} SELECT ord, url FROM articles WHERE ord % 3 = 0")
def store_replaced(spark, sf):
    path = f"{stores.shared_dir(spark)}/store-{uuid.uuid4().hex}"
    a = articles(spark, sf).select("ord", "url")
    stores.replace(a, path)
    schema = "ord long, url string"
    stores.replace(spark.read.schema(schema).json(path).where("ord % 3 = 0"), path)
    return spark.read.schema(schema).json(path)


@query(f"WITH {ARTICLES} SELECT ord, url FROM articles WHERE ord % 2 = 0")
def snapshot_refused(spark, sf):
    """A snapshot without a required column leaves the published one in place."""
    root = f"{stores.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    a = articles(spark, sf).select("ord", "url")
    state.publish(spark, a.where("ord % 2 = 0"), root, "0001", "steel", required=("url",))
    try:
        state.publish(spark, a.select("ord"), root, "0002", "steel", required=("url",))
    except ValueError:
        pass
    return state.current(spark, root, "steel").unionByName(state.current(spark, root)).distinct()


# -- production ------------------------------------------------------------------------------------------------------

_FOUND = ("f AS (SELECT ord, url, source, CASE ord % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'story' ELSE 'provider' END AS kind, ord % 7 AS phrase_no, CASE WHEN ord % 7 < 3 THEN 1 + ord % 2 ELSE ord % 3 END AS priority FROM articles), "
          "p AS (SELECT phrase_no, min(priority) AS least FROM f WHERE kind = 'provider' GROUP BY 1), "
          "c AS (SELECT ord, url, source, kind, phrase_no, CASE kind WHEN 'feed' THEN 0 WHEN 'story' THEN 1 ELSE 2 END AS section FROM f LEFT JOIN p USING (phrase_no) WHERE (kind <> 'provider' OR priority = least) AND url NOT IN (SELECT url FROM articles WHERE ord % 4 = 0)), "
          "w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY section, phrase_no, ord) AS k FROM c)")


def _found(spark, sf):
    o = F.col("ord")
    a = articles(spark, sf).select("ord", "url", "source", F.when(o % 5 == 0, "feed").when(o % 5 == 1, "story").otherwise("provider").alias("kind"), (o % 7).alias("phrase_no"),
                                   F.when(o % 7 < 3, 1 + o % 2).otherwise(o % 3).alias("priority"), o.alias("id"))
    return a, a.where("ord % 4 = 0").select(X.hash_of(F.trim("url")).alias("url_hash")).distinct()


@query(f"WITH {ARTICLES}, {_FOUND} SELECT ord AS id, kind FROM w WHERE k = 1")
def production_of_phrases(spark, sf):
    found, seen = _found(spark, sf)
    return production.for_phrases(found, seen, found.limit(0), pool=True).select("id", "kind")


@query(f"WITH {ARTICLES}, {_FOUND} SELECT ord AS id, kind FROM w WHERE k = 1 AND lower(source) IN ('src3', 'src8', 'src12') ORDER BY section, phrase_no, ord LIMIT 30")
def production_fetch(spark, sf):
    found, seen = _found(spark, sf)
    return production.fetch(found, seen, found.limit(0), limit=30, sources=["SRC3", "src8", "Src12"], pool=True).select("id", "kind")


@query(f"WITH {ARTICLES}, f AS (SELECT ord, lang, ord % 5 + 1 AS page FROM articles WHERE NOT (lang = 'de' AND ord % 5 = 1)), h AS (SELECT lang, CASE WHEN NOT bool_or(page = 1) THEN 0 WHEN NOT bool_or(page = 2) THEN 1 WHEN NOT bool_or(page = 3) THEN 2 ELSE 3 END AS last FROM f GROUP BY 1), "
       "e AS (SELECT f.* FROM f JOIN h USING (lang) WHERE page <= last AND ord % 4 <> 1 AND ord % 3 <> 0), "
       "k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page, ord) AS k FROM e WHERE lang IN ('en', 'de', 'fr')) SELECT ord, lang AS topic_bucket FROM k WHERE k <= 14")
def production_topic_pool(spark, sf):
    stores.shared_dir(spark)
    a = articles(spark, sf).where("not (lang = 'de' and ord % 5 = 1)").select("ord", F.concat("url", F.lit("?p="), "ord").alias("url"), F.col("lang").alias("topic"), (F.col("ord") % 5 + 1).cast("int").alias("page"))
    seen = a.where("ord % 4 = 1").select(X.hash_of(F.trim("url")).alias("url_hash"))
    return production.topic_pool(a, seen, ["en", "de", "fr"], F.col("ord") % 3 != 0, NOW, target=40).select("ord", "topic_bucket")


@query(f"SELECT doc_id, score FROM ({ORACLES['relevance_rule_score']}) ORDER BY score DESC, doc_id")
def relevance_order(spark, sf):
    d = docs(spark, sf).withColumn("relevance_score", filters.relevance_score(F.col("title"), F.lit(""), F.col("content"), "This with thaner"))
    return production.by_relevance(d.select("ord", "relevance_score")).select(F.col("ord").alias("doc_id"), F.col("relevance_score").alias("score"))


@query(f"SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) < 50 THEN {S.lit(C.SHORT_CONTENT)} || {T} END AS notice FROM documents")
def short_content_notice(spark, sf):
    return docs(spark, sf).select(F.col("ord").alias("doc_id"), production.short_content(F.col("title"), F.col("content")).alias("notice"))


@query(f"WITH {ARTICLES} SELECT ord, CAST(printf('%.1f', length(content) * 0.1::DOUBLE + length(title) * 0.5::DOUBLE + (ord % 101)::DOUBLE * 10.0::DOUBLE) AS DOUBLE) AS quality FROM articles")
def batch_quality(spark, sf):
    return articles(spark, sf).select("ord", production.batch_quality(F.col("content"), F.col("title"), (F.col("ord") % 101).cast("double")).alias("quality"))


# -- duplicates by all rules -----------------------------------------------------------------------------------------

@query()
def is_duplicate_of_any(spark, sf):
    a = articles(spark, sf)
    return dedup.duplicate_of_any(a.where("ord % 2 = 1"), a.where("ord % 2 = 0"))


@query()
def pinned_overlay_by_rules(spark, sf):
    stores.shared_dir(spark)
    a = articles(spark, sf).select("ord", "url", "title", "content", "source")
    shown = search.overlay(a.where("ord % 10 <> 0"), a.where("ord % 30 = 0"), a.where("ord % 20 = 10"))
    return shown.select(F.col("ord.part").alias("part"), F.col("ord.at").alias("ord"), "url", "title", "is_pinned")


@query(f"WITH {ARTICLES} SELECT min(ord) AS ord, {S.title_key('title')} AS key FROM articles GROUP BY 2")
def title_keys(spark, sf):
    a = articles(spark, sf).select("ord", dedup.title_key(F.col("title")).alias("key"))
    return select.first_wins(a, "key")
