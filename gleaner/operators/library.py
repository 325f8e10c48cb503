"""Operators over stored articles: startup snapshot, backfilled columns, tag caches, chips, mock rows, provider unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import mining, tags
from gleaner.operators.dedup import title_ratio
from gleaner.operators.select import first_wins
from gleaner.operators.watch import slug_title


MOCK_TOPICS = 1000  # rows that mock_rows sends to every task


def startup(dashboard: DataFrame, stored: DataFrame) -> DataFrame:
    """The dashboard's rows if there are any, else all stored articles; both have the same columns."""
    n = dashboard.agg(F.count("*").alias("_n"))  # one row
    return dashboard.unionByName(stored.join(F.broadcast(n), F.lit(True)).where("_n = 0").drop("_n"))


def backfill_metadata(rows: DataFrame, stores: DataFrame, now: str) -> DataFrame:
    """Blank titles and times from other stores by trimmed url, the last non-blank one winning; then from the url, `added_at` and `now`."""
    s = stores.select(F.trim("url").alias("_u"), "ord", F.nullif(X.blank(F.col("title")), F.lit("")).alias("_t"), F.nullif(X.blank(F.col("published_at")), F.lit("")).alias("_p"))
    last = s.groupBy("_u").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("ord"))).alias("_t"), F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("ord"))).alias("_p"))
    r = rows.withColumn("_u", F.trim("url")).join(last, "_u", "left")
    own = lambda c: F.nullif(X.blank(F.col(c)), F.lit(""))
    return r.withColumns({"title": F.coalesce(own("title"), "_t", slug_title(F.col("url"))), "published_at": F.coalesce(own("published_at"), "_p", own("added_at"), F.lit(now))}).drop("_u", "_t", "_p")


def tag_cache_hits(rows: DataFrame, cache: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(ord, hit, tags): the cached tags where the url is known, the titles are alike and the summaries' content is equal."""
    k = cache.select("url", F.col("title").alias("_t"), X.content_hash(F.col("summary")).alias("_h"), F.col("tags").alias("_tags"))
    strip = lambda c: F.regexp_replace(F.lower(X.blank(c)), "[^\\p{L}\\p{N}_]+", "")
    j = rows.join(k, "url", "left").withColumns({"_a": strip(F.col("title")), "_b": strip(F.col("_t"))})
    alike = (F.col("_a") != "") & (F.col("_b") != "") & ((F.col("_a") == F.col("_b")) | (title_ratio("_a", "_b") >= ratio))
    hit = F.coalesce(alike & (X.content_hash(F.col("summary")) == F.col("_h")), F.lit(False))
    return j.select("ord", hit.alias("hit"), F.when(hit, F.col("_tags")).alias("tags"))


def drop_stale(rows: DataFrame, column: str = "tags") -> DataFrame:
    """Rows with their tags emptied where those are placeholders or the title cut up."""
    return rows.withColumn(column, F.when(tags.stale(F.col(column), F.col("title")), F.array().cast("array<string>")).otherwise(F.col(column)))


def toggle(chips: Column, chip: Column) -> Column:
    """A chip is taken out if it is there and put at the end if not."""
    one = F.array(chip)
    return F.when(F.array_contains(chips, chip), F.array_except(chips, one)).otherwise(F.array_union(chips, one))


def keywords_from_fallback(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Tags of the tag table, else the three fallback phrases of title, description and content."""
    k = known.select("url", F.col("keywords").alias("_k"))
    text = F.concat_ws(". ", "title", "content")
    made = F.when(F.coalesce(F.size("_k"), F.lit(0)) > 0, F.col("_k")).otherwise(mining.fallback_tags(text))
    return rows.join(k, "url", "left").withColumn("keywords", made).drop("_k")


def three_keywords(raw: Column, forbidden=C.FORBIDDEN_KEYWORDS, pads=C.FALLBACK_TAGS) -> Column:
    """A model's keywords trimmed, without forbidden ones, distinct in any casing, cut or padded to three."""
    kept = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: F.trim(X.blank(t))), lambda t: (t != "") & ~F.lower(t).isin(*forbidden))
    both = F.concat(kept, X.words(pads))
    low = F.transform(both, lambda t: F.lower(t))
    return F.slice(F.filter(both, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, 3)


def mock_rows(phrases: DataFrame, topics: DataFrame) -> DataFrame:
    """For each phrase the rows of the topics it contains, else one row of its own; `topics` (topic, title, url) is a short fixed list.

    The url of a row of its own is named by a stable hash of the phrase.
    """
    if topics.limit(MOCK_TOPICS + 1).count() > MOCK_TOPICS:
        raise ValueError(f"more than {MOCK_TOPICS} topics; join a table of them as match.whole_words does")
    hits = phrases.join(F.broadcast(topics), F.contains(F.lower("phrase"), F.col("topic")))
    own = phrases.join(hits.select("phrase").distinct(), "phrase", "left_anti").select(
        "ord", "phrase", F.lit(None).cast("string").alias("topic"), F.concat(F.lit("Latest on "), "phrase").alias("title"),
        F.concat(F.lit("https://news-mock.com/"), F.pmod(F.xxhash64("phrase"), F.lit(10_000)).cast("string")).alias("url"))
    return hits.select("ord", "phrase", "topic", "title", "url").unionByName(own)


def counts_of_library(stored: DataFrame, table: DataFrame) -> DataFrame:
    """Display tags and counts over stored rows that have a title, their tags backfilled by url."""
    return tags.keyword_counts(tags.backfill(stored.where("title is not null"), table))


def accepted(rows: DataFrame, verdicts: DataFrame, target: int) -> DataFrame:
    """The refresh's result list: accepted rows, one per domain first, then any, up to the target."""
    ok = rows.join(verdicts.where("reject_reason = 'accepted_articles'").select("ord"), "ord", "left_semi")
    one = first_wins(ok.withColumn("domain", X.normalized_domain(F.col("url"))).withColumn("_d", F.when(F.col("domain") == "", F.col("ord").cast("string")).otherwise(F.col("domain"))), "_d")
    first = one.select("ord", F.lit(0).alias("pass"))
    return ok.join(first, "ord", "left").withColumn("pass", F.coalesce("pass", F.lit(1))).orderBy("pass", "ord").limit(target)
