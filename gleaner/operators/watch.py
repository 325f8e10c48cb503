"""Watched keywords and pins (add, remove, save, progress), candidates' verdicts, and columns for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import columns as X
from gleaner.functions import constants as C
from gleaner.operators import filters
from gleaner.operators.select import first_wins


def distinct_keywords(rows: DataFrame) -> DataFrame:
    """First casing of each non-blank keyword, by `ord`."""
    k = rows.withColumn("keyword", F.trim("keyword")).where("keyword <> ''").withColumn("_k", F.lower("keyword"))
    return first_wins(k, "_k").drop("_k")


def save_keywords(new: DataFrame, old: DataFrame) -> DataFrame:
    """A new list (ord, keyword) with the old list's is_processed where the keyword was known."""
    was = distinct_keywords(old).select(F.lower("keyword").alias("_k"), F.col("is_processed").alias("_was"))
    n = distinct_keywords(new).withColumn("_k", F.lower("keyword"))
    return n.join(was, "_k", "left").select("ord", "keyword", F.coalesce("_was", F.lit(False)).alias("is_processed"))


def add_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` and those of `new` that it lacks in any casing, unprocessed and behind it."""
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    more = new.crossJoin(F.broadcast(last)).select((F.col("ord") + F.col("_last") + 1).alias("ord"), "keyword", F.lit(False).alias("is_processed"))  # one row
    return distinct_keywords(old.select("ord", "keyword", "is_processed").unionByName(more))


def remove_keywords(old: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select(F.lower(F.trim("keyword")).alias("_k")).distinct()
    return old.withColumn("_k", F.lower(F.trim("keyword"))).join(g, "_k", "left_anti").drop("_k")


def unprocessed_progress(rows: DataFrame) -> DataFrame:
    """Unprocessed keywords with the share of work done when each begins, 5 to 95."""
    left = rows.where(~F.coalesce("is_processed", F.lit(False)))
    place, total = F.row_number().over(Window.orderBy("ord")), F.count("*").over(Window.partitionBy())  # a list kept by hand: one task is enough
    return left.select("ord", "keyword", F.floor(5 + (place - 1) / total * 90).cast("int").alias("progress"))


def pin(pins: DataFrame, more: DataFrame) -> DataFrame:
    """Pins with `more`, by raw url; a pin that is there already is replaced."""
    both = pins.withColumn("_o", F.lit(1)).unionByName(more.withColumn("_o", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("_o", "ord"))).where("_r = 1").drop("_r", "_o")


def unpin(pins: DataFrame, urls: DataFrame) -> DataFrame:
    return pins.join(urls.select("url").distinct(), "url", "left_anti")


def verdicts(rows: DataFrame, seen: DataFrame, topic: str, english: Column | None = None) -> DataFrame:
    """`rows` (ord, url, title, content, summary) with reject_reason: the first rule that a candidate fails.

    Rows with a blank url are left out. A url's or title's hash is taken by the first row that passes all earlier rules,
    also if its summary fails afterwards.
    """
    english = filters.is_english(F.col("title"), F.col("content")) if english is None else english
    known = seen.select("url_hash", F.lit(True).alias("_seen")).distinct()
    r = rows.where("trim(url) <> ''").withColumn("url_hash", X.hash_of(F.trim("url"))).join(known, "url_hash", "left")
    relevant = filters.relevance_score(F.col("title"), F.lit(""), F.col("content"), topic) >= 40
    early = (F.when(X.url_reason(F.col("url")) != "ok", "invalid_url").when(F.col("_seen"), "duplicate_urls").when(~english, "non_english_metadata")
             .when(filters.title_is_doc_type(F.col("title")), "invalid_source_type").when(filters.off_topic(F.col("title"), F.col("url")), "failed_relevance_validation")
             .when(filters.source_type_reason(F.col("title"), F.col("content")) != "ok", "invalid_source_type")
             .when(filters.content_reason(F.col("content")) != "ok", "low_quality_content").when(~relevant, "failed_relevance_validation"))
    r = r.withColumn("_early", early).withColumn("_t", X.hash_of(X.normalize_title(F.col("title"))))
    # Rows that fail early or have no title stand in a partition of their own, so no key gathers them.
    rank = lambda key, ok: F.row_number().over(Window.partitionBy(key, ok, F.when(~ok | (F.col(key) == ""), F.col("ord"))).orderBy("ord"))
    r = r.withColumn("_u", rank("url_hash", F.col("_early").isNull()))
    ok = F.col("_early").isNull() & (F.col("_u") == 1)
    r = r.withColumn("_ok", ok).withColumn("_v", rank("_t", F.col("_ok")))
    late = F.when((F.col("_u") > 1) | (F.col("_v") > 1), "duplicate_urls").when(~filters.summary_ok(F.col("summary"), F.col("title")), "failed_summary_validation").otherwise("accepted_articles")
    return r.withColumn("reject_reason", F.coalesce("_early", late)).select(*rows.columns, "reject_reason")


def of_sources(rows: DataFrame, sources: list[str], limit: int | None = None) -> DataFrame:
    """Rows of the named sources in any casing; the first `limit` of them if given."""
    some = rows.where(F.lower("source").isin(*[s.lower() for s in sources])) if sources else rows
    return some.orderBy("ord").limit(limit) if limit is not None else some


def text_search(words: str, *texts: str, tags: str) -> Column:
    """The words occur in one of the texts or in a tag, in any casing."""
    w = words.strip().lower()
    hit = F.exists(tags, lambda t: F.lower(t).contains(w))
    for t in texts:
        hit = hit | F.lower(X.blank(F.col(t))).contains(w)
    return F.lit(True) if not w else hit


def first_words(text: Column, n: int = 250) -> Column:
    return F.array_join(F.slice(F.filter(F.split(X.blank(text), "\\s+"), lambda w: w != ""), 1, n), " ")


def unfenced(text: Column) -> Column:
    """What stands between the first code fences, or the whole text without any."""
    inner = F.regexp_extract(text, "(?s)```(?:json)?(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), "^\\s+|\\s+$", "")


def slug_title(url: Column) -> Column:
    """A title from the url's last part; `URL Article` if nothing is left."""
    last = F.split_part(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(X.blank(url), "/"), lambda p: p != "")), -1), F.lit("?"), F.lit(1))
    bare = last
    for e in C.PAGE_ENDS:
        bare = F.regexp_replace(bare, "\\" + e + "$", "")
    t = X.title_case(F.trim(F.translate(bare, "-_", "  ")))
    return F.when(t == "", "URL Article").otherwise(t)


def countdown(seconds: Column) -> Column:
    """Time left as `2h 5m 0s`, without hours if there are none."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda v, u: F.concat(v.cast("long").cast("string"), F.lit(u))
    return F.when(seconds <= 0, "Scheduled Refresh Pending...").otherwise(F.concat_ws(" ", F.when(h > 0, part(h, "h")), part(m, "m"), part(s, "s")))


def display_date(raw: Column) -> Column:
    return F.coalesce(F.date_format(X.parse_time(raw), "MMM d, yyyy"), raw)


def brand_label(company: Column, is_pinned: Column) -> Column:
    up, out = F.upper(company), F.when(~is_pinned | (X.blank(company) == ""), F.lit(None).cast("string"))
    for b in C.BRANDS:
        out = out.when(up.contains(b.upper()), b)
    return out.otherwise(company)


def canonical_casing(phrase: Column) -> Column:
    """The fixed spelling of a canonical phrase that has one."""
    out = F.lit(None).cast("string")
    for spelling in dict.fromkeys(C.VARIANTS.values()):
        out = F.when(F.lower(phrase) == spelling.lower(), spelling).otherwise(out)
    return out
