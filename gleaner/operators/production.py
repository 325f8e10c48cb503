"""Production of article lists: rows of providers by phrase, pools by topic, an age gate, runs with a cached result, and last columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.columns import blank, normalized_domain
from gleaner.operators import dedup, select, state, watch
from gleaner.sources import feeds, stores

T = TypeVar("T")


def for_phrases(found: DataFrame, seen: DataFrame, mock: DataFrame, page: int = 1, pool: bool = False) -> DataFrame:
    """Rows of `found` (kind, phrase_no, priority, ord, url, ...) that a list of phrases gives, ord now being (section, phrase_no, at).

    Rows of kind `feed`, then `story` come first, for a pool's first page only; of the others, each phrase takes those of its
    first provider by priority that has any. Urls that are blank or in `seen` (url_hash) go, the first row of a url wins.
    If nothing is left, the rows of `mock` (of the same columns) stand in, on page 1 only.
    """
    rows = dedup.first_provider(found.where("kind not in ('feed', 'story')"), "phrase_no").withColumn("_section", F.lit(2))
    if pool and page == 1:
        rows = found.where("kind in ('feed', 'story')").withColumn("_section", F.when(F.col("kind") == "feed", 0).otherwise(1)).unionByName(rows)
    rows = state.unseen(rows.where("url <> ''"), seen).drop("url_hash")
    if page == 1:
        some = rows.limit(1).select(F.lit(True).alias("_any"))  # one row at most
        rows = rows.unionByName(mock.withColumn("_section", F.lit(3)).join(F.broadcast(some), F.lit(True), "left_anti"))
    rows = rows.withColumn("ord", F.struct(F.col("_section").alias("section"), "phrase_no", F.col("ord").alias("at"))).drop("_section")
    return select.first_wins(rows, "url")


def fetch(found: DataFrame, seen: DataFrame, mock: DataFrame, page: int = 1, limit: int | None = None, sources: list[str] | None = None, pool: bool = False) -> DataFrame:
    """`for_phrases`, of the named sources in any casing, the first `limit` of them if given."""
    return watch.of_sources(for_phrases(found, seen, mock, page, pool), sources or [], limit or None)


def topic_pool(found: DataFrame, seen: DataFrame, topics: list[str], keep: Column, now: str, target: int = 150, pages: int = 3) -> DataFrame:
    """Rows of `found` (topic, page, ord, url, ...) for a pool: for each topic in turn the first ceil(target / topics) by page and ord that
    are unseen, pass `keep` and have a url that no earlier topic took; with source_domain, topic_bucket and fetched_at.

    A topic's pages end before the first one without rows, and at `pages`. The list of topics is short: each is one step.
    """
    stores.shared_dir(found.sparkSession)  # for the checkpoints
    share = -(-target // len(topics))
    have = found.where(F.col("page").between(1, pages)).groupBy("topic").agg(F.collect_set("page").alias("_p"))  # `pages` values a topic
    last = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(pages)), lambda p: ~F.array_contains("_p", p.cast(found.schema["page"].dataType)))) - 1, F.lit(pages))
    open_ = found.join(have.where(F.col("topic").isin(topics)).select("topic", last.alias("_last")), "topic").where(F.col("page").between(1, F.col("_last"))).drop("_last")
    rows = state.unseen(open_.where(F.col("url") != "").where(keep), seen).drop("url_hash")
    taken = None
    for k, topic in enumerate(topics):
        mine = select.first_wins(rows.where(F.col("topic") == topic).withColumn("_o", F.struct("page", "ord")), "url", "_o")
        if taken is not None:
            mine = mine.join(taken.select("url"), "url", "left_anti")
        # At most `share` rows; written, since each topic reads all before it.
        mine = mine.orderBy("_o").limit(share).select(*found.columns, F.lit(k).alias("topic_no")).checkpoint()
        taken = mine if taken is None else taken.unionByName(mine)
    return taken.withColumns({"source_domain": normalized_domain(F.col("url")), "topic_bucket": F.col("topic"), "fetched_at": F.lit(now)})


def fresh_pool(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], now: str, max_age: float = 24, days: int = 7,
               index: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The stored pool while it is younger than `max_age` hours; else new rows of `make` before the stored ones that have not expired, first
    url wins, which replace it. `index` gives the keywords (pos, keyword) that are stored beside a new pool. Schema: ord, url, published_at, fetched_at and more."""
    stores.shared_dir(spark)  # for the checkpoint
    age = feeds.pool_age_hours(spark, path, now)
    old = feeds.load_pool(spark, path, schema)
    if age is not None and age < max_age:
        return old
    at = lambda df: df.where("url <> ''").withColumn("_at", F.coalesce(F.nullif("published_at", F.lit("")), "fetched_at"))
    merged = dedup.merge_pools(at(make().select(*old.columns)), at(old), "_at", now, days).select(*old.columns).checkpoint()  # read before it is replaced
    feeds.save_pool(merged, path, now)
    if index is not None:
        feeds.save_ordered(index(merged), f"{path}/keywords")
    return feeds.load_pool(spark, path, schema)


def run(cached: Callable[[], T | None], produce: Callable[[], T], force: bool = False) -> T | None:
    """The cached result unless forced or absent; the cached one, too, if producing fails. The error is raised where there is none."""
    have = None if force else cached()
    if have is not None:
        return have
    try:
        return produce()
    except Exception:
        have = cached()
        if have is None:
            raise
        return have


def resolved(*values):
    """The first setting that is given and not blank or zero, else the last."""
    return next((v for v in values if v), values[-1])


def by_relevance(rows: DataFrame, score: str = "relevance_score") -> DataFrame:
    """Best first, equal scores in order of `ord`; no score counts as zero."""
    return rows.orderBy(F.coalesce(score, F.lit(0.0)).desc(), "ord")


def short_content(title: Column, content: Column) -> Column:
    """The notice that stands for the summary of a text of under 50 characters; null for others."""
    return F.when(F.length(F.btrim(blank(content), F.lit(" \t\n\r\f\v"))) < 50, F.concat(F.lit(C.SHORT_CONTENT), blank(title)))


def round_tenth(x: Column) -> Column:
    """A double to one digit by its binary value, exact halves to the even digit."""
    # Twenty times x is 16x + 4x, both exact; what their sum loses in rounding decides where it seems to lie half way.
    a, b = 16.0 * x, 4.0 * x
    s = a + b
    bb = s - a
    lost = (a - (s - bb)) + (b - bb)
    half = F.abs(s / 2 - F.floor(s / 2)) == 0.5
    return F.when(half & (lost != 0), F.when(lost > 0, F.ceil(s / 2)).otherwise(F.floor(s / 2)).cast("double")).otherwise(F.rint(s / 2)) / 10.0


def batch_quality(content: Column, summary: Column, relevance: Column) -> Column:
    """Quality that a batch of articles is sent to a model with, to one digit."""
    return round_tenth(F.length(blank(content)) * 0.1 + F.length(blank(summary)) * 0.5 + F.coalesce(relevance, F.lit(0.0)) * 10.0)
