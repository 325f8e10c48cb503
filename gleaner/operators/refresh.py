"""A refresh as one flow: pages read, candidates judged, accepted rows written with the columns that are shown, and counters of each step from the same pass."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleaner.functions.columns import blank, normalized_domain
from gleaner.operators import extract, watch
from gleaner.operators.select import two_pass

REASONS = ("invalid_url", "duplicate_urls", "non_english_metadata", "invalid_source_type", "failed_relevance_validation", "low_quality_content", "failed_summary_validation", "accepted_articles")


def first_blocks(blocks: DataFrame, key: str, at: str, text: str, words: int = 250, most: int = 8) -> DataFrame:
    """The first blocks of each key in order of `at`: up to and with the one that brings the words to `words`, and `most` at most."""
    n = F.size(F.filter(F.split(F.col(text), "\\s+"), lambda w: w != ""))
    order = Window.partitionBy(key).orderBy(at)
    placed = blocks.withColumns({"_before": F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_place": F.row_number().over(order)})
    return placed.where((F.col("_before") < words) & (F.col("_place") <= most)).drop("_before", "_place")


def judged(rows: DataFrame, seen: DataFrame, topic: str, summary: Column, cache: DataFrame | None = None, english: Column | None = None, key: str = "url") -> DataFrame:
    """`rows` (ord, url, title, html, ...) with content, canonical_url, scrape_error, summary and reject_reason; pages that can't be read count as of low quality."""
    read = extract.scraped(rows, cache, key).withColumn("content", blank(F.col("content")))
    return watch.verdicts(read.withColumn("summary", summary), seen, topic, english)


def accepted(judged_rows: DataFrame, keyword: str, relevance: Column, target: int = 50) -> DataFrame:
    """Accepted rows, one per domain first, then any, up to `target`, with the columns of a shown article."""
    ok = judged_rows.where("reject_reason = 'accepted_articles'")
    none = F.lit(None).cast("string")
    shown = two_pass(ok.withColumn("validation_relevance_score", relevance), target)
    return shown.select("ord", "title", "url", F.coalesce("canonical_url", none).alias("canonical_url"), "source", "published_at", "summary", F.col("content").alias("scraped_content"), F.lit(keyword).alias("keyword"),
                        none.alias("company"), F.lit(False).alias("is_pinned"), "validation_relevance_score", F.lit(0.0).alias("relevance_score"), "pass")


def run(judged_rows: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write judged rows under `path` and read them again, with what was counted on the way: rows examined, pages read, domains' rows by verdict."""
    seen_by = Observation(f"refresh-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("examined"), F.count_if(F.col("scrape_error").isNull()).alias("scraped"), F.count_if(normalized_domain(F.col("url")) == "").alias("without_domain")]
    counts += [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    judged_rows.observe(seen_by, *counts).write.parquet(path)
    return judged_rows.sparkSession.read.parquet(path), seen_by.get
