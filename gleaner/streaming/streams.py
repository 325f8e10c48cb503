"""Streaming forms: deduplication with expiry, daily counts, incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.stores import shared_dir


def dedup_ttl(events: DataFrame, key: str, time: str = "ts", ttl: str = "7 days") -> DataFrame:
    """First row of each key within the watermark; the state of older keys expires."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def run_available(spark: SparkSession, stream: DataFrame, mode: str, target: str | None = None) -> DataFrame:
    """Process all that is there (availableNow) and return what was written."""
    base = target or shared_dir(spark)
    at = f"{base}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        q = stream.writeStream.outputMode("complete").option("checkpointLocation", at + "/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(at + "/out")).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", at + "/state").trigger(availableNow=True).format("parquet").option("path", at + "/out").start()
    q.awaitTermination()
    return spark.read.parquet(at + "/out")
