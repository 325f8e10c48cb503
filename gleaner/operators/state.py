"""State tables: seen urls and hashes with expiry, upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import hash_of


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose url's hash is not in `seen`."""
    return rows.withColumn("url_hash", hash_of(F.trim("url"))).join(seen.select("url_hash"), "url_hash", "left_anti")


def prune(seen: DataFrame, at: str, now: str, days: int, keep_unparseable: bool = False) -> DataFrame:
    """Entries not older than `days`; those whose time can't be parsed go, or stay if asked."""
    ts = F.try_to_timestamp(F.col(at))
    fresh = ts >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return seen.where(fresh | ts.isNull() if keep_unparseable else fresh)


def upsert(old: DataFrame, new: DataFrame, key: str, preserve: tuple[str, ...] = (), fill_blank: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones by key; `preserve` keeps an old value, `fill_blank` takes a new one only where the old is blank."""
    o, n = old.alias("o"), new.alias("n")
    cols = []
    for c in old.columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key or c in preserve:
            cols.append(F.coalesce(was, now).alias(c))
        elif c in fill_blank:
            cols.append(F.coalesce(F.nullif(was, F.lit("")), now, was).alias(c))
        else:
            cols.append(F.when(F.col(f"n.{key}").isNotNull(), now).otherwise(was).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


DASHBOARD = "default_dashboard"


def publish(spark: SparkSession, rows: DataFrame, root: str, snapshot_id: str, keyword: str = DASHBOARD, required: tuple[str, ...] = ()) -> None:
    """Write a snapshot beside the others, then name it in the pointer, for its keyword and the dashboard in one file; readers see the
    old one until then. Rows that are no DataFrame or lack a required column are refused, and whatever fails before leaves the old one."""
    if not isinstance(rows, DataFrame):
        raise ValueError("a snapshot must be a DataFrame")
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"a snapshot lacks the columns {missing}")
    rows.write.mode("overwrite").parquet(f"{root}/snapshots/{snapshot_id}")
    keys = dict.fromkeys((keyword or DASHBOARD, DASHBOARD))
    spark.createDataFrame([(k, snapshot_id) for k in keys], "keyword string, snapshot_id string").coalesce(1).write.mode("append").json(f"{root}/pointer")


def current(spark: SparkSession, root: str, keyword: str = DASHBOARD) -> DataFrame:
    """Rows of the snapshot that was published last for a keyword."""
    named = spark.read.schema("keyword string, snapshot_id string").json(f"{root}/pointer").where(F.col("keyword") == keyword)
    last = named.agg(F.max_by("snapshot_id", F.struct(F.col("_metadata.file_modification_time").alias("t"), "snapshot_id"))).first()[0]
    if last is None:
        raise LookupError(f"no snapshot of {keyword}")
    return spark.read.parquet(f"{root}/snapshots/{last}")
