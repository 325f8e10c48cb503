"""Selection by order: first wins, source diversity, quotas, rounds, pages.

All orders end in `ord`, which is unique, so results don't depend on partitioning. Where a rank over
all rows is needed, the top rows are found by a limit over an order, which Spark computes as partial
top-k per partition; no window runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.columns import normalized_domain


def first_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The row of least order of each key; partial per partition, so a hot key sends few rows."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def per_domain_rank(df: DataFrame, order: str = "ord") -> DataFrame:
    return df.withColumn("domain", normalized_domain(F.col("url"))).withColumn("domain_rank", F.row_number().over(Window.partitionBy("domain").orderBy(order)))


def diverse(df: DataFrame, count: int = 5, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One article of each domain first, then of excluded domains, then the others by order; `count` rows.

    Only the first row of a domain can precede phase 2 and only `count` others matter, so each domain keeps `count` rows at most.
    """
    rows = first_wins(df.where(F.coalesce("url", F.lit("")) != ""), "url").withColumn("domain", normalized_domain(F.col("url")))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("domain").orderBy("ord"))).where(F.col("_rn") <= count)
    lead = (F.col("domain") != "") & (F.col("_rn") == 1)
    barred = F.col("domain").isin(*[e.lower().strip() for e in exclude]) if exclude else F.lit(False)
    phase = F.when(lead & ~barred, 0).when(lead, 1).otherwise(2)
    return rows.withColumn("phase", phase).orderBy("phase", "ord").limit(count).drop("_rn")


def capped_by_domain(df: DataFrame, cap: int = 3, count: int = 15) -> DataFrame:
    rows = per_domain_rank(df).where(F.col("domain_rank") <= cap)
    return rows.orderBy("ord").limit(count)


def diversity_bonus(df: DataFrame, bonus: float = 0.3) -> DataFrame:
    """`bonus` for the first row of each domain; the first ones are found by a partial minimum and met by domain and order, so no domain is sorted or lies in one task."""
    rows = df.withColumn("domain", normalized_domain(F.col("url")))
    first = rows.where("domain <> ''").groupBy("domain").agg(F.min("ord").alias("_first"))
    first = first.select(F.col("domain").alias("_domain"), "_first")
    met = rows.join(first, (F.col("domain") == F.col("_domain")) & (F.col("ord") == F.col("_first")), "left")
    return met.withColumn("bonus", F.when(F.col("_first").isNotNull(), bonus).otherwise(0.0)).drop("_domain", "_first")


def topic_quota(df: DataFrame, total: int, topics: int, topic: str = "topic_bucket", topic_order: str = "topic_idx") -> DataFrame:
    """At most ceil(total / topics) rows of each topic; a url counts for its earliest topic only."""
    cap = -(-total // topics)
    once = df.withColumn("_o", F.struct(topic_order, "ord"))
    once = first_wins(once, "url", "_o").drop("_o")
    w = Window.partitionBy(topic).orderBy("ord")
    return once.withColumn("topic_rank", F.row_number().over(w)).where(F.col("topic_rank") <= cap)


def round_robin(df: DataFrame, group: str, group_order: str, rounds: int = 5, count: int = 5) -> DataFrame:
    w = Window.partitionBy(group).orderBy("ord")
    rows = df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= rounds)
    return rows.orderBy("round", group_order).limit(count)


def two_pass(df: DataFrame, target: int = 50) -> DataFrame:
    """One row of each domain first, then any, up to the target.

    Rows that lose within the first pass stay eligible for the second; nothing is spent on them.
    """
    rows = per_domain_rank(df).where(F.col("domain_rank") <= target)
    return rows.withColumn("pass", F.when(F.col("domain_rank") == 1, 0).otherwise(1)).orderBy("pass", "ord").limit(target)


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A seeded random order that depends on the rows' `ord` alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), "ord"), "ord")
