"""Search by parts of words through an index of character n-grams, with the tiers of `search`.

The index holds postings as rows: each tag's and each article's distinct 1-, 2- and 3-grams, in BUCKETS folders by hash and
sorted inside, so a lookup reads the folders of its grams only and skips row groups in them. A keyword's rarest grams give the
candidates, which the texts themselves then confirm; articles lie in folders by number, of which only those of candidates are read.
Tags that the keyword holds are looked up by name, as one of its substrings.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import blank
from gleaner.operators.search import tiers_shown

BUCKETS, RAREST = 64, 3


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def ngrams(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, gram): the distinct substrings of one, two and three characters of each row's texts."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):  # few texts' grams are in memory at once
                part = b.slice(at, 200)
                columns = [c.to_pylist() for c in part.columns[1:]]
                found = [list({t[i:i + n] for t in row if t for n in (1, 2, 3) for i in range(len(t) - n + 1)}) for row in zip(*columns)]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([keys, pa.array(list(chain.from_iterable(found)), pa.string())], names=[key, "gram"])

    some = rows.select(key, *[F.col(t).alias(f"_{i}") for i, t in enumerate(texts)])
    return some.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, gram string")


def build(rows: DataFrame, path: str) -> None:
    """Index rows (ord, url, tags, title, content) under `path`."""
    r = rows.select("ord", "url", F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))).alias("tags"), F.lower(blank(F.col("title"))).alias("title"), F.lower(blank(F.col("content"))).alias("content"))

    def put(df: DataFrame, key: str, name: str) -> None:
        df.withColumn("bucket", _bucket(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/{name}")

    tags = r.select("ord", F.explode("tags").alias("tag")).where("tag <> ''").distinct()
    put(tags, "tag", "tags")
    put(ngrams(tags.select("tag").distinct(), "tag", "tag"), "gram", "tag_grams")
    put(ngrams(r, "ord", "title", "content"), "gram", "text_grams")
    put(r.select("ord", "url", "title", "content"), "ord", "rows")


def _among(spark: SparkSession, path: str, name: str, key: str, values: list[str]) -> DataFrame:
    """Rows of a part of the index with one of these keys, from their folders alone."""
    buckets = [r.b for r in spark.createDataFrame([(v,) for v in values], "v string").select(_bucket(F.col("v")).alias("b")).distinct().collect()]
    return spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(buckets) & F.col(key).isin(values))


def _holding(spark: SparkSession, path: str, name: str, word: str, key: str) -> DataFrame:
    """Candidates for texts that hold the word: those with all of its rarest grams."""
    n = min(3, len(word))
    grams = sorted({word[i:i + n] for i in range(len(word) - n + 1)})
    counts = {r.gram: r["count"] for r in _among(spark, path, name, "gram", grams).groupBy("gram").count().collect()}  # one number a gram
    rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    return _among(spark, path, name, "gram", rare).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(rare)).select(key)


def search(spark: SparkSession, path: str, keyword: str, few: int = 5, key: str = "url") -> DataFrame:
    """(ord, url, tier) as `search` gives them for a keyword that is not blank."""
    kw = keyword.lower().strip()
    if not kw:
        raise ValueError("a blank keyword finds all rows and needs no index")
    within = sorted({kw[i:j] for i in range(len(kw)) for j in range(i + 1, len(kw) + 1)})
    holds = _holding(spark, path, "tag_grams", kw, "tag").where(F.contains("tag", F.lit(kw)))
    held = _among(spark, path, "tags", "tag", within).select("tag").distinct()
    some = holds.unionByName(held).distinct().withColumn("bucket", _bucket(F.col("tag")))
    by_tag = spark.read.parquet(f"{path}/tags").join(some, ["bucket", "tag"]).select("ord", F.when(F.col("tag") == kw, 1).otherwise(2).alias("tier"))
    rows = spark.read.parquet(f"{path}/rows")
    ids = _holding(spark, path, "text_grams", kw, "ord").withColumn("bucket", _bucket(F.col("ord")))
    by_text = rows.join(ids, ["bucket", "ord"]).where(F.contains("title", F.lit(kw)) | F.contains("content", F.lit(kw))).select("ord", F.lit(3).alias("tier"))
    best = by_tag.unionByName(by_text).groupBy("ord").agg(F.min("tier").alias("tier")).withColumn("bucket", _bucket(F.col("ord")))
    return tiers_shown(rows.select("bucket", "ord", "url").join(best, ["bucket", "ord"]).select("ord", "url", "tier"), few, key)
