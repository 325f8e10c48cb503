"""Stores that another process keeps as JSON: seen urls, pinned articles, watched keywords. Each is given as rows (request, body)
with the text of a whole file, as `bodies` reads them; a store that is missing or can't be parsed is empty."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.operators.watch import distinct_keywords


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir; one of our own only where that is unset on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="gleaner-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(request, body) of the files at `path`; none if there are none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], "request string, body string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request"), F.col("value").alias("body"))


def seen(files: DataFrame) -> DataFrame:
    """(url, entry) of a map from urls to what is known of them, entries as JSON."""
    return files.select(F.explode(F.from_json("body", "map<string, string>")).alias("url", "entry"))


def pinned(files: DataFrame, schema: str) -> DataFrame:
    """Articles of an array, or of an object's array `articles`, with their place (request, at) as ord."""
    whole = F.from_json("body", f"array<struct<{schema}>>")
    inner = F.from_json("body", f"struct<articles: array<struct<{schema}>>>")["articles"]
    rows = F.when(F.ltrim("body").startswith("["), whole).otherwise(inner)
    return files.select("request", F.posexplode(rows).alias("at", "i")).select(F.struct("request", "at").alias("ord"), "i.*")


def watched(files: DataFrame, defaults: tuple[str, ...] = C.WATCHED) -> DataFrame:
    """(ord, keyword, is_processed) of a list of keywords or of objects with these fields: first casing of each, `defaults` if no file has a list."""
    items = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<string>"))
    lists = files.select("request", items.alias("items")).where("items is not null")
    rows = lists.select("request", F.posexplode("items").alias("at", "i")).withColumn("o", F.when(F.col("i").startswith("{"), F.from_json("i", "keyword string, is_processed boolean")))
    rows = rows.select(F.struct("request", "at").alias("ord"), F.when(F.col("o").isNotNull(), F.col("o.keyword")).otherwise(F.col("i")).alias("keyword"), F.coalesce("o.is_processed", F.lit(False)).alias("is_processed"))
    known = files.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(d) for d in defaults])).alias("at", "keyword"))
    known = known.select(F.struct(F.lit(None).cast(rows.schema["ord"].dataType["request"].dataType).alias("request"), "at").alias("ord"), "keyword", F.lit(False).alias("is_processed"))
    known = known.join(F.broadcast(lists.limit(1).select(F.lit(True).alias("_any"))), F.lit(True), "left_anti")
    return distinct_keywords(rows.unionByName(known))


def replace(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in place of what is at `path`; that stays until the new files are whole. `rows` may come from `path`."""
    spark, new, old = rows.sparkSession, f"{path}-{uuid.uuid4().hex}", f"{path}-{uuid.uuid4().hex}"
    rows.write.json(new)
    fs, p = _fs(spark, path)
    was = fs.exists(p)
    if was:
        fs.rename(p, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, new)[1], p):
        if was:
            fs.rename(_fs(spark, old)[1], p)
        raise OSError(f"could not put the new store at {path}")
    if was:
        fs.delete(_fs(spark, old)[1], True)
