"""Relations over the driver's tables: articles, tags, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"  # every operator that depends on the time takes it as a parameter


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_line_title(text):
    return F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(80))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with its page's url or one made from source and id, and the time of the event of its number or one made from the id."""
    p = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    d = load(spark, sf_dir, "documents").select("doc_id", "text", first_line_title(F.col("text")).alias("title"), "lang", "source")  # so a title is not dealt out as its text
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    made = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/items/"), F.col("doc_id").cast("string"))
    at = F.coalesce("ts", F.timestamp_seconds(1_704_067_200 + F.col("doc_id") * 60))
    rows = d.join(p, p.page_id == d.doc_id, "left").join(e, e.event_id == d.doc_id, "left").withColumn("at", at)
    return rows.select(F.col("doc_id").alias("ord"), F.coalesce("page_url", made).alias("url"), F.col("text").alias("content"), "title", "lang", "source",
                       F.col("at").alias("published_ts"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))


ARTICLES = """articles AS (SELECT d.doc_id AS ord, coalesce(p.url, 'https://' || d.source || '.example.org/items/' || d.doc_id) AS url, d.text AS content,
 substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.lang, d.source, coalesce(e.ts::TIMESTAMP, make_timestamp((1704067200 + d.doc_id * 60) * 1000000)) AS published_ts,
 strftime(coalesce(e.ts::TIMESTAMP, make_timestamp((1704067200 + d.doc_id * 60) * 1000000)), '%Y-%m-%dT%H:%M:%SZ') AS published_at
 FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id LEFT JOIN events e ON e.event_id = d.doc_id)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with tags: up to three title words of four letters and more, without marks."""
    clean = F.split(F.regexp_replace(F.col("title"), "[^\\p{L}\\p{N}_ ]", ""), " ")
    return articles(spark, sf_dir).withColumn("tags", F.slice(F.filter(clean, lambda w: F.length(w) >= 4), 1, 3))


TAGGED = ARTICLES + """, tagged AS (SELECT *, list_slice(list_filter(string_split(regexp_replace(title, '[^\\p{L}\\p{N}_ ]', '', 'g'), ' '), lambda w: length(w) >= 4), 1, 3) AS tags FROM articles)"""
