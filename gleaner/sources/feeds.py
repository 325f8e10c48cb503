"""Readers of search responses and feeds, given as rows of text (request, body), and stores of articles.

The engine opens no network connections: responses are files or tables that another process fetched. A body that
can't be parsed gives no rows. All readers return ord, title, url, source, published_at, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.columns import blank, parse_time
from gleaner.operators import select
from gleaner.sources import stores

ITEMS = "title string, url string, source struct<name string>, publishedAt string, description string"
RESULTS = "title string, link string, source_id string, pubDate string, description string"
HITS = "title string, url string, created_at string, author string, points long"
FEED = ("channel struct<item array<struct<title string, link string, description string, pubDate string>>>, "
        "entry array<struct<title string, link struct<_href string>, summary string, content string, published string, updated string>>")


def _items(responses: DataFrame, field: str, schema: str) -> DataFrame:
    parsed = F.from_json("body", f"struct<{field} array<struct<{schema}>>>").getField(field)
    return responses.select("request", F.posexplode(parsed).alias("at", "i"))


def _ord() -> Column:
    return F.struct("request", "at").alias("ord")


def search_pages(responses: DataFrame, default_source: str) -> DataFrame:
    """Rows of search pages that have a title and a url."""
    i = _items(responses, "articles", ITEMS)
    rows = i.select(_ord(), F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.coalesce("i.source.name", F.lit(default_source)).alias("source"),
                    blank(F.col("i.publishedAt")).alias("published_at"), blank(F.col("i.description")).alias("description"))
    return rows.where("title <> '' AND url <> ''")


def within_quota(requests: DataFrame, quota: int = 30, first_page_only: bool = True) -> DataFrame:
    """Requests (request, day, page, body) that a daily quota lets through, in order of `request`."""
    asked = requests.where("page = 1") if first_page_only else requests
    rank = F.row_number().over(Window.partitionBy("day").orderBy("request"))
    return asked.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def result_pages(requests: DataFrame, default_source: str, quota: int = 30) -> DataFrame:
    """Rows of a provider with a daily quota; the quota counts requests before they are read."""
    i = _items(within_quota(requests, quota), "results", RESULTS)
    rows = i.select(_ord(), F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.coalesce("i.source_id", F.lit(default_source)).alias("source"),
                    blank(F.col("i.pubDate")).alias("published_at"), blank(F.col("i.description")).alias("description"))
    return rows.where("title <> '' AND url <> ''")


def stories(responses: DataFrame, source: str, own_pages: str) -> DataFrame:
    """Story hits: no questions or shows, no dead or deleted stories, no pages of the site itself."""
    i = _items(responses, "hits", HITS)
    title = F.lower(F.trim(blank(F.col("i.title"))))
    told = F.concat(F.lit(source + " story by "), F.coalesce("i.author", F.lit("unknown")), F.lit(". Points: "), F.coalesce("i.points", F.lit(0)).cast("string"), F.lit("."))
    rows = i.where(~title.rlike("^(ask|show) hn:") & ~title.contains("[dead]") & ~title.contains("[deleted]"))
    rows = rows.where((blank(F.col("i.url")) != "") & ~F.col("i.url").contains(own_pages))
    return rows.select(_ord(), blank(F.col("i.title")).alias("title"), F.col("i.url").alias("url"), F.lit(source).alias("source"), blank(F.col("i.created_at")).alias("published_at"), told.alias("description"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS feeds (request, name, body), or entries where a feed has no items (Atom)."""
    doc = feeds.select("request", "name", F.from_xml("body", FEED).alias("x"))
    kind = "array<struct<title:string,link:string,description:string,published:string>>"
    items = F.transform("x.channel.item", lambda i: F.struct(i.title.alias("title"), i.link.alias("link"), i.description.alias("description"), i.pubDate.alias("published"))).cast(kind)
    entries = F.transform("x.entry", lambda i: F.struct(i.title.alias("title"), i.link.getField("_href").alias("link"), F.coalesce(i.summary, i.content).alias("description"), F.coalesce(i.published, i.updated).alias("published"))).cast(kind)
    rows = doc.select("request", "name", F.posexplode(F.when(F.size(F.coalesce(items, F.array().cast(kind))) > 0, items).otherwise(entries)).alias("at", "i"))
    return rows.select(_ord(), blank(F.trim("i.title")).alias("title"), blank(F.trim("i.link")).alias("url"), F.col("name").alias("source"), blank(F.col("i.published")).alias("published_at"),
                       F.left(blank(F.col("i.description")), F.lit(300)).alias("description")).where("title <> '' AND url <> ''")


def feed_search(feeds: DataFrame, phrases: list[str], per_domain: int = 3, count: int = 15) -> DataFrame:
    """Feed items that hold one of the phrases: first of each url, few per domain, the first `count`."""
    low = F.lower(F.concat_ws(" ", "title", "description"))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p.lower())
    return select.capped_by_domain(select.first_wins(feed_items(feeds).where(hit), "url"), per_domain, count)


def registry(body: DataFrame) -> DataFrame:
    """(category, name, url) of a registry's JSON; entries without a name or a url are left out."""
    m = body.select(F.explode(F.from_json("body", "map<string, array<struct<name string, url string>>>")).alias("category", "feeds"))
    return m.select("category", F.inline("feeds")).where("name <> '' AND url <> ''").select("category", "name", "url")


def pinned(company_phrases: dict[str, str], found: DataFrame) -> DataFrame:
    """Search results (with `phrase`) of the companies' phrases, marked with company and is_pinned."""
    company = F.create_map(*[F.lit(x) for c, p in company_phrases.items() for x in (p, c)])
    return found.where(F.col("phrase").isin(*company_phrases.values())).withColumn("company", company[F.col("phrase")]).withColumn("is_pinned", F.lit(True))


def save_pool(pool: DataFrame, path: str, now: str) -> None:
    """Articles as JSON lines, then the time at which they were made; each replaces what was there once it is whole."""
    stores.replace(pool, f"{path}/articles")
    stores.replace(pool.sparkSession.createDataFrame([(now,)], "pool_generated_at string").coalesce(1), f"{path}/made")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_pool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pool's articles; none if there is no pool. Lines that can't be parsed are left out."""
    if not _exists(spark, f"{path}/articles"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/articles")


def pool_age_hours(spark: SparkSession, path: str, now: str) -> float | None:
    """Hours since the pool was made; None if unknown."""
    if not _exists(spark, f"{path}/made"):
        return None
    at = spark.read.schema("pool_generated_at string").json(f"{path}/made").select(parse_time(F.col("pool_generated_at")).alias("t"))
    return at.select(((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("t")) / 3600).alias("h")).first()[0]


def save_ordered(rows: DataFrame, path: str) -> None:
    """Keywords (pos, keyword) as JSON lines that keep their order."""
    rows.select("pos", "keyword").write.mode("overwrite").json(path)
