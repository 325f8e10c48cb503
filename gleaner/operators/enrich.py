"""Enrichment contract: cache keys, validation of insights, defaults, fallback summaries, pluggable models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.columns import blank
from gleaner.operators.state import upsert

INSIGHT = "struct<executive_summary:string,business_implications:array<string>,ai_relevance:string,industry_categories:array<string>,innovation_score:double,sentiment:string>"


def cache_key(canonical_url: Column, url: Column, title: Column, published_at: Column) -> Column:
    link = F.when(blank(canonical_url) != "", canonical_url).otherwise(blank(url))
    return F.sha2(F.concat_ws("||", F.trim(link), F.trim(blank(title)), F.trim(blank(published_at))), 256)


def insight(raw: Column) -> Column:
    return F.from_json(raw, INSIGHT)


def valid(i: Column) -> Column:
    full = lambda a: (F.size(a) >= 1) & F.forall(a, lambda x: F.trim(blank(x)) != "")
    score = i["innovation_score"].cast("int")
    return F.coalesce((F.trim(i["executive_summary"]) != "") & full(i["business_implications"]) & (F.trim(i["ai_relevance"]) != "") & full(i["industry_categories"])
                      & score.between(0, 100) & i["sentiment"].isin(*C.SENTIMENTS), F.lit(False))


def fallback_summary(title: Column, content: Column) -> Column:
    """The first two sentences (each ends at . ! or ? past ten characters); a placeholder if that is under 50 characters."""
    c = blank(content)
    one = F.regexp_extract(c, "(?s)^(.{10,}?[.!?])", 1)
    rest = F.substring(c, F.length(one) + 1, F.length(c))
    two = F.regexp_extract(rest, "(?s)^(.{10,}?[.!?])", 1)
    tail = F.when(two != "", two).otherwise(rest)
    made = F.when(one == "", F.trim(c)).otherwise(F.trim(F.concat_ws(" ", F.trim(one), F.trim(tail))))
    return F.when(F.length(made) < 50, F.concat(F.lit("This report covers the latest developments regarding '"), title, F.lit("', discussing industry impacts, strategic decisions, and future outlook."))).otherwise(made)


def enrich(rows: DataFrame, model: Callable, schema: str, batch: int = 3, attempts: int = 2) -> DataFrame:
    """Send rows to `model` (list of dicts -> list of dicts or None) in small batches; every row stays.

    `schema` names the columns that come out. Columns that the model does not answer keep their value, or are null; a batch
    that fails `attempts` times, and rows behind the end of a short answer, count as not answered.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = [f.name for f in _parse_datatype_string(schema).fields]  # here, since workers have no session

    def run(frames):
        import pyarrow as pa

        for b in frames:
            records = b.to_pylist()
            for at in range(0, len(records), batch):
                part = records[at:at + batch]
                got = None
                for _ in range(attempts):
                    try:
                        got = model([dict(r) for r in part])
                        break
                    except (ValueError, OSError, RuntimeError):
                        continue
                got = list(got or [])[:len(part)]
                got += [None] * (len(part) - len(got))
                out = [{f: (g or {}).get(f, r.get(f)) for f in fields} for r, g in zip(part, got)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def validates(item: dict) -> bool:
    """`valid` for one answer of a model."""
    def full(x):
        return isinstance(x, list) and len(x) > 0 and all(isinstance(v, str) and v.strip() for v in x)

    def told(x):
        return isinstance(x, str) and x.strip() != ""

    score = item.get("innovation_score")
    number = isinstance(score, (int, float)) and not isinstance(score, bool) and 0 <= int(score) <= 100
    return told(item.get("executive_summary")) and full(item.get("business_implications")) and told(item.get("ai_relevance")) and full(item.get("industry_categories")) and number and item.get("sentiment") in C.SENTIMENTS


def through_cache(rows: DataFrame, cache: DataFrame, model: Callable, size: int = 3, attempts: int = 2, digits: int = 4) -> DataFrame:
    """`rows` (ord, url, title, published_at, canonical_url if there is one, ...) with cache_key, raw (an insight as JSON, or null) and insight_source.

    A valid entry of `cache` (cache_key, raw) stands for itself (`cache`). All others go to `model(items, attempt)`, a callable that takes a list
    of dicts and returns dicts with their url, in batches of `size`: keys are grouped by their first `digits` hex digits and go in
    order of key, so batches do not depend on partitions; take as many digits as give groups of some thousands. A batch is accepted once any of its
    items validates; else, or if the model fails, it is sent again, `attempts` times in all. An accepted batch's valid items count (`model`),
    the others keep the defaults (`default`).
    """
    import json

    canonical = F.col("canonical_url") if "canonical_url" in rows.columns else F.lit(None).cast("string")
    keyed = rows.withColumn("cache_key", cache_key(canonical, F.col("url"), F.col("title"), F.col("published_at")))
    known = cache.where(valid(insight(F.col("raw")))).dropDuplicates(["cache_key"]).select("cache_key", F.col("raw").alias("_known"))
    looked = keyed.join(known, "cache_key", "left")
    missed = looked.where("_known is null").select("cache_key", "ord", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("item"))
    place = Window.partitionBy(F.left("cache_key", F.lit(digits))).orderBy("cache_key", "ord")
    missed = missed.withColumn("_batch", F.floor((F.row_number().over(place) - 1) / size))
    batches = missed.groupBy(F.left("cache_key", F.lit(digits)).alias("_group"), "_batch").agg(F.sort_array(F.collect_list(F.struct("cache_key", "ord", "item"))).alias("items"))  # `size` items at most

    def run(frames):
        import pyarrow as pa

        for b in frames:
            for items in b.column(0).to_pylist():
                asked, answers = [json.loads(x["item"]) for x in items], {}
                for attempt in range(attempts):
                    try:
                        got = model([dict(x) for x in asked], attempt)
                    except (ValueError, OSError, RuntimeError):
                        continue
                    mine = {x["url"] for x in asked}
                    if any(validates(x) for x in got or [] if x.get("url") in mine):
                        answers = {x["url"]: x for x in got if x.get("url")}
                        break
                found = [answers.get(x["url"]) for x in asked]
                raw = [json.dumps({k: v for k, v in x.items() if k != "url"}) if x and validates(x) else None for x in found]
                yield pa.RecordBatch.from_pydict({"ord": [x["ord"] for x in items], "_made": raw}, schema=pa.schema([("ord", pa.int64()), ("_made", pa.string())]))

    made = batches.select("items").mapInArrow(run, "ord long, _made string")
    done = looked.join(made, "ord", "left")
    source = F.when(F.col("_known").isNotNull(), "cache").when(F.col("_made").isNotNull(), "model").otherwise("default")
    return done.select(*[F.col(f"`{c}`") for c in rows.columns], "cache_key", F.coalesce("_known", "_made").alias("raw"), source.alias("insight_source"))


def cache_after(cache: DataFrame, enriched: DataFrame) -> DataFrame:
    """The cache with the answers that `through_cache` got; they replace entries of their key."""
    new = enriched.where("insight_source = 'model'").dropDuplicates(["cache_key"]).select("cache_key", "raw")
    return upsert(cache.select("cache_key", "raw").dropDuplicates(["cache_key"]), new, "cache_key")


def join_insights(rows: DataFrame, results: DataFrame, defaults: dict[str, Column], order: str = "ord") -> DataFrame:
    """Rows with the insight columns of `results` (url, `order`, ...) by url, of several the last one; `defaults` where there is none."""
    last = results.groupBy("url").agg(F.max_by(F.struct(*defaults), order).alias("_insight"))
    known = F.col("_insight").isNotNull()
    return rows.join(last, "url", "left").withColumns({c: F.when(known, F.col("_insight")[c]).otherwise(d) for c, d in defaults.items()}).drop("_insight")
