"""Deduplication: by key, by layered rules in order of quality, and merges of pools."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleaner.functions.columns import blank, content_hash, normalize_url
from gleaner.operators.select import first_wins
from gleaner.sources.stores import shared_dir


@F.pandas_udf(DoubleType())
def title_ratio(current: pd.Series, kept: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; directional, so the order of arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(current, kept)])


def by_key(df: DataFrame, key, order: str = "ord") -> DataFrame:
    """First row of each non-blank key; rows with a blank key stay."""
    rows = df.withColumn("_k", key)
    return first_wins(rows.where("_k <> ''"), "_k", order).unionByName(rows.where("_k = ''")).drop("_k")


def merge_pools(new: DataFrame, old: DataFrame, time: str, now: str, days: int) -> DataFrame:
    """New rows before old ones, first url wins; old rows expire, but stay if their time can't be parsed."""
    at = F.try_to_timestamp(F.col(time))
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    alive = old.where(at.isNull() | (at >= cutoff))
    both = new.withColumn("priority", F.lit(0)).unionByName(alive.withColumn("priority", F.lit(1)))
    return first_wins(both.withColumn("_o", F.struct("priority", "ord")), "url", "_o").drop("_o")


def first_provider(df: DataFrame, phrase: str = "phrase", priority: str = "priority") -> DataFrame:
    """Rows of each phrase's first provider that has any."""
    return df.join(df.groupBy(phrase).agg(F.min(priority).alias("_p")), phrase).where(F.col(priority) == F.col("_p")).drop("_p")


def title_key(title: Column) -> Column:
    """The letters, digits and underscores of a title in lower case."""
    return F.regexp_replace(F.lower(blank(title)), "[^\\p{L}\\p{N}_]+", "")


def dealt(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that both sides are dealt out for: tables that grow with the input would else be broadcast up to the
    session's threshold, and a query of many such joins at a time fills the driver."""
    return df.hint("merge")


SPARE = 2  # pieces beyond what edits can break
BLOCK = 16  # places in a string that share a key


def _pieces(n: Column, ratio: float) -> tuple[Column, Column, Column]:
    """How many pieces a key of `n` characters is cut into, how long they are, and how many of them edits can break."""
    longest = F.floor((2 - ratio) / ratio * n + 1e-9)  # of the other string
    edits = F.floor((1 - ratio) * (n + longest) + 1e-9).cast("int")
    count = F.least(n, edits + SPARE)
    return count, F.greatest(F.lit(1), F.floor(n / count).cast("int")), edits


def _letter_bits(text: Column) -> Column:
    """64 bits, of which at most as many differ between two strings as they have letters that the other lacks, order aside: each
    occurrence of a letter, numbered, turns one of them."""
    def bits(s):
        bit = F.transform(s, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, i - F.array_position(s, c)), F.lit(64)).cast("int")))
        return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))

    return F.get(F.transform(F.array(F.array_sort(F.split(text, ""))), bits), 0)


def _shared_letters(a: Column, b: Column) -> Column:
    """How many characters two strings have in common, order aside: no matching can have more."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def similar_keys(left: DataFrame, right: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(t, u): keys of `left` (t) with other keys of `right` (u) that they reach the ratio with; keys are distinct and not blank.

    A ratio r of two strings of n and m characters leaves at most (1 - r)(n + m) single deletions and insertions, and each
    breaks at most one of the first string's pieces. With SPARE more pieces than that, at least SPARE stand whole in the other string, so one of
    any `edits + 1` pieces does: those are taken that fewest strings hold near their place, which leaves a phrase that many titles share aside.
    A whole piece is moved by no more places than letters are deleted or inserted, so pieces meet by hash and block of places, and the join itself
    drops rows whose lengths, places or letters allow no such ratio; rows are narrow and strings come back by hash. The UDF then decides.
    """
    count, size, edits = _pieces(F.length("t"), ratio)
    hashed = lambda s, block: F.xxhash64(s, block.cast("long"))
    cuts = left.select("t", F.length("t").alias("n"), _letter_bits(F.col("t")).alias("t_bits"), count.alias("count"), size.alias("size"), edits.alias("edits"))
    cuts = cuts.select("t", "n", "t_bits", "size", "edits", F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: i * F.col("size"))).alias("at"))
    blocks = F.sequence(F.floor(F.greatest(F.col("at") - F.col("edits"), F.lit(0)) / BLOCK), F.floor((F.col("at") + F.col("edits")) / BLOCK))
    cuts = cuts.select("t", "n", "t_bits", "edits", "at", F.expr("substring(t, at + 1, size)").alias("piece"), F.explode(blocks).alias("block"))
    cuts = cuts.select("t", "n", "t_bits", "edits", "at", hashed(F.col("piece"), F.col("block")).alias("h"))
    m = F.length("u")
    low, high = F.greatest(F.lit(1), F.ceil(ratio / (2 - ratio) * m - 1e-9).cast("int")), F.floor((2 - ratio) / ratio * m + 1e-9).cast("int")
    spots = right.select("u", m.alias("m"), _letter_bits(F.col("u")).alias("u_bits"), F.explode(F.array_distinct(F.transform(F.sequence(low, high), lambda k: _pieces(k, ratio)[1]))).alias("size")).where("size <= m")
    spots = spots.select("u", "m", "u_bits", "size", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size"))).alias("place"))
    spots = spots.select(F.xxhash64("u").alias("u_hash"), "m", "u_bits", "place", hashed(F.expr("substring(u, place + 1, size)"), F.floor(F.col("place") / BLOCK)).alias("h"))
    held = spots.groupBy("h").agg(F.count("*").alias("held"))
    piece = cuts.join(dealt(held), "h").groupBy("t", "n", "t_bits", "edits", "at").agg(F.sum("held").alias("held"), F.collect_list("h").alias("hs"))
    rarest = F.row_number().over(Window.partitionBy("t").orderBy("held", "at"))
    absent = F.col("count") - F.count("*").over(Window.partitionBy("t"))  # pieces that no string holds come first
    piece = piece.withColumns({"count": _pieces(F.col("n"), ratio)[0], "k": rarest}).withColumn("absent", absent).where("k + absent <= edits + 1")
    cuts = piece.select("t", "n", "t_bits", "at", F.explode("hs").alias("h"))
    least = F.ceil(ratio * (F.col("n") + F.col("m")) / 2 - 1e-9)  # letters that are matched at this ratio
    moved = F.col("place") - F.col("at")
    fits = (least <= F.least("n", "m")) & (moved >= least - F.col("n")) & (moved <= F.col("m") - least) & (F.bit_count(F.col("t_bits").bitwiseXOR(F.col("u_bits"))) <= F.col("n") + F.col("m") - 2 * least)
    near = cuts.join(dealt(spots), "h").where(fits).select("t", "u_hash").distinct()
    near = near.join(dealt(right.select("u", F.xxhash64("u").alias("u_hash"))), "u_hash").where("t <> u")
    near = near.where(2 * _shared_letters(F.col("t"), F.col("u")) >= ratio * (F.length("t") + F.length("u")) - 1e-9)
    return near.select("t", "u").where(title_ratio("t", "u") >= ratio)


def similar_titles(rows: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(a, b, equal): links between titles, each title named by its least `ord`, in every direction that reaches the ratio; and, where
    `equal`, every further row a of a title with that title's least ord b."""
    t = rows.select("ord", title_key(F.col("title")).alias("t")).where("t <> ''")
    named = t.groupBy("t").agg(F.min("ord").alias("a"))
    other = named.select(F.col("t").alias("u"), F.col("a").alias("b"))
    links = similar_keys(named.select("t"), other.select("u"), ratio).join(dealt(named), "t").join(dealt(other), "u").select("a", "b", F.lit(False).alias("equal"))
    copies = t.join(dealt(named), "t").where("ord <> a").select(F.col("ord").alias("a"), F.col("a").alias("b"), F.lit(True).alias("equal"))
    return links.unionByName(copies)


def labels(rows: DataFrame) -> Column:
    """What a row may share with its duplicates, as array: canonical url if there is one, normalised url, title and content if not blank."""
    some = lambda kind, v: F.when(v != "", F.concat(F.lit(kind), v))
    canonical = [F.when(blank(F.col("canonical_url")) != "", F.concat(F.lit("c"), normalize_url(F.col("canonical_url"))))] if "canonical_url" in rows.columns else []
    return F.array_compact(F.array(*canonical, F.concat(F.lit("u"), normalize_url(F.col("url"))), some("t", title_key(F.col("title"))), some("h", content_hash(F.col("content")))))


def _titles(members: DataFrame, name: str) -> DataFrame:
    return members.where(F.startswith("g", F.lit("t"))).select(F.expr("substring(g, 2)").alias(name)).distinct()


def layered(rows: DataFrame, quality: str = "quality") -> DataFrame:
    """Keep rows greedily by quality, ties by `ord`: see `first_of_similar`."""
    return first_of_similar(rows, F.struct((-F.col(quality)).alias("q"), F.col("ord").alias("o")))


def first_of_similar(rows: DataFrame, rank: Column, ratio: float = 0.95) -> DataFrame:
    """Keep rows greedily in order of `rank`: a row goes if a kept row before it has its canonical or normalised url, a similar title or its content.

    Equal to one pass in that order: in each round the rows without an undecided better neighbour are kept and their worse
    neighbours go, until none is undecided. Rows are not paired: a round looks at each label's best undecided and kept
    rank, and those of similar titles. Needs columns ord, url, title, content, and canonical_url if there is one.
    """
    shared_dir(rows.sparkSession)  # for the checkpoints
    members = rows.select("ord", rank.alias("rank"), F.explode(labels(rows)).alias("g")).checkpoint()
    links = similar_keys(_titles(members, "t"), _titles(members, "u"), ratio).select(F.concat(F.lit("t"), "t").alias("g"), F.concat(F.lit("t"), "u").alias("h")).checkpoint()
    state = members.select("ord").distinct().withColumn("keep", F.lit(None).cast("boolean")).checkpoint()  # every row has a label
    best = (F.min("open").alias("open"), F.min("kept").alias("kept"))
    while state.where("keep is null").limit(1).count():
        at = members.join(dealt(state), "ord").select("g", F.when(F.col("keep").isNull(), F.col("rank")).alias("open"), F.when(F.col("keep"), F.col("rank")).alias("kept")).groupBy("g").agg(*best)
        at = at.unionByName(links.join(dealt(at.withColumnRenamed("g", "h")), "h").select("g", "open", "kept")).groupBy("g").agg(*best)
        before = lambda c: F.max(F.coalesce(F.col(c) < F.col("rank"), F.lit(False))).alias(c)
        near = members.join(dealt(at), "g").groupBy("ord").agg(before("open"), before("kept"))
        state = state.join(dealt(near), "ord").select("ord", F.when(F.col("keep").isNotNull(), F.col("keep")).when(F.col("kept"), False).when(~F.col("open"), True).alias("keep")).checkpoint()
    return rows.join(dealt(state.where("keep")), "ord", "left_semi")


def duplicate_of_any(rows: DataFrame, others: DataFrame, ratio: float | None = 0.95) -> DataFrame:
    """(ord, is_duplicate): a row shares its canonical url, normalised url or content with one of `others`, or has a title similar to
    one of theirs; without a ratio, an equal one."""
    mine = rows.select("ord", F.explode(labels(rows)).alias("g"))
    theirs = others.select(F.explode(labels(others)).alias("g")).distinct()
    hits = mine.join(dealt(theirs), "g", "left_semi").select("ord")
    if ratio is not None:
        links = similar_keys(_titles(mine, "t"), _titles(theirs, "u"), ratio).select(F.concat(F.lit("t"), "t").alias("g"))
        hits = hits.unionByName(mine.join(dealt(links), "g", "left_semi").select("ord"))
    hits = hits.distinct().withColumn("is_duplicate", F.lit(True))
    return rows.select("ord").join(dealt(hits), "ord", "left").select("ord", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))


def window_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
