"""Operator 10, mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source with token share p gets weight p^a / sum p^a. The exponent a is the
least one in [0, 1] at which the weights' entropy is not above the target and no source is repeated
more often than the limit allows; it is found by repeated 64-way bisection, each round one
aggregation over the sources (never a list of sources on the driver). If not even a = 1 meets the
target, a is 1.

Weights are realised as budgeted block permutations. Documents of a source are dealt to blocks by a
hash; the number of blocks follows the table's size. Each pass over a source, its epoch, has its own
order of blocks, a permutation by hash. A source's budget of tokens is spent on whole passes and then
on one partial pass, block after block in that pass's order; the block in which the budget ends is
cut at the document that would exceed it. Running sums are taken over the sums of ranges of blocks, then over the
blocks of one range, then over the rows of one block, so no source meets in one task, and what is to
be drawn of a source comes down to a few numbers, by which every row decides for itself.

Defined edge cases: a null text has no tokens; a null source is a source of its own; a source
without tokens has weight 0 and its rows are drawn once with `cover` and not at all without; rows of
one doc_id are told apart by their texts, and rows that are equal in both are drawn all or none; an
empty table gives no rows. Rows travel in one struct, so columns of any name do no harm.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut

WORD = "[^\\x20\\x09-\\x0D]+"
GRID, ROUNDS = 64, 5
BLOCK_BYTES = 1 << 20  # of the whole table, so a block of one source holds less
BROADCAST_SOURCES = 100_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy_share: float, max_repeat: float, cover: bool) -> float:
    """The mixing exponent for sources (n_tokens > 0); `cover`: the budget lets each source be used once at least."""
    n, total = sources.agg(F.count("*"), F.sum("n_tokens")).first()
    if not n:
        return 1.0
    lo, hi = 0.0, 1.0
    p = F.col("n_tokens") / F.lit(float(total))
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        # Per exponent a: z = sum p^a and y = sum p^a ln p^a give the entropy ln z - y / z; p^(a-1) bounds the repetitions.
        row = sources.select(F.posexplode(F.array(*[F.lit(a) for a in grid])).alias("k", "a"), p.alias("p")).groupBy("k").agg(
            F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.col("a") * F.ln("p")).alias("y"),
            F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least")).orderBy("k").collect()
        def fits(r) -> bool:
            repeat = r.most / r.least if cover else r.most / r.z
            return log(r.z) - r.y / r.z <= entropy_share * log(n) + 1e-12 and repeat <= max_repeat

        good = [r.k for r in row if fits(r)]
        first = min(good) if good else GRID
        if first == 0:
            return grid[0]
        lo, hi = grid[first - 1], grid[first]
    return hi


def _end_of_rest(light: DataFrame, mix: DataFrame, place) -> DataFrame:
    """(s, end): where each source's partial pass ends, as (place, block, hash, tie) of the last row that is drawn; hash is null if none of that block is."""
    per = light.groupBy("s", "block").agg(F.sum("t").alias("t")).withColumnRenamed("s", "s0")
    per = per.join(mix.select("s", "passes", "rest"), F.col("s0").eqNullSafe(F.col("s")))
    per = cut(per.select("s", "block", "t", "rest", place("s", "block", "passes").alias("place"), F.shiftright(place("s", "block", "passes"), 52).alias("range")))
    before = lambda order: F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Of a source's 4096 ranges of places, then of the blocks of one range, the one in which the rest is used up.
    at = lambda df, order: df.withColumn("before", before(order)).where("before <= rest and rest < before + t")
    ranges = at(per.groupBy("s", "rest", "range").agg(F.sum("t").alias("t")), ["range"])
    ranges = ranges.select(F.col("s").alias("s1"), F.col("range").alias("r1"), (F.col("rest") - F.col("before")).alias("left"))
    inside = per.join(ranges, F.col("s").eqNullSafe(F.col("s1")) & (F.col("range") == F.col("r1"))).select("s", "block", "t", "place", F.col("left").alias("rest"))
    ends = cut(at(inside, ["place", "block"]).select("s", "block", "place", (F.col("rest") - F.col("before")).alias("left")))
    last = ends.select(F.col("s").alias("s1"), F.col("block").alias("b1"), "left")
    rows = light.join(last, F.col("s").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1"))).groupBy("s", "left", "hash", "tie").agg(F.sum("t").alias("t"))
    rows = rows.withColumn("sum", F.sum("t").over(Window.partitionBy("s").orderBy("hash", "tie"))).where("sum <= left")
    rows = rows.groupBy("s").agg(F.max(F.struct("hash", "tie")).alias("row")).withColumnRenamed("s", "s1")
    return ends.join(rows, F.col("s").eqNullSafe(F.col("s1")), "left").select("s", F.struct("place", "block", "row.hash", "row.tie").alias("end"))


def draw(docs: DataFrame, columns: list[str], entropy_share: float = 0.98, max_repeat: float = 4.0, budget_tokens: int | None = None,
         cover: bool = False, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(row, epoch, block, place, hash, n_tokens, weight): every drawn row, once per drawing, with `columns` in the struct `row`.

    In order of (epoch, place, block, hash) the rows are the mixture. The budget is `budget_tokens`, or the table's own tokens;
    with `cover`, it is the least at which every source is used in full once, and `max_repeat` limits the most against the least used source.
    """
    name = lambda c: F.col(f"`{c}`")
    octets = docs.agg(F.sum(F.octet_length(name(text)))).first()[0] or 0
    blocks = 1 << max(0, ceil(log2(max(1, octets) / BLOCK_BYTES)))
    key = lambda k: F.xxhash64(F.lit(seed + k), name(doc_id), name(text))
    sized = docs.select(name(source).alias("s"), tokens(name(text)).alias("t"), key(0).alias("hash"), key(1).alias("tie"), F.struct(*map(name, columns)).alias("row"))
    sized = sized.withColumn("block", F.col("hash").bitwiseAND(F.lit(blocks - 1)))
    # One scan of the texts gives their tokens; all that follows works on these few bytes per row.
    light = cut(sized.select("s", "block", "hash", "tie", "t"))
    place = lambda s, block, epoch: F.xxhash64(F.lit(seed), s, block, epoch)

    totals = cut(light.groupBy("s").agg(F.sum("t").alias("n_tokens")))
    usable = totals.where("n_tokens > 0")
    a = exponent(usable, entropy_share, max_repeat, cover)
    total = float(usable.agg(F.sum("n_tokens")).first()[0] or 0)
    power = F.pow(F.col("n_tokens") / F.lit(max(total, 1.0)), F.lit(a))
    z, scale = usable.agg(F.sum(power), F.max(F.col("n_tokens") / power)).first()
    budget = (scale or 0.0) * (z or 1.0) if cover else float(budget_tokens if budget_tokens is not None else total)
    weight = F.when(F.col("n_tokens") > 0, power / F.lit(z or 1.0)).otherwise(0.0)
    # A ten-millionth of slack keeps a source that is meant to be used a whole number of times from losing a document to rounding.
    aim = F.floor(weight * F.lit(budget) * F.lit(1 + 1e-7)).cast("long")
    mix = totals.select("s", "n_tokens", weight.alias("weight"), aim.alias("aim"))
    mix = mix.withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("aim") / F.col("n_tokens"))).otherwise(int(cover)).cast("long"))
    mix = cut(mix.withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("aim") - F.col("passes") * F.col("n_tokens")).otherwise(0)))
    ends = _end_of_rest(light, mix.where("n_tokens > 0"), place).withColumnRenamed("s", "s1")
    plan = cut(mix.join(ends, F.col("s").eqNullSafe(F.col("s1")), "left").select(F.col("s").alias("s2"), "weight", "passes", "end"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)

    own = place("s", "block", "passes")
    whole = own < F.col("end.place")
    part = (own == F.col("end.place")) & (F.col("block") == F.col("end.block")) & (F.struct("hash", "tie") <= F.struct("end.hash", "end.tie")) & F.col("end.hash").isNotNull()
    copies = F.col("passes") + F.when(whole | part, 1).otherwise(0)
    rows = sized.join(plan, F.col("s").eqNullSafe(F.col("s2"))).withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("row", F.col("epoch").cast("int").alias("epoch"), "block", place("s", "block", "epoch").alias("place"), "hash", F.col("t").alias("n_tokens"), "weight")


def query(docs: DataFrame) -> DataFrame:
    """One row per drawing of a document; ordered by (epoch, place, block) the rows are the mixture."""
    d = draw(docs.select("doc_id", "text", "source"), ["doc_id", "source"])
    return d.select("row.doc_id", "row.source", "epoch", "block", "place", "n_tokens", F.round("weight", 9).alias("weight"))


def mixed(docs: DataFrame, entropy_share: float = 0.98, max_repeat: float = 2.0) -> DataFrame:
    """The rows of `docs`, each at least once, repeated so that the sources meet their weights, in the order of the mixture."""
    drawn = draw(docs, docs.columns, entropy_share, max_repeat, cover=True)
    order = ["epoch", "place", "block", "hash"]
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
