"""Operator 5, document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's 5-word shingles, ascending. The sketch
of a union is the k smallest of both sketches together, so sketches of parts merge. Resemblance is
the share of the union's k smallest that stands in both sketches, containment the share of one
sketch's hashes below the other's bound that the other has, and the number of distinct shingles
follows from the k-th hash. Texts with at most k distinct shingles are compared exactly.

Words are runs of characters other than ASCII white space, lower-cased; a text of one to four words
is one shingle, and a text without words has an empty sketch. Two empty sketches have resemblance 1,
an empty and a full one 0.

Each document's text is also edited with the beginning of the next document by id. Ids are cut into
ranges at quantiles of a sample by hash, which only decides where ranges end; a range is a window's partition, and the first row of the next range is sent
along as a guest row, so no single task sees the table and the texts are shuffled once. Ranges grow in
number with the table to 50,000, beyond that (200 million documents) in rows, which the window sorts with spilling.

Defined edge cases: a null text counts as empty; rows with one doc_id are neighbours in order of
their texts' hashes; rows with a null doc_id come last; a single row is its own next document; an
empty table gives no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import hex64

K, SHINGLE = 128, 5
ROWS_PER_RANGE, RANGES = 4000, 50_000
SAMPLED = 16  # ids a range, from which the cuts between ranges are taken


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text column as an ascending array of longs."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    shingles = lambda h: F.when(F.size(h) >= width, F.transform(
        F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))).when(
        F.size(h) > 0, F.array(F.xxhash64(F.lit("short"), h))).otherwise(F.array().cast("array<bigint>"))
    # The one-element array lets the word hashes be named once in the lambda instead of being computed at each use.
    found = F.get(F.transform(F.array(hashes), shingles), 0)
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance of the two shingle sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    bound = F.when(F.size(b) < k, F.lit(None).cast("long")).otherwise(F.array_max(b))
    known = F.filter(a, lambda h: bound.isNull() | (h <= bound))
    return F.when(F.size(known) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(known, b)) / F.size(known))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.array_max(a).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def hex_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: hex64(h)), "")


def merge_groups(sketches: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """One merged sketch per group; hashes are made distinct before they meet, whatever the group's size."""
    from pyspark.sql import Window as W

    h = sketches.select(group, F.explode(column).alias("h")).distinct()
    low = h.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy("h"))).where(F.col("r") <= k)
    return low.groupBy(group).agg(F.sort_array(F.collect_list("h")).alias(column))


def with_next(docs: DataFrame, columns: list[str], next_columns: dict[str, str], order: str = "doc_id", tie: str = "text",
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds `next_columns` (new name -> column) of the next row by `order`; the last row's next is the first."""
    ids = docs.select(order).where(F.col(order).isNotNull())
    n, low = ids.agg(F.count("*"), F.min(order)).first()
    parts = max(1, min(RANGES, n // rows_per_range))
    cuts: list[int] = []
    if parts > 1:
        every = max(1, n // (parts * SAMPLED))
        some = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64(order), F.lit(every)) == 0).distinct().collect())
        cuts = sorted({some[len(some) * i // parts] for i in range(1, parts)} - {low}) if some else []
    # The cuts are one literal; a row finds its range among every `step`-th cut and then among the cuts up to the next of these.
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    step = max(1, int(len(cuts) ** 0.5))
    bounds, coarse = numbers(cuts), numbers(cuts[step - 1::step])
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col(order)))
    last = len(cuts)
    docs = docs.withColumn("skip", upto(coarse) * step)
    docs = docs.withColumn("range", F.when(F.col(order).isNull(), last).otherwise(F.col("skip") + upto(F.slice(bounds, F.col("skip") + 1, F.lit(step)))))
    at = F.col("range")
    seat = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    none = F.array().cast("array<struct<part:int,guest:int>>")
    seats = F.concat(F.array(seat(at, 0)),
                     F.when((at > 0) & (F.get(bounds, at - 1) == F.col(order)), F.array(seat(at - 1, 1))).otherwise(none) if cuts else none,
                     F.when(F.col(order).isNull() if low is None else F.col(order) == low, F.array(seat(F.lit(last), 2))).otherwise(none))
    rows = docs.select(*columns, F.inline(seats), F.xxhash64(tie).alias("tie"))
    w = Window.partitionBy("part").orderBy("guest", F.col(order).asc_nulls_last(), "tie")
    rows = rows.withColumns({new: F.lead(old).over(w) for new, old in next_columns.items()})
    return rows.where(F.col("guest") == 0).drop("part", "guest", "tie")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text, of its edited text and of the next text, with their likeness."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("s", sketch(F.col("text"), k))
    d = with_next(own, ["doc_id", "text", "s"], {"next_text": "text", "next_s": "s"})
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "s", "next_s",
                 F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)).alias("edited"))
    return d.select("doc_id", "n_chars", "s", "next_s", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("e"))


def query(docs: DataFrame) -> DataFrame:
    d = fingerprint_edits(docs)
    return d.select("doc_id", "n_chars", "edited_sha256", hex_string(F.col("s")).alias("fingerprint"), hex_string(F.col("e")).alias("edited_fingerprint"),
                    resemblance(F.col("s"), F.col("e")).alias("near_edited"), resemblance(F.col("s"), F.col("next_s")).alias("near_next"),
                    containment(F.col("e"), F.col("s")).alias("edited_in_text"), distinct_shingles(F.col("s")).alias("n_shingles"))
