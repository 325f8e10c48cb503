"""Tags: cleaning, counting, indexes, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.columns import blank, display_tag, match_key, once, singular_tag_word, title_case, words


def normalize_tag(tag: Column) -> Column:
    def one(w):
        s = singular_tag_word(w)
        upper = (F.upper(w) == w) & (F.lower(w) != w)
        inner = F.substring(w, F.lit(2), F.length(w))
        mixed = F.lower(inner) != inner
        cut = F.when((F.length(w) > F.length(s)) & F.startswith(F.lower(w), F.lower(s)), F.left(w, F.length(s))).otherwise(w)
        lower = (F.lower(w) == w) & (F.upper(w) != w)
        return F.when(upper & (F.length(w) <= 4), w).when(mixed, cut).when(lower, title_case(s)).otherwise(s)

    return F.array_join(F.transform(F.filter(F.split(F.trim(tag), "\\s+"), lambda w: w != ""), one), " ")


def clean_tags(tags: Column, title: Column, summary: Column, content: Column, stop_words=C.STOP_WORDS, most: int = 4, entities: Column | None = None, taxonomy: Column | None = None) -> Column:
    """At most `most` tags of one or two words, normalised, distinct, that occur in the article or in an entry of `entities` or `taxonomy`, or hold
    such an entry of three letters and more. Without these lists every tag passes where title, summary and content are all blank."""
    text = match_key(F.concat_ws(" ", blank(title), blank(summary), blank(content)))
    raw = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(F.regexp_replace(blank(t), "[^\\p{L}\\p{N}_\\s-]", "")))
    ok = F.filter(raw, lambda t: (t != "") & (F.size(F.split(t, "\\s+")) <= 2) & ~F.forall(F.split(t, "\\s+"), lambda w: w.rlike("^[0-9]+$")) & ~F.forall(F.split(t, "\\s+"), lambda w: F.lower(w).isin(*stop_words)))
    made = F.transform(ok, lambda t: once(normalize_tag(t), lambda n: F.struct(match_key(n).alias("k"), n.alias("t"))))
    lists = [F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda e: match_key(blank(e))) for x in (entities, taxonomy) if x is not None]

    def known(body, k):
        hit = F.contains(body, k)
        for x in lists:
            hit = hit | F.exists(x, lambda e: F.contains(e, k) | ((F.length(e) > 2) & F.contains(k, e)))
        return hit if lists else hit | ((blank(title) == "") & (blank(summary) == "") & (blank(content) == ""))

    def first(present):
        return once(F.transform(present, lambda x: x["k"]), lambda keys: F.filter(present, lambda x, i: F.array_position(keys, x["k"]) == i + 1))

    # The text is made once for all tags, not once for each.
    present = once(text, lambda body: F.filter(made, lambda x: (F.length(x["k"]) >= 2) & known(body, x["k"])))
    return F.slice(F.transform(once(present, first), lambda x: x["t"]), 1, most)


def keyword_counts(rows: DataFrame, tags: str = "tags", order: str = "ord") -> DataFrame:
    """Display tag and count, most frequent first, ties by lower-cased name and first appearance."""
    t = rows.select(F.explode(tags).alias("t"), order).where(F.trim("t") != "").withColumn("tag", display_tag(F.col("t")))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).orderBy(F.desc("n"), F.lower("tag"), "first_ord", "tag")


def inverted_index(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, url, published_at): each distinct url of each tag. A relation, so a tag of any number of urls is no single value; order by (published_at, url) descending to show one."""
    t = rows.select(F.explode(tags).alias("t"), "url", "published_at").select(F.lower(F.trim("t")).alias("tag"), "url", "published_at").where("tag <> ''").distinct()
    return t


def stale(tags: Column, title: Column) -> Column:
    """Placeholder lists, or the title's first words split into single-word tags."""
    k = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    within = F.lit(False)
    for lst in C.STALE_LISTS:
        within = within | (F.size(F.array_except(k, words(lst))) == 0)
    tw = F.filter(F.transform(F.split(F.lower(blank(title)), "\\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?()\\[\\]{}'\"-]+|[.,;:!?()\\[\\]{}'\"-]+$", "")), lambda w: w != "")
    plain = F.filter(tw, lambda w: ~w.isin(*C.TITLE_FILLERS))
    single = F.forall(k, lambda x: F.size(F.split(x, "\\s+")) == 1)
    from_title = single & ((k == F.slice(plain, 1, F.greatest(F.size(k), F.lit(1)))) | (F.size(F.array_except(k, F.slice(tw, 1, 5))) == 0))
    return (F.size(k) == 0) | within | (F.size(F.array_except(k, words(C.STALE_WORDS))) == 0) | from_title


def backfill(rows: DataFrame, table: DataFrame, tags: str = "tags") -> DataFrame:
    """Tags of the tag table where a row has none."""
    t = table.select("url", F.col("keywords").alias("_db"))
    return rows.join(t, "url", "left").withColumn(tags, F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, F.coalesce("_db", F.array().cast("array<string>"))).otherwise(F.col(tags))).drop("_db")
