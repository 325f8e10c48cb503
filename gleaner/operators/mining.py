"""Phrase mining: n-grams of content words, phrase statistics, composite keyword scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.columns import once, singular, title_case, words

MARKS = "^[.,;:!?()\\[\\]{}'\"-]+|[.,;:!?()\\[\\]{}'\"-]+$"
SENTENCE_END = "[.!?]+(?:\\s+|\\z)"
CONNECTORS = ("of", "and", "for", "in", "the", "on", "to", "at", "&")
CAPITAL = "[A-Z][a-zA-Z0-9.\\-]*"
CAPITALS = f"{CAPITAL}(?:\\s+(?:(?:{'|'.join(CONNECTORS)})\\s+)?{CAPITAL})*"


LETTER = "[\\p{L}\\p{N}_]"
EDGE = f"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))"


def trim_stop_words(phrase: Column, stop_words=C.STOP_WORDS) -> Column:
    """The phrase without stop words at its ends; blank if it has no others."""
    w = F.filter(F.split(phrase, "\\s+"), lambda x: x != "")
    kept = F.filter(F.transform(w, lambda x, i: F.when(~F.lower(x).isin(*stop_words), i)), lambda i: i.isNotNull())
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.slice(w, F.array_min(kept) + 1, F.array_max(kept) - F.array_min(kept) + 1), " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def noun_phrases(text: Column, stop_words=C.STOP_WORDS, verbs=()) -> Column:
    """All 1-, 2- and 3-grams inside runs of content words of one sentence, with their start, as array<struct<at, phrase>>."""
    t = F.transform(tokens(text), lambda w: F.struct(F.regexp_replace(w, MARKS, "").alias("w"), w.rlike("[.!?]$").alias("end")))
    # A word that breaks a run becomes null, so a slice without nulls lies inside a run; one that ends a sentence is null but as a phrase's last.
    kept = lambda x: F.when((F.length(x["w"]) >= 3) & ~x["w"].rlike("^[0-9]+$") & ~F.lower(x["w"]).isin(*stop_words, *verbs, *C.ARTEFACTS), x["w"])
    content = F.transform(t, lambda x: F.struct(kept(x).alias("last"), F.when(~x["end"], kept(x)).alias("inner")))

    def grams(c):
        def of(n):
            part = lambda i, k: F.get(c, i + k)["last" if k == n - 1 else "inner"]
            return F.filter(F.transform(c, lambda w, i: F.struct(i.alias("at"), F.concat(*[x for k in range(n) for x in ((F.lit(" "),) if k else ()) + (part(i, k),)]).alias("phrase"))), lambda x: x["phrase"].isNotNull())

        return F.concat(of(1), of(2), of(3))

    return once(content, grams)


def run_phrases(text: Column, stop_words=C.STOP_WORDS, verbs=()) -> Column:
    """The phrases of `noun_phrases` run by run: of each run of content words first single words, then pairs, then triples."""
    mark = "\u0002"  # stands behind each run
    t = F.transform(tokens(text), lambda w: F.struct(F.regexp_replace(F.regexp_replace(w, mark, ""), MARKS, "").alias("w"), w.rlike("[.!?]$").alias("end")))
    kept = lambda x: (F.length(x["w"]) >= 3) & ~x["w"].rlike("^[0-9]+$") & ~F.lower(x["w"]).isin(*stop_words, *verbs, *C.ARTEFACTS)
    line = F.array_join(F.transform(t, lambda x: F.when(kept(x), F.concat(x["w"], F.when(x["end"], f" {mark}").otherwise(""))).otherwise(mark)), " ")
    runs = F.filter(F.transform(F.split(line, mark), lambda r: F.trim(r)), lambda r: r != "")

    def grams(w):
        of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(1), of(2), of(3))

    return F.flatten(F.transform(runs, lambda r: once(F.split(r, " "), grams)))


def canonical_phrases(text: Column, stop_words=C.STOP_WORDS, verbs=()) -> Column:
    """The phrases of `run_phrases` without artefacts, in another order, as array<struct<phrase, canonical>>; variants are not yet renamed.

    Words are judged and made singular one by one, before they are put together: of a text each word is looked at once, not once for each phrase
    that holds it. No artefact holds a blank, so a phrase holds one if a word of it does.
    """
    least = [a for a in C.ARTEFACTS if not any(b in a for b in C.ARTEFACTS if b != a)]
    t = F.transform(tokens(text), lambda w: F.struct(F.regexp_replace(w, MARKS, "").alias("w"), w.rlike("[.!?]$").alias("end")))
    kept = lambda x: (F.length(x["w"]) >= 3) & ~x["w"].rlike("^[0-9]+$") & ~F.lower(x["w"]).isin(*stop_words, *verbs, *C.ARTEFACTS)
    named = F.transform(t, lambda x: F.struct(x["w"].alias("w"), F.when(kept(x), singular(x["w"])).alias("c"), x["end"].alias("end")))
    clean = F.transform(named, lambda x: F.struct(x["w"].alias("w"), F.when(~x["c"].rlike("|".join(least)), x["c"]).alias("last"), x["end"].alias("end")))
    content = F.transform(clean, lambda x: F.struct(x["w"].alias("w"), x["last"].alias("last"), F.when(~x["end"], x["last"]).alias("inner")))

    def grams(c):
        def of(n):
            part = lambda i, k: F.get(c, i + k)["last" if k == n - 1 else "inner"]
            joined = lambda f: F.concat(*[x for k in range(n) for x in ((F.lit(" "),) if k else ()) + (f(k),)])
            made = F.transform(c, lambda w, i: F.struct(joined(lambda k: F.get(c, i + k)["w"]).alias("phrase"), joined(lambda k: part(i, k)).alias("canonical")))
            return F.filter(made, lambda x: (F.length(x["canonical"]) >= 3) | x["canonical"].isin(*C.VARIANTS))  # a variant's name is longer

        return F.concat(of(1), of(2), of(3))

    return once(content, grams)


def capitalized_phrases(text: Column, stop_words=C.STOP_WORDS, verbs=()) -> Column:
    """Runs of capitalised words of one sentence, at most three (four with a connector), none of them a stop word or verb but for connectors."""
    runs = F.flatten(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_extract_all(s, F.lit("((?=[A-Z])" + EDGE + CAPITALS + EDGE + ")"), F.lit(1))))
    found = F.transform(runs, lambda p: F.regexp_replace(p, MARKS, ""))
    def ok(p):
        w = F.transform(F.split(p, "\\s+"), F.lower)
        short = (F.size(w) <= 3) | ((F.size(w) == 4) & F.arrays_overlap(w, words(CONNECTORS)))
        return short & (F.length(p) >= 3) & ~F.exists(w, lambda x: x.isin(*[s for s in (*stop_words, *verbs, *C.ARTEFACTS) if s not in CONNECTORS]))
    return F.filter(found, ok)


def canonical(phrase: Column) -> Column:
    c = F.array_join(F.transform(F.filter(F.transform(F.split(phrase, "\\s+"), lambda w: F.regexp_replace(w, MARKS, "")), lambda w: w != ""), singular), " ")
    return variant(c, F.lower)


def variant(phrase: Column, casing=lambda c: c) -> Column:
    """The fixed spelling of a phrase in lower case that has one, put through `casing`, else the phrase itself."""
    return once(phrase, lambda p: F.coalesce(casing(F.try_element_at(_variants(), p)), p))


def _variants() -> Column:
    return F.create_map(*[F.lit(x) for pair in C.VARIANTS.items() for x in pair])


def phrase_rows(rows: DataFrame, text: Column, key: str = "url", stop_words=C.STOP_WORDS, verbs=()) -> DataFrame:
    """(key, phrase, canonical, proper): each occurrence of a phrase, artefacts removed by substring as published."""
    # Noun phrases have no stop words.
    proper = F.transform(F.transform(capitalized_phrases(text, stop_words, verbs), lambda p: trim_stop_words(p, stop_words)), lambda p: F.struct(p.alias("phrase"), canonical(p).alias("canonical"), F.lit(True).alias("proper")))
    # One condition that names the column once, as a filter is computed from the column's expression.
    proper = F.filter(proper, lambda x: (x["phrase"] != "") & x["canonical"].rlike("(?s)^(?!.*(?:" + "|".join(C.ARTEFACTS) + ")).{3,}$"))
    plain = F.transform(canonical_phrases(text, stop_words, verbs), lambda x: F.struct(x["phrase"].alias("phrase"), x["canonical"].alias("canonical"), F.lit(False).alias("proper")))
    p = rows.select(key, F.inline(F.concat(proper, plain)))
    return p.select(key, "phrase", F.coalesce(F.lower(F.try_element_at(_variants(), F.col("canonical"))), "canonical").alias("canonical"), "proper")


def phrase_counts(phrases: DataFrame, key: str = "url") -> DataFrame:
    """(canonical, phrase, key, n, proper): occurrences by spelling and article, from which statistics and casings follow."""
    return phrases.groupBy("canonical", "phrase", key).agg(F.count("*").alias("n"), F.max("proper").alias("proper"))


def phrase_stats(phrases: DataFrame, key: str = "url") -> DataFrame:
    """(canonical, freq, articles, proper); phrases are dealt out once, by name, and counted where they lie."""
    return phrases.select("canonical", key, "proper").repartition("canonical").groupBy("canonical").agg(F.count("*").alias("freq"), F.countDistinct(key).alias("articles"), F.max("proper").alias("proper"))


def composite(stats: DataFrame) -> DataFrame:
    domain = F.col("canonical").isin(*C.DOMAIN_TOPICS) | F.exists(F.split("canonical", " "), lambda w: w.isin(*C.DOMAIN_WORDS))
    n = F.size(F.split("canonical", " "))
    s = stats.withColumn("domain", domain).where("domain or (articles >= 2 and freq >= 2)")
    return s.withColumn("score", (3.0 * F.col("articles") + 0.5 * F.col("freq")) * F.when(n == 2, 2.0).when(n >= 3, 2.5).otherwise(1.0) * F.when(F.col("proper"), 1.5).otherwise(1.0) * F.when(F.col("domain"), 3.0).otherwise(1.0))


def best_casing(phrases: DataFrame) -> DataFrame:
    """Per canonical phrase, the casing of most frequency times (1 + capitals); ties go to the first by spelling."""
    w = F.split("phrase", " ")
    bonus = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.when((F.upper(x) == x) & (F.lower(x) != x), 1.5).when(F.left(x, F.lit(1)).rlike("[A-Z]"), 2.0).otherwise(0.0))
    n = F.sum("n") if "n" in phrases.columns else F.count("*")
    c = phrases.groupBy("canonical", "phrase").agg(n.alias("n"), F.max("proper").alias("proper")).withColumn("w", F.col("n") * (1.0 + bonus))
    best = c.groupBy("canonical").agg(F.min_by("phrase", F.struct(-F.col("w"), "phrase")).alias("casing"), F.max("proper").alias("proper"))
    return best.withColumn("casing", F.when(F.col("proper") & F.left("casing", F.lit(1)).rlike("[a-z]"), title_case(F.col("casing"))).otherwise(F.col("casing")))


def fallback_tags(text: Column, stop_words=C.STOP_WORDS, verbs=()) -> Column:
    """Three tags without stop words at their ends: capitalised phrases by frequency, then noun phrases, then defaults."""
    # Equal phrases stand together in sorted order, so that counting takes no comparison of all pairs.
    def ranked(found):
        def runs(s):
            starts = F.filter(F.transform(s, lambda x, k: F.struct(k.alias("k"), x["i"].alias("i"), x["p"].alias("p"))), lambda y: (y["k"] == 0) | (F.get(s, y["k"] - 1)["p"] != y["p"]))
            count = lambda b, y, j: F.coalesce(F.get(b, j + 1)["k"], F.size(s)) - y["k"]
            return once(starts, lambda b: F.transform(F.array_sort(F.transform(b, lambda y, j: F.struct((-count(b, y, j)).alias("n"), y["i"].alias("i"), y["p"].alias("p")))), lambda x: x["p"]))

        return once(F.array_sort(F.transform(found, lambda p, i: F.struct(p.alias("p"), i.alias("i")))), runs)

    proper = F.filter(F.transform(capitalized_phrases(text, stop_words, verbs), lambda p: trim_stop_words(p, stop_words)), lambda p: F.length(p) >= 3)
    allowed = lambda e: F.filter(e, lambda p: ~F.lower(p).isin(*C.FORBIDDEN_TAGS))
    # Noun phrases are made only for a text whose capitalised ones are under three.
    more = F.concat(allowed(ranked(run_phrases(text, stop_words, verbs))), allowed(words(C.FALLBACK_TAGS)))
    every = once(allowed(ranked(proper)), lambda e: F.when(F.size(F.array_distinct(F.transform(e, F.lower))) >= 3, e).otherwise(F.concat(e, more)))

    def but(e, p):
        return F.filter(e, lambda x: F.lower(x) != F.lower(p))

    def three(e):
        def two(r):
            return F.array(F.get(e, 0), F.get(r, 0), F.get(but(r, F.get(r, 0)), 0))

        return once(but(e, F.get(e, 0)), two)

    return F.when(text.isNotNull(), once(every, three))
