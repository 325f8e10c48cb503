"""Predicates with reason codes: the first failing rule names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.columns import any_in, any_whole_word, blank, count_in, once, url_reason, words


def title_is_doc_type(title: Column) -> Column:
    return any_in(F.lower(blank(title)), C.TITLE_PHRASES)


def off_topic(*parts: Column) -> Column:
    return any_whole_word(F.concat_ws(" ", *[blank(p) for p in parts]), C.TOPICS)


def source_type_reason(title: Column, content: Column) -> Column:
    # The text in lower case is made once for all signs.
    signs = once(F.lower(blank(content)), lambda c: F.when(count_in(c, C.CODE_SIGNS) >= 3, "code").when(count_in(c, C.LANDING_SIGNS) >= 4, "landing").otherwise("ok"))
    return F.when(title_is_doc_type(title), "title").otherwise(signs)


def content_reason(content: Column) -> Column:
    c = blank(content)
    n = F.regexp_count(c, F.lit("[^\\s]+"))
    longer = lambda parts, k: F.size(F.filter(parts, lambda x: F.length(F.trim(x)) > k))
    paragraphs, lines, sentences = longer(F.split(c, "\\n[ \\t]*\\n"), 30), longer(F.split(c, "\n"), 30), longer(F.split(c, "[.!?]+"), 10)
    return (F.when(n < 60, "too_short").when((paragraphs < 2) & (lines < 2) & ~((n >= 80) & (sentences >= 3)), "few_paragraphs")
            .when(once(F.lower(c), lambda low: any_in(low, C.BOILERPLATE)), "boilerplate").otherwise("ok"))


def summary_ok(summary: Column, title: Column) -> Column:
    s = F.trim(blank(summary))
    return (F.length(s) >= 25) & (count_in(F.lower(s), C.PLACEHOLDERS) == 0) & (F.lower(s) != F.lower(F.trim(title)))


def relevance_score(title: Column, description: Column, content: Column, topic: str) -> Column:
    """20 for each keyword (priority words and the topic's words over three letters) that occurs, 100 at most."""
    topic = topic or "General Manufacturing & Industry"
    keys = list(dict.fromkeys([*C.PRIORITY, *(w.lower() for w in topic.split() if len(w) > 3)]))
    text = F.lower(F.concat_ws(" ", blank(title), blank(description), F.substring(blank(content), 1, 1000)))
    return F.least(count_in(text, keys) * 20.0, F.lit(100.0))


FUNCTION_WORDS = {"en": "the of and to in is that for it was with be on not this have from are by", "fr": "le la les et des du que qui est une pour dans par sur avec au", "de": "der die und das den nicht mit ist ein eine zu auf von dem auch",
                  "es": "el los las del con una por para es que en se como al", "no": "og det er som på til av har ikke med den"}


def is_english(*parts: Column) -> Column:
    """Own detector: letters mostly ASCII, and English function words outnumber those of three neighbours."""
    every = sorted({w for v in FUNCTION_WORDS.values() for w in v.split()})
    known = lambda many: lambda w: w.isin(*many)

    # Words are cut once, and the few that are function words of any language are then counted for each.
    def outnumber(found):
        hits = {k: F.size(F.filter(found, known(v.split()))) for k, v in FUNCTION_WORDS.items()}
        return hits["en"] > F.greatest(*[v for k, v in hits.items() if k != "en"])

    def of(text):
        best = once(F.filter(F.split(text, " "), known(every)), outnumber)
        letters = F.length(F.replace(text, F.lit(" "), F.lit("")))
        return (letters > 0) & (F.length(F.regexp_replace(text, "[^a-z]+", "")) >= 0.9 * letters) & best

    return F.coalesce(once(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^\\p{L}]+", " "), of), F.lit(False))


def keyword_search(articles: DataFrame, keyword: str, tags: str = "tags", title: str = "title", summary: str = "content") -> DataFrame:
    """Rows that match any comma-separated keyword by tag, title or summary; all rows for a blank keyword."""
    from gleaner.functions.columns import match_key

    if not keyword.strip():
        return articles
    keys = F.transform(words([k.strip() for k in keyword.split(",")]), match_key)
    tags_n = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), match_key)
    t, s = match_key(F.col(title)), match_key(F.col(summary))
    return articles.where(F.exists(keys, lambda k: F.array_contains(tags_n, k) | ((k != "") & (F.contains(t, k) | F.contains(s, k)))))


def reject_reason(title: str = "title", url: str = "url", content: str = "content") -> Column:
    """The candidate cascade up to the content rules as one reason column."""
    u = url_reason(F.col(url))
    t, c = F.col(title), F.col(content)
    st, q = source_type_reason(t, c), content_reason(c)
    return (F.when(u != "ok", "invalid_url").when(title_is_doc_type(t), "invalid_source_type").when(off_topic(t, F.col(url)), "failed_relevance_validation")
            .when(st != "ok", "invalid_source_type").when(q != "ok", "low_quality_content").otherwise("accepted_articles"))
