"""Scores of articles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.columns import blank, expand, parse_time, whole_word


def recency(published_at: Column, now: str) -> Column:
    """1 / (1 + age in days); 0.5 for blank, unparseable and zone-less times."""
    zoned = blank(published_at).rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(parse_time(published_at))) / 86400.0
    return F.coalesce(F.when(zoned, 1.0 / (1.0 + F.greatest(F.lit(0.0), age))), F.lit(0.5))


def keyword_match(keyword: str, title: Column, *others: Column) -> Column:
    total = F.lit(0.0)
    for k in expand(keyword):
        hit = F.lit(False)
        for o in others:
            hit = hit | whole_word(o, k)
        total = total + F.when(whole_word(title, k), 2.0).otherwise(0.0) + F.when(hit, 0.5).otherwise(0.0)
    return total


def quality(pinned: Column, url: Column, content: Column, summary: Column, relevance: Column) -> Column:
    return (F.when(pinned, 1e6).otherwise(0.0) + F.when(~F.contains(blank(url), F.lit("-mock.com")), 1e4).otherwise(0.0)
            + 0.1 * F.length(blank(content)) + 0.5 * F.length(blank(summary)) + 10.0 * F.coalesce(relevance, F.lit(0.0)))
