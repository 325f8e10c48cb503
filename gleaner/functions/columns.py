"""Scalar functions over columns: URLs, titles, tags, keywords, hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C

L = "[\\p{L}\\p{N}_]"  # letters as Python's \w has them; the same in Java and in RE2


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(value: Column, f) -> Column:
    """`f` of a value that is computed once; written out in a lambda it would be computed anew for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def count_in(text: Column, signs: Iterable[str]) -> Column:
    """How many of the signs occur in the text."""
    total = F.lit(0)
    for s in signs:
        total = total + F.contains(text, F.lit(s)).cast("int")
    return total


def any_in(text: Column, signs: Iterable[str]) -> Column:
    return count_in(text, signs) > 0


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(blank(url))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(blank(url))), "^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def decoded(part: Column) -> Column:
    """A part of a query with plus signs and percent codes decoded; percent signs that begin no code stay."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9a-fA-F]{2})", "%25"))


def encoded(part: Column) -> Column:
    """Text as a part of a query, as forms write it: letters, digits and _ . - ~ stay, blanks become plus signs."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Lower case, https, no trailing slashes, no fragment, no tracking or blank parameters, the others decoded, sorted and encoded."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.trim(blank(url))), "^http://", "https://"), "(?s)#.*$", "")
    whole = F.regexp_extract(u, "^([^?]*)", 1)
    params = F.regexp_extract(whole, "(;[^/]*)$", 1)  # of the last part of the path
    bare = F.regexp_replace(F.left(whole, F.length(whole) - F.length(params)), "/+$", "")
    slash = F.when(bare.rlike("^[a-z][a-z0-9+.-]*://[^/]*$"), "/").otherwise("")  # a path without parts keeps its slash before them
    base = F.concat(bare, F.when(F.length(params) > 1, F.concat(slash, params)).otherwise(""))
    pairs = F.transform(F.split(F.regexp_extract(u, "(?s)\\?(.*)$", 1), "&"), lambda p: F.regexp_extract_all(p, F.lit("^([^=]*)=(.+)$"), F.lit(0)))
    pairs = F.transform(F.flatten(pairs), lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    kept = F.filter(pairs, lambda x: ~x["k"].isin(*C.TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"]))), "&")
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def normalized_domain(url: Column) -> Column:
    """Registrable domain: two labels, or three under a country's second level."""
    rest = F.regexp_replace(F.lower(F.trim(blank(url))), "^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_replace(F.split_part(rest, F.lit("/"), F.lit(1)), ":.*$", ""), "^www\\.", "")
    parts = F.split(h, "\\.")
    n = F.size(parts)
    three = F.get(parts, n - 2).isin(*C.SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
    take = F.when(n <= 2, n).when(three, 3).otherwise(2)
    return F.array_join(F.slice(parts, n - take + 1, take), ".")


def url_reason(url: Column) -> Column:
    """Why a URL is no article's, or `ok`: the first rule that fails."""
    h, p = host(url), path(url)
    domain = h.isin(*C.DOMAINS)
    for d in C.DOMAINS:
        domain = domain | F.endswith(h, F.lit("." + d))
    labels = F.split(h, "\\.")
    end = F.lit(False)
    for e in C.PATH_ENDS:
        end = end | F.endswith(p, F.lit(e))
    return (F.when(h == "", "no_host").when(domain, "domain").when((F.size(labels) > 2) & F.get(labels, F.lit(0)).isin(*C.SUBDOMAINS), "subdomain")
            .when(any_in(p, C.PATH_PARTS), "path").when(end, "extension").otherwise("ok"))


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(blank(title)), "[^\\p{L}\\p{N}_\\s\\p{Z}]", "")
    return F.trim(F.regexp_replace(t, "[\\s\\p{Z}]+", " "))


def match_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]", "")


def hash_of(text: Column) -> Column:
    return F.when(blank(text) == "", "").otherwise(F.sha2(text, 256))


def content_hash(content: Column) -> Column:
    """SHA-256 of the first 400 letters, digits and underscores; empty for a blank text."""
    return F.when(F.trim(blank(content)) == "", "").otherwise(F.sha2(F.substring(F.regexp_replace(F.lower(content), "[^\\p{L}\\p{N}_]+", ""), 1, 400), 256))


def quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}&-" else c for c in word)


def whole_word(text: Column, word: str) -> Column:
    """The word occurs and no letter touches an end of it that is itself a letter or digit."""
    w = word.lower()
    left, right = ("(^|[^\\p{L}\\p{N}_])" if w[:1].isalnum() else ""), ("($|[^\\p{L}\\p{N}_])" if w[-1:].isalnum() else "")
    low = F.lower(blank(text))
    return F.contains(low, F.lit(w)) & low.rlike(left + quoted(w) + right)


def any_whole_word(text: Column, many: Iterable[str]) -> Column:
    low = F.lower(blank(text))
    return low.rlike("(^|[^\\p{L}\\p{N}_])(" + "|".join(quoted(w) for w in many) + ")($|[^\\p{L}\\p{N}_])")


def keyword_list(keyword: str) -> list[str]:
    return [k.strip().lower() for k in keyword.split(",") if k.strip()]


def expand(keyword: str) -> list[str]:
    """Comma-separated keywords with synonyms in place of those that have some; repeats stay."""
    return [s for k in keyword_list(keyword) for s in C.SYNONYMS.get(k, (k,))]


def expand_column(keyword: Column) -> Column:
    """`expand` for a column of keywords."""
    keys = F.filter(F.transform(F.split(keyword, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    def one(k):
        out = F.array(k)
        for name, many in C.SYNONYMS.items():
            out = F.when(k == name, words(many)).otherwise(out)
        return out
    return F.flatten(F.transform(keys, one))


def singular_tag_word(w: Column) -> Column:
    """Singular of a tag's word; the suffixes that need four letters are compared with three, as published."""
    n = F.length(w)
    low = F.lower(w)
    return (F.when((n > 4) & F.endswith(low, F.lit("ies")), F.concat(F.left(w, n - 3), F.lit("y")))
            .when((n > 4) & F.right(low, F.lit(3)).isin("ses", "xes", "zes"), F.left(w, n - 2))
            .when((n > 3) & F.endswith(low, F.lit("s")) & ~F.endswith(low, F.lit("ss")), F.left(w, n - 1)).otherwise(w))


def singular(word: Column) -> Column:
    """Singular of a mined word."""
    def of(w):
        n = F.length(w)
        es = F.right(w, F.lit(4)).isin("shes", "ches", "sses") | F.right(w, F.lit(3)).isin("xes", "zes")
        return (F.when(w.isin(*C.SINGULAR_WORDS), w).when((n > 4) & F.endswith(w, F.lit("ies")), F.concat(F.left(w, n - 3), F.lit("y")))
                .when((n > 3) & es, F.left(w, n - 2)).when((n > 2) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.left(w, n - 1)).otherwise(w))

    return once(F.lower(F.trim(word)), of)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    chars = F.split(F.lower(c), "")
    at = F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike("\\p{L}"), F.upper(x)).otherwise(x))
    return F.array_join(at, "")


def display_tag(tag: Column) -> Column:
    t = F.trim(tag)
    return F.when(t == "ai", "AI").when((F.lower(t) == t) & (F.upper(t) != t), title_case(t)).otherwise(t)


def first_letter(tag: Column) -> Column:
    f = F.upper(F.left(tag, F.lit(1)))
    return F.when(f.rlike("^[A-Z]$"), f).otherwise("#")


def parse_time(raw: Column) -> Column:
    """ISO timestamps; what can't be parsed is null."""
    return F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))
