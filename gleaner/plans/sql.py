"""DuckDB expressions that give what the column functions give."""

from __future__ import annotations

from gleaner.functions import constants as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def count_in(text: str, signs) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {lit(s)}) AS INT)" for s in signs) + ")"


def host(u: str) -> str:
    return f"regexp_extract(lower(trim(coalesce({u}, ''))), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract(lower(trim(coalesce({u}, ''))), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def norm_url(u: str) -> str:
    """Its parameters are decoded and encoded by DuckDB's own functions."""
    low = f"regexp_replace(regexp_replace(lower(trim(coalesce({u}, ''))), '^http://', 'https://'), '(?s)#.*$', '')"
    whole = f"split_part({low}, '?', 1)"
    params = f"regexp_extract({whole}, '(;[^/]*)$', 1)"
    bare = f"rtrim(left({whole}, length({whole}) - length({params})), '/')"
    base = f"({bare} || CASE WHEN length({params}) < 2 THEN '' WHEN regexp_matches({bare}, '^[a-z]+://[^/]*$') THEN '/' || {params} ELSE {params} END)"
    asked = f"substr({low}, length({whole}) + 2)"
    plain = lambda x: f"url_decode(replace({x}, '+', ' '))"
    pairs = f"list_transform(list_filter(string_split({asked}, '&'), lambda p: contains(p, '=') AND instr(p, '=') < length(p)), lambda p: struct_pack(k := {plain('split_part(p, chr(61), 1)')}, v := {plain('substr(p, instr(p, chr(61)) + 1)')}))"
    kept = f"list_sort(list_filter({pairs}, lambda x: x.k NOT IN {inlist(C.TRACKING)}))"
    form = lambda x: f"replace(url_encode({x}), '%20', '+')"
    query = f"array_to_string(list_transform({kept}, lambda x: {form('x.k')} || '=' || {form('x.v')}), '&')"
    return f"(CASE WHEN {query} = '' THEN {base} ELSE {base} || '?' || {query} END)"


def domain(u: str) -> str:
    h = f"regexp_replace(regexp_replace(split_part(regexp_replace(lower(trim(coalesce({u}, ''))), '^[a-z][a-z0-9+.-]*://', ''), '/', 1), ':.*$', ''), '^www\\.', '')"
    p = f"string_split({h}, '.')"
    return (f"(CASE WHEN len({p}) <= 2 THEN {h} WHEN {p}[len({p}) - 1] IN {inlist(C.SECOND_LEVEL)} AND length({p}[len({p})]) = 2 "
            f"THEN array_to_string({p}[len({p}) - 2:], '.') ELSE array_to_string({p}[len({p}) - 1:], '.') END)")


def url_reason(u: str) -> str:
    h, p = host(u), path(u)
    ends = " OR ".join(f"ends_with({h}, {lit('.' + d)})" for d in C.DOMAINS)
    ext = " OR ".join(f"ends_with({p}, {lit(e)})" for e in C.PATH_ENDS)
    return (f"(CASE WHEN {h} = '' THEN 'no_host' WHEN {h} IN {inlist(C.DOMAINS)} OR {ends} THEN 'domain' "
            f"WHEN len(string_split({h}, '.')) > 2 AND split_part({h}, '.', 1) IN {inlist(C.SUBDOMAINS)} THEN 'subdomain' "
            f"WHEN {count_in(p, C.PATH_PARTS)} > 0 THEN 'path' WHEN {ext} THEN 'extension' ELSE 'ok' END)")


def norm_title(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def match_key(t: str) -> str:
    return f"regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]', '', 'g')"


def title_key(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def content_hash(t: str) -> str:
    return f"(CASE WHEN trim(coalesce({t}, '')) = '' THEN '' ELSE sha256(substr(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 400)) END)"


def quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}&-" else c for c in word).replace("'", "''")


def whole_word(t: str, word: str) -> str:
    w = word.lower()
    left, right = ("(^|[^\\p{L}\\p{N}_])" if w[:1].isalnum() else ""), ("($|[^\\p{L}\\p{N}_])" if w[-1:].isalnum() else "")
    return f"regexp_matches(lower(coalesce({t}, '')), '{left}{quoted(w)}{right}')"


def any_whole_word(t: str, many) -> str:
    return f"regexp_matches(lower(coalesce({t}, '')), '(^|[^\\p{{L}}\\p{{N}}_])(" + "|".join(quoted(w) for w in many) + ")($|[^\\p{L}\\p{N}_])')"


def singular_tag_word(w: str) -> str:
    return (f"(CASE WHEN length({w}) > 4 AND lower({w}) LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 4 AND right(lower({w}), 3) IN ('ses', 'xes', 'zes') "
            f"THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND lower({w}) LIKE '%s' AND lower({w}) NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)")


def singular(word: str) -> str:
    w = f"lower(trim({word}))"
    return (f"(CASE WHEN {w} IN {inlist(C.SINGULAR_WORDS)} THEN {w} WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' "
            f"WHEN length({w}) > 3 AND (right({w}, 4) IN ('shes', 'ches', 'sses') OR right({w}, 3) IN ('xes', 'zes')) THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) > 2 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)")


def content_reason(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    n = f"len(regexp_extract_all(coalesce({c}, ''), '[^\\s]+'))"
    paras = f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\n[ \\t]*\\n'), lambda x: length(trim(x)) > 30))"
    lines = f"len(list_filter(string_split(coalesce({c}, ''), chr(10)), lambda x: length(trim(x)) > 30))"
    sents = f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[.!?]+'), lambda x: length(trim(x)) > 10))"
    return (f"(CASE WHEN {n} < 60 THEN 'too_short' WHEN {paras} < 2 AND {lines} < 2 AND NOT ({n} >= 80 AND {sents} >= 3) THEN 'few_paragraphs' "
            f"WHEN {count_in(low, C.BOILERPLATE)} > 0 THEN 'boilerplate' ELSE 'ok' END)")


def source_type_reason(title: str, content: str) -> str:
    t, c = f"lower(coalesce({title}, ''))", f"lower(coalesce({content}, ''))"
    return (f"(CASE WHEN {count_in(t, C.TITLE_PHRASES)} > 0 THEN 'title' WHEN {count_in(c, C.CODE_SIGNS)} >= 3 THEN 'code' WHEN {count_in(c, C.LANDING_SIGNS)} >= 4 THEN 'landing' ELSE 'ok' END)")


def summary_ok(s: str, t: str) -> str:
    return f"(length(trim(coalesce({s}, ''))) >= 25 AND {count_in(f'lower({s})', C.PLACEHOLDERS)} = 0 AND lower(trim({s})) <> lower(trim({t})))"


def title_case(e: str) -> str:
    """Upper case after every non-letter, lower case elsewhere; the sharp s has two letters in upper case."""
    return (f"array_to_string(list_transform(string_split(lower({e}), ''), lambda x, i: CASE WHEN i = 1 OR NOT regexp_matches(substr(lower({e}), i - 1, 1), '^\\p{{L}}') "
            "THEN replace(replace(upper(x), 'ß', 'SS'), 'ẞ', 'SS') ELSE x END), '')")


def display_tag(t: str) -> str:
    return f"CASE WHEN {t} = 'ai' THEN 'AI' WHEN lower({t}) = {t} AND upper({t}) <> {t} THEN {title_case(t)} ELSE {t} END"


def normalize_tag(t: str) -> str:
    one = singular_tag_word("w")
    cut = f"CASE WHEN length(w) > length({one}) AND starts_with(lower(w), lower({one})) THEN left(w, length({one})) ELSE w END"
    word = (f"CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) <= 4 THEN w WHEN lower(substr(w, 2)) <> substr(w, 2) THEN {cut} "
            f"WHEN lower(w) = w AND upper(w) <> w THEN {title_case(one)} ELSE {one} END")
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(trim({t}), '\\s+'), lambda w: w <> ''), lambda w: {word}), ' ')"


def stale(tags: str, title: str) -> str:
    k = f"list_filter(list_transform({tags}, lambda x: lower(trim(x))), lambda x: x <> '')"
    words = f"list_filter(list_transform(regexp_split_to_array(lower({title}), '\\s+'), lambda w: trim(w, {lit(SIGNS)})), lambda w: w <> '')"
    plain = f"list_filter({words}, lambda w: w NOT IN {inlist(C.TITLE_FILLERS)})"
    within = " OR ".join(f"list_has_all({list(x)}, {k})" for x in (*C.STALE_LISTS, C.STALE_WORDS))
    single = f"len(list_filter({k}, lambda x: len(regexp_split_to_array(x, '\\s+')) <> 1)) = 0"
    return f"(len({k}) = 0 OR {within} OR {single} AND ({k} = list_slice({plain}, 1, greatest(len({k}), 1)) OR list_has_all(list_slice({words}, 1, 5), {k})))"


SIGNS = ".,;:!?()[]{}'\"-"
MARKS = "^[.,;:!?()\\[\\]{}''\"\\-]+|[.,;:!?()\\[\\]{}''\"\\-]+$"
CAPITAL = "[A-Z][a-zA-Z0-9.\\-]*"


def phrases(rows: str, connectors, stop_words) -> str:
    """CTEs over `rows` (ord, text): caps and nouns (ord, i, p), each occurrence of a phrase in its order; caps are without stop words at their ends."""
    pattern = f"\\b{CAPITAL}(?:\\s+(?:(?:{'|'.join(connectors)})\\s+)?{CAPITAL})*\\b"
    # To \\b of this engine only ASCII is a letter; other letters become underscores, which are letters to it and no part of the pattern.
    plain = "regexp_replace(x, '[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '_', 'g')"
    bad = [w for w in (*stop_words, *C.ARTEFACTS) if w not in connectors]
    return f"""sent AS (SELECT ord, regexp_split_to_array(text, '[.!?]+(?:\\s+|\\z)') AS s FROM {rows}),
found AS (SELECT ord, list_transform(flatten(list_transform(s, lambda x: regexp_extract_all({plain}, '{pattern}'))), lambda p: regexp_replace(p, '{MARKS}', '', 'g')) AS f FROM sent),
single AS (SELECT ord, unnest(f) AS p, unnest(range(1, len(f) + 1)) AS i FROM found),
wordy AS (SELECT ord, i, p, regexp_split_to_array(p, '\\s+') AS w FROM single WHERE length(p) >= 3),
fit AS (SELECT ord, i, w, list_filter(list_transform(w, lambda x, k: CASE WHEN lower(x) NOT IN {inlist(stop_words)} THEN k END), lambda k: k IS NOT NULL) AS own FROM wordy
 WHERE (len(w) <= 3 OR len(w) = 4 AND len(list_filter(w, lambda x: lower(x) IN {inlist(connectors)})) > 0) AND len(list_filter(w, lambda x: lower(x) IN {inlist(bad)})) = 0),
caps AS (SELECT ord, i, CASE WHEN len(own) = 0 THEN '' ELSE array_to_string(list_slice(w, list_min(own), list_max(own)), ' ') END AS p FROM fit),
raw AS (SELECT ord, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS r FROM {rows}),
tok AS (SELECT ord, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS pos FROM raw),
tidy AS (SELECT ord, pos, regexp_replace(t, '{MARKS}', '', 'g') AS t, regexp_matches(t, '[.!?]$') AS ends FROM tok),
judged AS (SELECT *, length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND lower(t) NOT IN {inlist((*stop_words, *C.ARTEFACTS))} AS ok FROM tidy),
cutup AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w + coalesce(sum(ends::INT) OVER (PARTITION BY ord ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM judged WINDOW w AS (PARTITION BY ord ORDER BY pos)),
grams AS (SELECT ord, run, pos, t AS p1, t || ' ' || lead(t) OVER w AS p2, t || ' ' || lead(t) OVER w || ' ' || lead(t, 2) OVER w AS p3 FROM cutup WHERE ok WINDOW w AS (PARTITION BY ord, run ORDER BY pos)),
nouns AS (SELECT ord, struct_pack(run := run, n := n, pos := pos) AS i, p FROM (SELECT ord, run, pos, unnest([1, 2, 3]) AS n, unnest([p1, p2, p3]) AS p FROM grams) WHERE p IS NOT NULL)"""
