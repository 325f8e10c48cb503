"""The pipeline as a whole against a brute-force version, and its stages and operators on awkward tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import kneser_ney, langid, license_scan, mixing, piece_bpe, quality_rules, simhash, sketch, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = {"en": "the plant in the north was built with some of the steel and then it grew while coast towns kept their kilns for cement and robots walked through every hall",
         "de": "das werk im norden wurde mit dem stahl gebaut und dann ist es gewachsen während städte an der küste ihre öfen behielten und roboter durch jede halle gingen"}


def fixture():
    r = random.Random(11)
    out = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(r.choice(TEXTS[lang].split()) for _ in range(r.randint(20, 160)))
        out.append([i, text, lang, ["web", "web", "web", "web", "book", "code", None][i % 7], len(text)])
    shared = out[4][1][:120]
    for i in (9, 22, 57):
        out[i][1] += "\n" + shared  # a passage that an earlier document has
    out[70][1] = "Ü" + out[4][1][3:90] + "é"  # only the middle is repeated, letters of two bytes stay whole
    for k, i in enumerate((2, 2, 15, 33)):
        out.append([200 + k, out[i][1] + ("." if k == 3 else ""), "en", "book", 0])  # exact and near copies
    out += [[300, None, "en", "web", None], [301, "", None, "web", 0], [302, "12 34 !! 5", "en", "web", 9], [303, "²²² ²", "en", "web", 5], [304, out[4][1][:60], "en", "code", 60]]
    return [tuple(x) for x in out]


def brute_language(rows, references, min_score=0.02):
    """Rows with a language, by looking for the longest match at each place in the reference itself."""
    known = {c for t in references.values() for c in t.lower() if c.isalpha()}
    assert len(known) <= langid.ONE  # each letter is one digit

    def symbols(t):
        s = []
        for c in t.lower():
            x = (c if c in known else "?") if c.isalpha() else " "
            if x != " " or (s and s[-1] != " "):
                s.append(x)
        return "".join(s)

    def phrases(s, ref):
        n = 0
        for at in range(0, len(s), langid.SEGMENT):
            part = s[at:at + langid.SEGMENT]
            i = 0
            while i < len(part):
                k = 0
                while i + k < len(part) and part[i + k] != "?" and part[i:i + k + 1] in ref:
                    k += 1
                n, i = n + 1, i + max(k, 1)
        return n

    refs = {k: symbols(v) for k, v in references.items()}
    out = []
    for row in rows:
        if not row[1] or not any(c.isalpha() for c in row[1]):
            continue
        costs = sorted(phrases(symbols(row[1]), ref) * math.log2(max(2, len(ref))) for ref in refs.values())
        if len(costs) < 2 or 1 - costs[0] / costs[1] >= min_score:
            out.append(row)
    return out


def brute_near_dedup(rows):
    """The row of least id of each component of texts whose 5-word shingles have a similarity of 0.8 or more."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    near = lambda x, y: (len(x & y) >= 0.8 * len(x | y)) if x | y else True
    kept, left = set(), sorted(sets)
    while left:
        group, todo = set(), [left[0]]
        while todo:
            x = todo.pop()
            group.add(x)
            todo += [y for y in left if y not in group and y not in todo and near(sets[x], sets[y])]
        kept.add(left[0])
        left = [x for x in left if x not in group]
    return [r for r in rows if r[0] in kept]


def brute_trim(rows):
    first = {}
    data = sorted((r[0], (r[1] or "").encode()) for r in rows)
    for i, b in data:
        for x in range(len(b) - 49):
            first.setdefault(b[x:x + 50], i)
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = {y for x in range(len(b) - 49) if first[b[x:x + 50]] < r[0] for y in range(x, x + 50)}
        text = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore") if gone else r[1]
        if not gone or text.strip():
            out.append((r[0], text, *r[2:]))
    return out


def brute_mix(rows, order, share=0.98, most_repeat=2.0):
    n = lambda t: len((t or "").encode().split())
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + n(r[1])
    bare = [r for r in rows if not size[r[3]]]  # rows of sources without tokens are used once
    size = {s: k for s, k in size.items() if k}
    total = sum(size.values())
    p = [k / total for k in size.values()]

    def fits(a):
        w = [x ** a for x in p]
        z = sum(w)
        repeat = [x ** (a - 1) for x in p]
        return -sum(x / z * math.log(x / z) for x in w) <= share * math.log(len(p)) + 1e-12 and max(repeat) / min(repeat) <= most_repeat

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    scale = max(k / (k / total) ** hi for k in size.values())
    out = bare
    for s, k in size.items():
        aim = math.floor((k / total) ** hi * scale * (1 + 1e-7))
        passes, rest, used = aim // k, aim % k, 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: order[r[0]]):
            used += n(r[1])
            out += [r] * (passes + (rest > 0 and used <= rest))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece

    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    references = {}
    for r in langid.references(df).orderBy("lang", "k").collect():
        references[r.lang] = references.get(r.lang, "") + ("\n" if r.lang in references else "") + r.text
    want = brute_trim(brute_near_dedup(brute_language(rows, references)))
    # The order of rows in a source's one block is by the hash of the text as it is then.
    order = {r.doc_id: r.h for r in spark.createDataFrame(want, SCHEMA).select("doc_id", F.xxhash64(F.lit(7), "doc_id", "text").alias("h")).collect()}
    want = brute_mix(want, order)
    assert {r[0] for r in want} & {200, 201, 202, 300, 301, 302, 303, 304} == set() and len(want) > len({r[0] for r in want}) > 100
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = [(r[0], len(ids := sp.encode(r[1])), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for r in want]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(digest)


# Columns with the names that operators use inside, and null, empty, repeated and very long rows.
CLASHING = ["fp", "rep", "component_id", "block", "copy", "sha", "bits", "marks", "s", "t", "b", "w", "d", "part", "guest", "tie", "score", "kept", "limit", "n_words", "perplexity", "held_out", "n_tokens", "_mix_block", "_mix_source", "_mix_tokens", "_near_hit", "_hit", "_bit", "_at", "_mask", "row", "hash", "place", "key", "set", "root", "skip", "range", "chunk", "rest", "edited", "next_text"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = fixture()[:30] + [(7, fixture()[7][1], "en", "web", 1), (7, "another text of one id", None, None, None), (None, None, None, None, None), (None, "a text without an id " * 9, "de", None, 1), (900, "", "", "", 0), (901, "word " * 60_000, "en", "web", 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, awkward, name, stage):
    out = stage(spark, awkward, "")
    assert out.columns == awkward.columns and out.count() <= awkward.count() + 30
    assert {r[0] for r in out.select("fp").distinct().collect()} == {"clash"}
    empty = stage(spark, awkward.limit(0), "")
    assert empty.columns == awkward.columns and empty.count() == 0


@pytest.mark.parametrize("operator", [simhash.query, suffix_dedup.query, sketch.query, langid.query, quality_rules.query, license_scan.query, piece_bpe.query])
def test_operators_give_every_row(awkward, operator):
    assert operator(awkward).count() == awkward.count() and operator(awkward.limit(0)).count() == 0
    nothing = awkward.withColumn("text", F.lit(None).cast("string"))
    assert operator(nothing).count() == awkward.count()


def test_run_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    for name, df in (("awkward", awkward.select(*[f.split()[0] for f in SCHEMA.split(", ")])), ("empty", awkward.select("doc_id", "text", "lang", "source", "n_chars").limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 20 if name == "awkward" else out.count() == 0)


def test_values_on_awkward_rows(awkward):
    """Null, empty, repeated, tied and very long rows have the results that the docstrings name."""
    rows = awkward.select("doc_id", "text").collect()
    times = lambda op, c: sorted((str(r.doc_id), r[c]) for r in op.collect())
    assert times(quality_rules.query(awkward), "n_words") == sorted((str(r.doc_id), len((r.text or "").split())) for r in rows)
    long = quality_rules.query(awkward).where("doc_id = 901").first()
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (60_000, 60_000, True)
    assert {r.lang_pred for r in langid.query(awkward).where("doc_id = 900").collect()} == {"und"}
    fps = simhash.query(awkward).collect()
    assert len({r.component_id for r in fps if r.fingerprint == "0" * 16}) == 1 and {r.component_id for r in fps if r.doc_id == 900} == {900}
    cut = suffix_dedup.query(awkward).where("doc_id = 7").collect()
    assert len(cut) == 3 and len({(r.n_bytes, r.n_removed) for r in cut}) == 2  # rows of one id are not earlier than each other


def test_classifier_and_mixture_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    assert kneser_ney.query(awkward, labels).count() == awkward.count()
    assert kneser_ney.query(awkward, labels.limit(0)).where("kept").count() == 0
    assert mixing.query(awkward).count() > 0 and mixing.query(awkward.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_base_columns_of_quality_rules(spark):
    text = "One #two é$\n\n \nOne #two é$\nlast <b> line & more\nOne #two é$"
    r = quality_rules.query(spark.createDataFrame([(1, text, "en"), (2, None, "en")], "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].word_chars, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words, r[0].base_failed) == (14, len("".join(text.split())), 9, 2, 9, True)
    assert (r[1].n_words, r[1].word_chars, r[1].n_symbols, r[1].n_dup_lines, r[1].base_failed, r[1].kept) == (0, 0, 0, 0, True, False)
