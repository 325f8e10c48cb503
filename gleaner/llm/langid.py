"""Operator 6, language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A document is parsed greedily
against each automaton: the longest string that occurs in the reference is one phrase, and the next
phrase begins behind it. A language whose reference explains the document in few, long phrases is
close to it. Case is folded and every run of characters other than letters counts as one gap. The
phrase count is normalised by the reference's length (log2 of it, the cost of naming a place in it)
and the language with the least cost wins.

Letters of any script are told apart: those of the references are ranked by frequency and written in
digits, the commonest 36 in one, the rest in two to five, so an automaton has at most 64 symbols
whatever the alphabet. A letter that no reference has is a phrase of its own in every language. Texts
are parsed in lockstep, in segments of SEGMENT digits that each start a phrase, and every character
of every text is read.

The models are fitted on a bounded sample of labelled rows and know every labelled language: per
language at most `docs_per_language` whole texts, in order of their ids' hashes, until
`reference_chars` characters are reached; texts of up to `row_chars` characters come first, then longer
ones by length, so a language whose texts are all longer learns from the shortest, whole. Languages
are built apart, one task each, and only the automata are collected: they grow with the number of
languages and not with the table. A worker lays out one automaton at a time as a table, and keeps as
many as fit TABLE_BYTES.

Defined edge cases: a text that is null or has no letter is `und` with score 0; without any labelled
row every text is `und`; ties between languages go to the first by name; rows with a null doc_id are
never learned from and are not held out; repeated rows give equal rows; an empty table gives no
rows. `doc_id` and `lang` only choose what is learned and are never inputs of a prediction.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, give_back, map_texts, pieces

SYMBOLS = 64  # digits: 0 ends a segment, 1 is a letter that no reference has
GAP = 2  # a run of characters other than letters
ONE, TWO, THREE = 36, 16, 7  # leading digits of letters of one, two and three digits; the last one leads five
SEGMENT = 512
PIECE = 1 << 20  # characters of one text that are coded at a time
TABLE_BYTES = 192 << 20
NEW = np.int32(1 << 30)  # marks a transition that begins a phrase


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the start."""
    edges, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(edges)
        edges.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return edges


def letter_digits(rank: int) -> list[int]:
    """The digits of the letter of this rank, a code without common beginnings: 3 to 38, 39 to 54 and one more, 55 to 61 and two more, 62 and four more."""
    more, lead = SYMBOLS - GAP, GAP + 1
    for leads, behind in ((ONE, 0), (TWO, 1), (THREE, 2), (1, 4)):
        if rank < leads * more ** behind:
            out = [lead + rank // more ** behind]
            return out + [GAP + rank // more ** (behind - 1 - k) % more for k in range(behind)]
        rank -= leads * more ** behind
        lead += leads
    raise ValueError("more letters than Unicode has")


@cache
def _gap_or_unknown() -> np.ndarray:
    """1 for each code point that is a letter, 0 for any other."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], np.int32)


class Alphabet:
    """Digits of texts; `letters` by rank."""

    def __init__(self, letters: str):
        self.row = _gap_or_unknown().copy()  # rows of the table: 0 gap, 1 unknown letter, 2 and more the letters
        digits = [[GAP], [1], *map(letter_digits, range(len(letters)))]
        self.width = np.array([len(d) for d in digits])
        self.digits = np.array([d + [0] * (5 - len(d)) for d in digits], np.uint8)
        for k, c in enumerate(letters, 2):
            self.row[ord(c)] = k

    def codes(self, text: str) -> np.ndarray:
        parts, before = [], False
        for at in range(0, len(text), PIECE):
            row = self.row[np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            keep = row != 0
            after = keep[-1]
            keep[1:] |= keep[:-1]
            keep[0] |= before
            row, before = row[keep], after
            wide = self.width[row]
            parts.append(self.digits[row, 0] if (wide == 1).all() else self.digits[row][np.arange(5) < wide[:, None]])
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def count_letters(texts: list[str]) -> Counter:
    counts = Counter()
    for t in texts:
        counts.update(t.lower())
    return Counter({c: n for c, n in counts.items() if c.isalpha()})


def ranked(counts: dict[str, int]) -> str:
    return "".join(sorted(counts, key=lambda c: (-counts[c], c)))


def automaton(alphabet: Alphabet, texts: list[str]) -> tuple[int, bytes, bytes]:
    """Digits of the texts one after the other; places (state * 64 + digit) and targets of their automaton's transitions."""
    codes = alphabet.codes("\n".join(texts))
    edges = suffix_automaton(codes.tolist())
    places = [state * SYMBOLS + c for state, out in enumerate(edges) for c in out]
    return len(codes), np.array(places, np.int64).tobytes(), np.array([to for out in edges for to in out.values()], np.int32).tobytes()


class CrossParser:
    """Phrase counts of texts against one automaton per language: (language, digits, places, targets)."""

    def __init__(self, letters: str, models: list[tuple[str, int, bytes, bytes]]):
        self.alphabet = Alphabet(letters)
        models = sorted(models, key=lambda m: m[0])
        self.languages = [m[0] for m in models]
        self.cost = np.array([np.log2(max(2, m[1])) for m in models])
        self.edges = [(np.frombuffer(m[2], np.int64), np.frombuffer(m[3], np.int32)) for m in models]
        self.tables: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, references: dict[str, list[str]]) -> CrossParser:
        letters = ranked(count_letters([t for texts in references.values() for t in texts]))
        return cls(letters, [(lang, *automaton(Alphabet(letters), texts)) for lang, texts in references.items()])

    def table(self, k: int) -> np.ndarray:
        """Transitions of a language by state * 64 + digit, with those that begin a phrase."""
        if k in self.tables:
            return self.tables[k]
        places, targets = self.edges[k]
        first = places < SYMBOLS
        begin = np.full(SYMBOLS, NEW, np.int32)  # a digit that the reference lacks is a phrase of its own
        begin[places[first]] = targets[first] | NEW
        begin[0] = 0
        out = np.tile(begin, int(targets.max(initial=0)) + 1)
        out[places[~first]] = targets[~first]
        while self.tables and sum(t.nbytes for t in self.tables.values()) + out.nbytes > TABLE_BYTES:
            self.tables.pop(next(iter(self.tables)))
        self.tables[k] = out
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrase counts, one row per text and one column per language."""
        codes = [self.alphabet.codes(t) for t in texts]
        parts = np.array([-(-len(c) // SEGMENT) for c in codes])
        board = np.zeros((int(parts.sum()), SEGMENT), np.uint8)
        at = 0
        for c, n in zip(codes, parts):
            board[at:at + n].reshape(-1)[:len(c)] = c
            at += n
        order = np.argsort(-(board != 0).sum(axis=1), kind="stable")  # full segments first, so that steps can shrink
        live = np.count_nonzero(board[order] != 0, axis=0)
        steps = np.ascontiguousarray(board[order].T)
        out = np.zeros((len(board), len(self.languages)), np.int64)
        for k in range(len(self.languages)):
            table = self.table(k)
            state = np.zeros(len(board), np.int64)
            count = np.zeros(len(board), np.int32)
            for i in range(SEGMENT):
                n = live[i]
                if not n:
                    break
                got = table[(state[:n] << 6) + steps[i, :n]]
                count[:n] += got >> 30
                state[:n] = got & (NEW - 1)
            out[order, k] = count
        ends = np.concatenate([[0], np.cumsum(parts)])
        total = np.concatenate([np.zeros((1, out.shape[1]), np.int64), np.cumsum(out, axis=0)])
        return total[ends[1:]] - total[ends[:-1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        ask = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        at = 0
        while at < len(ask):  # at most about four million characters at a time
            sizes = list(accumulate(len(texts[k]) for k in ask[at:at + 4000]))
            n = max(1, sum(s <= 4_000_000 for s in sizes))
            bits = self.phrases([texts[k] for k in ask[at:at + n]]) * self.cost
            best = bits.argmin(axis=1)
            least = bits[np.arange(n), best]
            rest = bits.copy()
            rest[np.arange(n), best] = np.inf
            second = rest.min(axis=1)
            for j, k in enumerate(ask[at:at + n]):
                lang[k] = self.languages[best[j]]
                score[k] = 1.0 if not np.isfinite(second[j]) else float(max(0.0, 1 - least[j] / max(second[j], 1e-9)))
            at += n
        return lang, score


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def references(docs: DataFrame, docs_per_language: int = 100, reference_chars: int = 60_000, row_chars: int = 20_000) -> DataFrame:
    """(lang, k, text): whole texts to learn from, a bounded sample of the labelled rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # row_number() <= n is applied within each map task before the shuffle, so a frequent language sends few rows.
    first = Window.partitionBy("lang").orderBy(F.greatest(F.length("text"), F.lit(row_chars)), F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    some = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= docs_per_language)
    before = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return some.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < reference_chars).select("lang", "k", "text")


def learn(docs: DataFrame, **bounds: int) -> tuple[str, list[tuple[str, int, bytes, bytes]]]:
    """Letters by rank, and the automaton of each language, built in a task of its own."""
    chosen = cut(references(docs, **bounds))

    def letters(batches):
        counts = Counter()
        for b in batches:
            counts += count_letters(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["letter", "n"])

    found = chosen.select("text").mapInArrow(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # at most Unicode's letters
    by_rank = ranked({r.letter: r.n for r in found})

    def build(group):
        order = np.argsort(group.column("k").to_numpy())
        texts = group.column("text").to_pylist()
        n, places, targets = automaton(Alphabet(by_rank), [texts[k] for k in order])
        return pa.table({"lang": [group.column("lang")[0].as_py()], "n": pa.array([n], pa.int64()), "places": pa.array([places], pa.binary()), "targets": pa.array([targets], pa.binary())})

    return by_rank, [tuple(r) for r in chosen.groupBy("lang").applyInArrow(build, "lang string, n long, places binary, targets binary").collect()]


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`; learns from `learn_from`, or from `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs if learn_from is None else learn_from))

    def rows(texts):
        lang, score = _parser(shared).predict(texts)
        return {"lang_pred": lang, "score": score}

    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), ["doc_id", "held_out"], "text", "doc_id long, held_out boolean, lang_pred string, score double", rows, _forget)


_built: list = [None, None]  # the models that the worker's parser was made of, and the parser


def _parser(shared) -> CrossParser:
    if _built[0] is not shared.value:
        _built[:] = shared.value, CrossParser(*shared.value)
    return _built[1]


def _forget() -> None:
    """Lets go of the parser at a task's end; a worker that goes on to other stages would else keep its tables."""
    _built[:] = None, None


def query(docs: DataFrame) -> DataFrame:
    return identify(docs)


def keep_identified(docs: DataFrame, min_score: float = 0.02) -> DataFrame:
    """The rows of `docs` whose text has a language: not `und`, and the runner-up costs at least `min_score` more."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    columns = docs.columns

    def run(batches):
        for b in pieces(batches):
            lang, score = _parser(shared).predict(b.column(columns.index("text")).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= min_score for x, s in zip(lang, score)], pa.bool_()))
        _forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)
