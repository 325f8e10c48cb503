"""Operator 7, SentencePiece encoding and decoding by a merge-type prefix table.

The encoding of every prefix of a string is unique, so it is given by its last token. The table
holds that token for each prefix: an Aho-Corasick automaton names the tokens that end there, longest
first, and the first one that may follow the last token of what is left is it. Whether a token may
follow another ("pair compatibility") is decided by undoing merges on both sides of the joint and
asking at each step whether the merge rules would have joined across it earlier. The ids are then
read off the table from the end backwards.

No piece of the vocabulary has a space mark behind another character, so no token spans the joint
of two words; the table is built for each word and kept in a bounded cache. Characters that are not
in the vocabulary are never merged; they become their UTF-8 bytes.

Defined edge cases: a null text counts as empty, with no ids, and decodes to the empty text; texts of
any length are encoded whole; repeated rows give equal rows; an empty table gives no rows. Only
`doc_id` and `text` are read. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame

from gleaner.llm.common import map_texts

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_WORDS = 300_000  # words kept by one worker; the older half goes when they are too many
CACHE_PAIRS = 1_000_000

_encoders: dict[str, PrefixTableEncoder] = {}


class PrefixTableEncoder:
    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            raise ValueError("a piece joins words; words cannot be encoded on their own")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted((p for p in plain if len(p) > 1), key=lambda p: (-sp.get_score(plain[p]), len(p)))
        self.rank = {plain[p]: 0 for p in plain if len(p) == 1}
        self.rank |= {plain[p]: k for k, p in enumerate(order, 1)}
        self.ids, self.text = plain, {i: p for p, i in plain.items()}
        self.chars = frozenset(p for p in plain if len(p) == 1)
        # The last merge that makes each token out of its own characters; a token that the rules never make is left out.
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        made = [p for p in plain if len(p) == 1]
        for p in order:
            if (two := self._last_merge(p)) is not None:
                self.parts[plain[p]] = two
                made.append(p)
        self.match = ahocorasick.Automaton()
        for p in made:
            self.match.add_word(p, (plain[p], len(p)))
        self.match.make_automaton()
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """Merge the characters of one piece by rank, leftmost first; the two tokens joined last."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return None
            k = best[1]
            last = (parts[k], parts[k + 1])
            if any(x not in self.ids for x in last):
                return None
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return self.ids[last[0]], self.ids[last[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """True if the tokens a, b stay apart when their characters are encoded together."""
        key, rank, parts = (a, b), self.rank, self.parts
        # A merge across the joint must come before the merge that has just been undone: on the left
        # at a lower or equal rank (it stands further right than an equal one), on the right at a lower.
        before, good = float("inf"), True
        while True:
            joined = self.ids.get(self.text[a] + self.text[b])
            if joined is not None and rank[joined] < before:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra == 0 and rb == 0:
                break
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 0.5, parts[b][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def _run(self, run: str) -> list[int]:
        """Ids of characters that are all in the vocabulary, by the prefix table."""
        last, size = [0] * (len(run) + 1), [0] * (len(run) + 1)  # per prefix its last token and that token's length
        pairs = self.pairs
        for end, (token, length) in self.match.iter(run):
            end += 1
            if size[end]:
                continue
            if start := end - length:
                before = last[start]
                good = pairs.get((before, token))
                if not (self.may_follow(before, token) if good is None else good):
                    continue
            last[end], size[end] = token, length
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _merged(self, run: str) -> list[int]:
        """Ids by merging pair after pair, best score first and leftmost among equals."""
        ids, score = self.ids, self.library.get_score
        part: list[str | None] = list(run)
        after, ahead = list(range(1, len(run) + 1)), list(range(-1, len(run) - 1))
        heap = [(-score(ids[x]), k, x) for k in range(len(run) - 1) if (x := run[k] + run[k + 1]) in ids]
        heapq.heapify(heap)
        while heap:
            _, k, x = heapq.heappop(heap)
            r = after[k] if part[k] is not None else len(run)
            if r >= len(run) or part[k] + part[r] != x:
                continue
            part[k], part[r], after[k] = x, None, after[r]
            if after[r] < len(run):
                ahead[after[r]] = k
            for left, right in ((ahead[k], k), (k, after[k])):
                if left >= 0 and right < len(run) and (y := part[left] + part[right]) in ids:
                    heapq.heappush(heap, (-score(ids[y]), left, y))
        return [ids[x] for x in part if x is not None]

    def word(self, word: str) -> list[int]:
        known = self.ids
        if word.startswith(SPACE * 3):
            # Runs of marks are pieces of one equal score: their merges have no order by rank, so pair
            # compatibility cannot decide them.
            runs = re.findall(f"[{''.join(map(re.escape, set(word) & known.keys()))}]+|.", word, re.S)
            return [i for r in runs for i in (self._merged(r) if r[0] in known else [self.byte[b] for b in r.encode("utf-8")])]
        if self.chars.issuperset(word):
            return self._run(word)
        out, run = [], ""
        for c in word:
            if c in known:
                run += c
                continue
            out += self._run(run)
            run = ""
            out += [self.byte[b] for b in c.encode("utf-8")]
        return out + self._run(run)

    def pieces(self, text: str):
        """For each word of the text its ids and their decimal digits, comma-joined."""
        if not text:
            return
        words = self.words
        for w in WORDS.findall(SPACE + text.replace(" ", SPACE)):
            hit = words.get(w)
            if hit is None:
                hit = self.old.get(w)
                if hit is None:
                    ids = self.word(w)
                    hit = (tuple(ids), ",".join(map(str, ids)))  # tuples of ints are not tracked by the garbage collector
                if len(words) >= CACHE_WORDS // 2:
                    self.old, self.words = words, {}
                    words = self.words
                words[w] = hit
            yield hit

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, _ in self.pieces(text or "") for i in ids]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(model_file: str) -> PrefixTableEncoder:
    """One encoder for each model and worker process."""
    if model_file not in _encoders:
        _encoders[model_file] = PrefixTableEncoder(model_file)
    return _encoders[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row."""
    def rows(texts):
        e = encoder(model_file)
        ids = [e.encode(t) for t in texts]
        return {"ids": ids, "decoded": [e.decode(x) for x in ids]}

    return map_texts(docs, ["doc_id"], "text", "doc_id long, ids array<int>, decoded string", rows)


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode` with its outputs reduced where they arise."""
    def rows(texts):
        e = encoder(model_file)
        n, ids_sha, decoded_sha = [], [], []
        for t in texts:
            parts = list(e.pieces(t or ""))
            ids = [i for p in parts for i in p[0]]
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(p[1] for p in parts).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return map_texts(docs, ["doc_id"], "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    return digests(docs, model_file or default_model())


