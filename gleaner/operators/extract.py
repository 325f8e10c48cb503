"""Readable text of a page by three stages: paragraphs, containers, dense lines; and the step that reads the pages of candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gleaner.functions import constants as C
from gleaner.functions.columns import blank, url_reason

CLASS, IDS = re.compile("|".join(C.MAIN_CLASSES)), re.compile("|".join(C.MAIN_IDS))
MAX_WORDS, MAX_BLOCKS, FEW_WORDS, FEW_BLOCKS, ENOUGH_WORDS = 250, 8, 60, 2, 150
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Reader(HTMLParser):
    """The texts of a page outside of dropped elements, and its elements as ranges of these texts and of the elements inside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.elements: list[list] = []  # tag, class, id, first text, end of texts, end of elements
        self.open: list[int | str] = []  # numbers of elements, or the tag of a dropped one
        self.dropped, self.canonical = 0, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").split() and a.get("href"):
            self.canonical = a["href"].strip()
        if tag in VOID:
            return
        if self.dropped or tag in C.DROPPED:
            self.dropped += tag in C.DROPPED
            self.open.append(tag)
        else:
            self.open.append(len(self.elements))
            self.elements.append([tag, a.get("class", ""), a.get("id", ""), len(self.texts), None, None])

    def handle_endtag(self, tag):
        named = lambda x: x if isinstance(x, str) else self.elements[x][0]
        if any(named(x) == tag for x in reversed(self.open)):
            while named(last := self.open.pop()) != tag:
                self._end(last)
            self._end(last)

    def _end(self, x):
        if isinstance(x, str):
            self.dropped -= x in C.DROPPED
        else:
            self.elements[x][4:] = len(self.texts), len(self.elements)

    def handle_data(self, data):
        if not self.dropped:
            self.texts.append(data)

    def close(self):
        super().close()
        while self.open:
            self._end(self.open.pop())

    def text(self, e: list) -> str:
        return "".join(self.texts[e[3]:e[4]])


class _Blocks(list):
    """Blocks of text until there are enough of them."""

    words = 0

    def full(self, text: str) -> bool:
        self.append(" ".join(text.split()))
        self.words += len(self[-1].split())
        return self.words >= MAX_WORDS or len(self) >= MAX_BLOCKS

    def few(self) -> bool:
        return self.words < FEW_WORDS or len(self) < FEW_BLOCKS


def _paragraphs(r: _Reader) -> _Blocks:
    out = _Blocks()
    for e in r.elements:
        if e[0] == "p" and len(t := r.text(e).strip()) > 30 and out.full(t):
            break
    return out


def _containers(r: _Reader) -> _Blocks:
    """Paragraphs and innermost divs of the main elements, which are known by tag, else by class, else by id."""
    out, numbered = _Blocks(), list(enumerate(r.elements))
    for test in (lambda e: e[0] in ("article", "main"), lambda e: CLASS.search(e[1]), lambda e: IDS.search(e[2])):
        if found := [x for x in numbered if test(x[1])]:
            break
    blocks = [k for k, e in numbered if e[0] in ("p", "div")]
    # A block holds the next one in order if any.
    inner = {k for k, after in zip(blocks, [*blocks[1:], len(r.elements)]) if r.elements[k][0] == "p" or after >= r.elements[k][5]}
    for k, box in found:
        for j in range(k + 1, box[5]):
            if j in inner and len(t := r.text(r.elements[j]).strip()) > 40 and out.full(t):
                break
        if len(out) >= FEW_BLOCKS or out.words >= ENOUGH_WORDS:
            break
    return out


def _lines(r: _Reader) -> _Blocks:
    out = _Blocks()
    for line in (x.strip() for x in "".join(r.texts).split("\n")):
        if len(line) >= 35 and not any(k in line.lower() for k in C.NAV_WORDS) and not re.search(r"[{}]|const |import ", line) and out.full(line):
            break
    return out


def page(html: str | None) -> tuple[str, str | None]:
    """(readable text, canonical link): a stage that gives under 60 words or two blocks is replaced by the next one's result."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    blocks = _paragraphs(r)
    if blocks.few():
        blocks = _containers(r)
    if blocks.few():
        blocks = _lines(r)
    return " ".join(" ".join(blocks).split()[:MAX_WORDS]), r.canonical


def readable(html: str | None) -> str:
    return page(html)[0]


SOME = 64  # pages that are strings at a time


def _some(batch: pa.Array) -> Iterator[list]:
    for at in range(0, len(batch), SOME):
        yield batch.slice(at, SOME).to_pylist()


@F.arrow_udf(StringType())
def readable_text(html: pa.Array) -> pa.Array:
    """A few pages at a time leave the Arrow batch, which pandas would make strings of as a whole."""
    return pa.array([readable(x) for some in _some(html) for x in some], pa.string())


@F.pandas_udf(StructType().add("content", StringType()).add("canonical_url", StringType()))
def read_page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page(h) for h in html], columns=["content", "canonical_url"])


def scraped(rows: DataFrame, cache: DataFrame | None = None, key: str = "url") -> DataFrame:
    """`rows` (url, title, html) with content, canonical_url and scrape_error: the mock text for mock urls, what `cache` (`key`, content) holds
    (the least of several texts), else the page's readable text; null with the reason where the url names no article, there is no page or no text in it."""
    known = cache.groupBy(key).agg(F.min("content").alias("_cached")) if cache is not None else None
    r = rows.join(known, key, "left") if known is not None else rows.withColumn("_cached", F.lit(None).cast("string"))
    before, after = C.MOCK_PAGE.split("{title}")
    mock = F.when(F.contains("url", F.lit("-mock.com")), F.concat(F.lit(before), blank(F.col("title")), F.lit(after)))
    reason = url_reason(F.col("url"))
    asked = mock.isNull() & F.col("_cached").isNull() & (reason == "ok")
    r = r.withColumn("_read", F.when(asked & F.col("html").isNotNull(), read_page(F.when(asked, F.col("html")))))
    text = F.coalesce(mock, "_cached", F.nullif("_read.content", F.lit("")))
    error = F.when(text.isNotNull(), None).when(reason != "ok", F.concat(F.lit("Invalid URL: "), reason)).when(F.col("html").isNull(), "no page").otherwise("no readable text")
    return r.withColumns({"content": text, "canonical_url": F.col("_read.canonical_url"), "scrape_error": error}).drop("_cached", "_read")
