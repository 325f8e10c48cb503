"""Operator 4, main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: its stop-word
density, its length, its link density and where it stands. Enough function words for its length make a
block good; links, or length without function words, make it bad; short blocks, headings and blocks
between the bounds are ambiguous. Inside an article or main element the bounds are half as high and
length without function words is no ground against a block. A page in which no longer block has
function words is in a language that the list does not know; there length and links decide. Elements
that are no text of the page by their kind are bad as a whole: menus, headers, footers, sidebars,
notices, adverts, forms and comment sections, known by tag, role, class or id.

The second pass gives each ambiguous block the label of its nearest decided neighbour, the one before
it on a tie; neighbours are blocks on the same side of the article's border. Where none is decided,
blocks are good inside the article and in pages that mark none, and bad outside of a marked one.

Defined edge cases: a null or blank page has an empty text; unclosed and crossing tags are tolerated
(an excluded element that is never closed ends at the next block, a tag that is never closed ends with
the page); pages of any length are read whole, in time linear in their length; repeated rows give equal rows;
a null url is passed on; an empty table gives no rows. Only `page_id`, `url` and `html` are read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gleaner.llm.common import map_texts

# Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDED = frozenset("head nav footer header aside form button menu dialog select label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar alertdialog".split())
OWN_END = frozenset("p li dt dd tr td th option".split())  # elements that the next of their kind closes
BOXES = frozenset("div section ul ol dl table span".split())

#: Every alternative reads on to the end of what it began, so no character is read twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|svg|noembed|noframes)(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)?+)*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?<![\w:-])([\w:-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?+", re.S)
#: Words in a class or id that mark what is no text of the article, on any element.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|adbox|sponsor\w*|promoted|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|widgets?|toolbar|topbar|"
    r"cookies?\w*|consent|gdpr|popup|modal|newsletter|subscribe|subscription|comments?|commentlist|comment-?\w*|respond|replies|disqus\w*|"
    r"sharing|share-?\w*|social-?\w*|pagination|pager)(?=$|[\s_-])", re.I)
#: Words that mark it on boxes outside of an article; inside, or on a paragraph, they also stand on its own text.
BOX_NOISE = re.compile(
    r"(?:^|[\s_-])(?:banner|promo\w*|aside|footer\w*|header|masthead|notice|notification|alert|overlay|signup|login|discussion|social\w*|related\w*|recommended|recommendations|read-?more|skip|copyright|legal|disclaimer|"
    r"tags?|tag-?cloud|byline|meta|search\w*|form|nav\w*)(?=$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main|body|text)(?=$|[\s_-]|body|content|text)", re.I)
UNSEEN = re.compile(r"display\s*+:\s*+none", re.I)
LINE = re.compile(r"\s+")

STOP_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may then do first any my now such like our over me even most after also did many before must through back where your way "
    "de la le les et des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec son ont aux sa ou comme mais on nous elle leur été ses cette deux être ces même tout aussi bien peut fait sans "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "el y los del las por con una su para es al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay").split())

GOOD, BAD, UNCLEAR = "good", "bad", "unclear"


@dataclass
class Block:
    text: str
    links: int = 0  # characters inside links
    excluded: bool = False
    content: bool = False  # inside an element that holds the article
    tag: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}


def _is_noise(name: str, attrs: dict[str, str], inside: bool, article: bool) -> bool:
    """Whether an element is no text of the page by its kind; `inside`: it stands in the article, `article`: it is the article."""
    if name in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or UNSEEN.search(attrs.get("style", "")):
        return True
    mark = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if name == "header" and inside:  # an article's own headline
        return NOISE.search(mark) is not None
    if name in EXCLUDED or attrs.get("role", "").lower() in ROLES:
        return True
    return not article and (NOISE.search(mark) is not None or name in BOXES and not inside and BOX_NOISE.search(mark) is not None)


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    text: list[str] = []
    links = 0
    anchor = False
    content: list[str] = []  # open elements that hold the article
    skip: list[str] = []  # open elements from an excluded one on, of its kind
    once = False  # an excluded element that is never closed: up to the next block
    tag = ""

    def close():
        nonlocal links, text, once
        if text:
            joined = LINE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, links, bool(skip) or once, bool(content), tag))
        text, links, once = [], 0, False

    at, ends = 0, None
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if anchor:
                links += len(piece.strip())
        at = m.end()
        if m["raw"]:
            text.append(" ")
            continue
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                anchor = False
            if name in BLOCKS:
                close()
                tag = ""
            if skip and name == skip[-1]:
                close()
                skip.pop()
            elif content and name == content[-1] and (not skip or name in ("article", "main")):  # elements inside an excluded one are not counted
                content.pop()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            anchor = not m["attrs"].rstrip().endswith("/")
        if name in BLOCKS:
            close()
            anchor, tag = False, name
            if len(skip) == 1 and skip[0] in OWN_END or skip and name == "body":
                skip.clear()  # <p class="ad"> and the like end where the next block begins
        if name in VOID:
            continue
        if skip:
            if name == skip[-1]:
                skip.append(name)
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        article = name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop") == "articleBody"
        if article and "comment" in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower():
            article = False
        if _is_noise(name, attrs, bool(content), article):
            close()
            if name not in OWN_END and ends is None:
                ends = {n.lower() for n in re.findall(r"</([a-zA-Z][^\s/>]*)", page)}
            if name in OWN_END or name in ends:
                skip.append(name)
            else:
                once = True
        elif article or (name in ("div", "section") and CONTENT.search(f"{attrs.get('class', '')} {attrs.get('id', '')}")):
            content.append(name)
        elif content and name == content[-1]:
            content.append(name)
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block, worded: bool = True, low: float = 0.15, high: float = 0.25, short: int = 70, long: int = 200, max_links: float = 0.4) -> str:
    """good, bad or unclear for one block by itself; `worded`: the page is in a language whose function words are known."""
    links = min(1.0, b.links / max(1, len(b.text)))
    if b.excluded:
        return BAD
    if b.content:
        low, high, short = low / 2, high / 2, short // 2
    if links > max_links:  # a paragraph of the article may be one link; a list of links is none of its text
        return UNCLEAR if b.content and b.tag == "p" else BAD
    if len(b.text) < short or b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return UNCLEAR
    words = stop_density(b.text) if worded else high
    if words >= high or words >= low and len(b.text) >= long:
        return GOOD
    if words >= low or b.content:
        return UNCLEAR
    return BAD if links or len(b.text) >= long else UNCLEAR


def second_pass(labels: list[str], default: str = GOOD) -> list[str]:
    """Unclear blocks inherit from the nearest decided one on either side; `default` if there is none."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            if labels[k] != UNCLEAR:
                last = k
            side[k] = last
    out = list(labels)
    for k, label in enumerate(labels):
        if label == UNCLEAR:
            i, j = before[k], after[k]
            near = i if j is None or (i is not None and k - i <= j - k) else j
            out[k] = default if near is None else labels[near]
    return out


def classify(found: list[Block]) -> list[str]:
    """The label of each block after both passes."""
    worded = any(len(b.text) >= 70 and stop_density(b.text) >= 0.15 for b in found if not b.excluded)
    first = [first_pass(b, worded) for b in found]
    marked = any(b.content and not b.excluded for b in found)
    out = [BAD] * len(found)
    for inside in (True, False):
        side = [k for k, b in enumerate(found) if not b.excluded and b.content == inside]
        for k, label in zip(side, second_pass([first[k] for k in side], GOOD if inside or not marked else BAD)):
            out[k] = label
    return out


def extract(page: str | None) -> str:
    """The main text of one page, blocks joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, x in zip(found, classify(found)) if x == GOOD)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`."""
    def rows(htmls):
        texts = [extract(h) for h in htmls]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, ["page_id", "url"], "html", "page_id long, url string, text string, n_chars long", rows)


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages)
