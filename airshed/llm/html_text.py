"""Main text of HTML pages by two passes of block rules.

Markup is cut into blocks at block-level tags; scripts, styles, forms and the like are left
out whole, as are parts that name themselves boilerplate (navigation, page header and
footer, sidebars, notices, adverts, comments).  The first pass decides each other block:
blocks of links are out, long blocks dense in stop words are in, and short and middling ones
stay open.  The second pass gives open blocks the label of the nearest decided neighbours,
first the middling ones, then the short ones.  Where the page marks its article, only blocks
inside it are candidates and the limits are wider; open blocks without a decided neighbour
are in there, and on other pages if they have a heading.

A name or a form marks an element only if the element has a minor share of the page's text
and doesn't hold its main part or first article.  Where no block is dense in the stop words
(another language), the middling ones are in.

Cases: null and empty html give an empty text, as does a page without text.  Unclosed and
stray tags are tolerated, and a page takes time linear in its length whatever its markup.
Text that repeats stays.  Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import read, slices, with_columns

#: Frequent function words of the languages served, and tag names of HTML.
STOP_WORDS = frozenset(
    """
    the of and to in is that it for was on are as with be by this from at or an not have has he she they we you his her their its which but had were will would can all been one there if when who what so no more
    de la le les des et en un une du que qui dans pour pas sur au avec est plus par ce il elle ne se son sa ses aux ou mais nous vous leur comme cette
    der die das und ist von zu den mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    el los las y que se del por con una su para es al lo como más o pero sus le ha sin sobre este ya entre cuando muy
    """.split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
LEFT_OUT = frozenset("head script style noscript template title form button select option optgroup textarea input svg math iframe object embed canvas audio video map datalist dialog menu nav aside".split())
PAGE_ENDS = frozenset("header footer".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end an open one of the same group.
ENDS_OPEN = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HINT = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertis\w*|banners?|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disclaimer|disqus|gdpr|login|menus?|modal|navbar|navigation|nav|newsletter|notices?|notification|outbrain|pager|pagination|paywall|popup|promo\w*|related|replies|respond|share|sharing|sidebars?|signup|social|sponsor\w*|subscribe|taboola|toolbar|widgets?)(?![a-z])"
)
#: Names that tell of a part elsewhere, or of what wraps it.
OTHER_PART = re.compile(r"(?:has|with|no|without)[-_].*|.*[-_](?:wrap|wrapper|open|closed)")
END_HINT = re.compile(r"(?<![a-z])(?:footer|header|masthead|topbar)(?![a-z])")

MINOR, FIRST = 0.5, 0.3  # shares of the page's text: of a named part at most, of one that holds the first article at least
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINKS_HIGH, LINKS_ARTICLE = 0.2, 0.6

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|!--|[!?])")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_LONG_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]{9,}+)|([0-9]{9,}+))")
_LETTERS = re.compile(r"[^\W\d_]+")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


class Block:
    __slots__ = ("text", "linked", "article", "boilerplate", "heading")

    def __init__(self, text: str, linked: int, article: int, boilerplate: bool, heading: bool):
        self.text, self.linked, self.article, self.boilerplate, self.heading = text, linked, article, boilerplate, heading


def _short(number: re.Match) -> str:
    """A reference's number without leading zeros; one beyond all characters as the first of those."""
    digits = (number[1] or number[2]).lstrip("0") or "0"
    if len(digits) > 8:
        digits = "110000" if number[1] else "1114112"
    return ("&#x" if number[1] else "&#") + digits


def decoded(text: str) -> str:
    return entities.unescape(_LONG_NUMBER.sub(_short, text))


def tags(page: str):
    """(start, end, whether it closes, name, attributes) of each tag in order, in time linear in the page.

    Comments and declarations have an empty name; a raw element (script, style, ...) is one tag up to the end of its
    closing one.  Quoted values may hold ``>``.  From the first tag whose quotes don't close on the page, tags end at
    the next ``>``.  What opens after the last ``>`` is text, unless it is a comment."""
    last, quoted, at = page.rfind(">"), True, 0
    while tag := _OPEN.search(page, at):
        start, at = tag.span()
        name = (tag[2] or "").lower()
        if tag[0] == "<!--":
            close = page.find("-->", at)
            at = close + 3 if close >= 0 else len(page)
            yield start, at, False, "", ""
        elif start < last:
            inside = _INSIDE.match(page, at) if quoted and name else None
            quoted &= inside is not None or not name
            end = inside.end() if inside else page.find(">", at) + 1
            attributes, at = page[at : end - 1], end
            if name in RAW and not tag[1]:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else len(page)
                if close and (over := page.find(">", at)) >= 0:
                    at = over + 1
            yield start, at, bool(tag[1]), name, attributes


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its kind, role or style."""
    if name in PAGE_ENDS:
        return not in_article or name == "footer"
    if not attributes or name in ("html", "body", "main"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:\s|^)hidden(?:\s|=|$)", attributes, re.I) and name not in ("input",):
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def _named(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element names itself boilerplate, or is a form."""
    if name == "form":
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    named = " ".join(x for x in (re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower() for x in tokens) if not OTHER_PART.fullmatch(x))
    return bool(HINT.search(named)) or (not in_article and bool(END_HINT.search(named)))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; boilerplate ones are marked, left-out elements give none."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    link = False
    breaks = 0
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, left out, boilerplate, number of the article it opened (or 0), named
    opened: Counter[str] = Counter()  # open elements by name
    named: list[int] = []  # the open named elements
    within: list[int] = []  # of each block, the innermost named element around it (or -1)
    around: list[int] = []  # of each named element, the one around it (or -1)
    holds: list[str] = []  # of each named element, the main part or first article in it
    skipped = marked = 0
    article: list[int] = []
    articles = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, linked, article[-1] if article else 0, marked > 0, bool(stack) and stack[-1][0] in HEADINGS))
            within.append(named[-1] if named else -1)
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal skipped, marked
        name, left, plate, number, part = stack.pop()
        opened[name] -= 1
        skipped -= left
        marked -= plate
        if number:
            article.pop()
        if part:
            named.pop()

    at = 0
    for start, end, closing, name, attributes in chain(tags(page), [(len(page), len(page), False, "", "")]):
        if start > at and not skipped:
            piece = decoded(page[at:start])
            text.append(piece)
            if link:
                linked += len("".join(piece.split()))
            if not piece.isspace():
                breaks = 0
        at = end
        if not name:
            continue
        if name == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2 and not skipped:
                flush()
            continue
        block = name in BLOCKS
        if block and not skipped:
            flush()
            breaks = 0
        if name == "a" and not skipped:
            link = not closing and "href" in attributes.lower()
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
                if name not in ("p", "li"):
                    link = False
            continue
        if name in RAW or name in VOID or attributes.rstrip().endswith("/"):
            continue
        ends = ENDS_OPEN.get(name, {"p"} if block else ())
        while stack and stack[-1][0] in ends:
            pop()
        if not (block or name in LEFT_OUT):
            continue
        left = name in LEFT_OUT and name not in ("nav", "aside", "menu", "dialog", "form")
        plate = not left and (name in LEFT_OUT and name != "form" or _boilerplate(name, attributes, bool(article)))
        part = not left and not plate and _named(name, attributes, bool(article))
        number = 0
        if name in ARTICLE and not plate and not marked:
            if named and name == "main":
                holds[named[-1]] = "main"
            elif named and not articles:
                holds[named[-1]] = holds[named[-1]] or name
            articles += 1
            number = article[0] if article else articles
            article.append(number)
        stack.append((name, left, plate, number, part))
        opened[name] += 1
        if part:
            around.append(named[-1] if named else -1)
            named.append(len(holds))
            holds.append("")
        skipped += left
        marked += plate
    flush()
    size = [0] * len(holds)
    for block, k in zip(out, within, strict=True):
        if k >= 0:
            size[k] += len(block.text)
    for k in range(len(holds) - 1, -1, -1):  # what an element holds, those around it hold too
        if (outer := around[k]) >= 0:
            size[outer] += size[k]
            holds[outer] = "main" if "main" in (holds[k], holds[outer]) else holds[outer] or holds[k]
    whole = sum(len(b.text) for b in out)
    minor: list[bool] = []
    for k, outer in enumerate(around):
        own = size[k] <= MINOR * whole and holds[k] != "main" and not (holds[k] and size[k] >= FIRST * whole)
        minor.append(own or (outer >= 0 and minor[outer]))
    for block, k in zip(out, within, strict=True):
        block.boilerplate |= k >= 0 and minor[k]
    return out


def first_pass(block: Block, marked_article: bool) -> str:
    if block.boilerplate or (marked_article and not block.article):
        return BAD
    size = len(block.text)
    links = block.linked / max(1, len(block.text.replace(" ", "")))
    if links > (LINKS_ARTICLE if marked_article else LINKS_HIGH):
        return BAD
    if size < LENGTH_LOW:
        return SHORT
    found = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if marked_article:
        return GOOD if stops >= STOP_LOW else NEAR
    return GOOD if stops >= STOP_HIGH and size >= LENGTH_HIGH else NEAR


def _neighbours(labels: list[str]) -> tuple[list[int], list[int]]:
    """Of each block, the decided ones (good or bad) last before it and first after it, -1 if none."""
    before, after, last = [-1] * len(labels), [-1] * len(labels), -1
    for k, label in enumerate(labels):
        before[k] = last
        last = k if label in (GOOD, BAD) else last
    last = -1
    for k in range(len(labels) - 1, -1, -1):
        after[k] = last
        last = k if labels[k] in (GOOD, BAD) else last
    return before, after


def second_pass(labels: list[str], default: str, headings: list[bool] | None = None) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbours.  Near ones are settled first: in beside a good
    one on either side.  Short ones then follow; between unlike neighbours the nearer counts (for a heading what
    follows it), and at equal distance they are out.  Without any decided block they take ``default``."""
    before, after = _neighbours(labels)
    settled = list(labels)
    for k, label in enumerate(labels):
        beside = {labels[j] for j in (before[k], after[k]) if j >= 0}
        if label == NEAR:
            settled[k] = default if not beside else GOOD if GOOD in beside else BAD
    before, after = _neighbours(settled)
    out = []
    for k, label in enumerate(settled):
        a, b = before[k], after[k]
        if label in (GOOD, BAD):
            nearest = label
        elif a < 0 or b < 0:
            nearest = default if a == b else settled[max(a, b)]
        elif headings and headings[k]:
            nearest = settled[b]
        else:
            nearest = BAD if k - a == b - k and settled[a] != settled[b] else settled[a if k - a <= b - k else b]
        out.append(nearest == GOOD)
    return out


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in page order, joined by one newline."""
    found = [b for b in blocks(page or "") if not b.boilerplate]
    marked = any(b.article for b in found)
    if marked:
        found = [b for b in found if b.article]
    labels = [first_pass(b, marked) for b in found]
    if not marked and NEAR in labels and GOOD not in labels:  # a page of middling blocks only
        labels = [GOOD if x == NEAR else x for x in labels]
    headings = [b.heading for b in found]
    keep = second_pass(labels, GOOD if marked or any(headings) else BAD, headings)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    with_columns(pages, "page_id", "url", "html")

    def run(batches):
        for batch in slices(batches, "html"):
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
