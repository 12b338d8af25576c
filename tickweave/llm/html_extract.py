"""Main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import text_of
from tickweave.llm.stopwords import STOP_WORDS

#: Elements by what they do to blocks.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset datalist".split())
MAIN = frozenset("article main".split())
#: Boilerplate elements that some sites wrap around whole pages.
WRAPPERS = frozenset("form fieldset".split())
#: Words of class, id and role names that mark boilerplate, or the place of the main text.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disclaimer discussion disqus "
    "dropdown feedback footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets alert alerts complementary aside rail teaser".split()
)
GOOD_NAMES = frozenset("articlebody content entry main post story maincontent".split())
#: Words that tell what is around or beside an element ("has-sidebar"); its boilerplate names don't count then.
LAYOUT = frozenset("has with no without page layout wrapper".split())
#: Names that count on an article element: sites mark readers' comments as articles.
COMMENTS = frozenset("comment comments discussion reply replies respond teaser".split())

#: Blocks: link density over which one is boilerplate; characters below which one is short; stop-word shares of prose and of likely prose; characters of long prose.
LINKS, SHORT, PROSE, LIKELY, LONG = 0.3, 70, 0.30, 0.12, 200
_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|=)*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Closing one of these also happens where another of the listed elements opens.
_IMPLIED = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    hard: bool
    main: bool
    good_name: bool
    heading: bool
    share: float = 0.0  # of stop words in its words, of blocks that aren't short


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    names: set[str] = set()
    hidden = False
    for key, a, b, c, flag in _ATTRIBUTE.findall(attributes):
        key, value = (key or flag).lower(), a or b or c
        if key in ("class", "id", "role"):
            for one in html.unescape(value).split():
                words = [w.lower() for w in _NAME.findall(one)]
                mine = {*words, *map("".join, zip(words, words[1:], strict=False))}
                names |= mine if LAYOUT.isdisjoint(words) else mine - BAD_NAMES
        elif key == "itemprop" and value.lower() == "articlebody":
            names.add("articlebody")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return names, hidden


def blocks_of(page: str) -> list[Block]:
    """All blocks of text of a page, in order. Unclosed, stray and unknown tags are taken as browsers take them, roughly."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # element, and whether it is boilerplate, such by its element or hidden, main text, or named as main text
    text: list[str] = []
    linked, in_link, heading = 0, 0, False
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()  # elements that have no closing tag from here on

    def closing_tag(tag: str, at: int) -> re.Match | None:
        if tag in unclosed:
            return None
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        if end is None:
            unclosed.add(tag)
        return end

    def flush() -> None:
        nonlocal linked, heading
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                _, bad, hard, main, good = stack[-1] if stack else ("", False, False, False, False)
                blocks.append(Block(whole, linked, bad, hard, main, good, heading, _density(whole) if len(whole) >= SHORT else 0.0))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if in_link:
                linked += len(" ".join(s.split()))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = closing_tag(tag, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            if not closing and tag not in VOID:
                if m[3] and _names(m[3])[1]:  # hidden words inside a line
                    end = closing_tag(tag, at)
                    if end and page.find("<", at) == end.start():
                        at = end.end()
            continue
        flush()
        if closing:
            while open_tags[tag]:
                last = stack.pop()[0]
                open_tags[last] -= 1
                if last == tag:
                    break
            in_link, heading = 0, False
            continue
        if tag in VOID:
            continue
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if stack and (stack[-1][0] == "p" or tag in (_IMPLIED.get(stack[-1][0]) or ())):
            open_tags[stack.pop()[0]] -= 1
        _, bad, hard, main, good = stack[-1] if stack else ("", False, False, False, False)
        names, hidden = _names(m[3]) if m[3] else (set(), False)
        if tag not in ("html", "body"):
            own = names & COMMENTS if tag == "article" else set() if tag == "main" else names
            bad = bad or hidden or tag in BOILERPLATE or bool(own & BAD_NAMES) or (not main and (tag == "header" or bool(names & {"header", "head"})))
            hard = hard or hidden or tag in BOILERPLATE - WRAPPERS
            main = main or tag in MAIN or "articlebody" in names
            good = good or main or bool(names & GOOD_NAMES) and not bad
        stack.append((tag, bad, hard, main, good))
        open_tags[tag] += 1
    flush()
    return blocks


def _density(text: str) -> float:
    words = [w.strip(".,;:!?()[]{}\"'«»“”„…$%&#*|-").lower() for w in text.split()]
    return sum(w in _STOPS for w in words) / len(words)


def _decide(b: Block) -> bool | None:
    """A block's label by its length, link density and stop-word density; None: ambiguous."""
    if b.linked > LINKS * len(b.text):
        return False
    if len(b.text) < SHORT:
        return None
    if b.share >= PROSE or b.share >= LIKELY and len(b.text) >= LONG:
        return True
    return None if b.share >= LIKELY else False


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text.

    Names and marks are evidence that prose can overrule. They hold where the text that they keep has as much prose as the
    blocks have that no boilerplate name covers, and, if that is less than LONG characters, as those that one covers. Else they are taken back
    one by one until that is so: first names around an article or main element, then names that mark the main text, then
    elements that mark it, then names around prose. What hidden or other boilerplate elements than forms hold never comes in.
    On a page without any prose by stop words, long blocks without many links count as such.
    """
    out = _two_passes(blocks)
    free = [b for b in blocks if not b.hard and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    some = any(_decide(b) for b in free)
    prose = [len(b.text) if not b.hard and (_decide(b) if some else len(b.text) >= LONG and b.linked <= LINKS * len(b.text)) else 0 for b in blocks]

    def holds(out: list[bool]) -> bool:
        kept = sum(n for n, x in zip(prose, out, strict=True) if x)
        free, named = (sum(n for n, x, b in zip(prose, out, blocks, strict=True) if not x and b.bad == bad) for bad in (False, True))
        return kept >= free and (kept >= LONG or kept >= named)

    if holds(out):
        return out
    nested = [replace(b, bad=b.hard or b.bad and not b.main) for b in blocks]
    unnamed = [replace(b, good_name=False) for b in blocks]
    unmarked = [replace(b, main=False) for b in unnamed]
    bare = [replace(b, bad=b.hard or b.bad and not n) for b, n in zip(unmarked, prose, strict=True)]
    for fewer in (nested, unnamed, unmarked):
        out = _two_passes(fewer)
        if holds(out):
            return out
    return _two_passes(bare)


def _two_passes(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text, by their densities and by those around them.

    First pass: length, link density and stop-word density decide; short blocks and those of middling density stay ambiguous. A page's marks shift
    this: blocks of boilerplate elements, and blocks outside of what the page marks as main text, are out; inside of it, headings
    may be links, and a block of few stop words (a table, names, an unknown language) is ambiguous instead of out.
    Second pass: an ambiguous block takes the label of the nearest decided block; between two different ones as near, a heading goes
    with what follows it, any other block with main text. Under a mark only blocks under it count, and if none of them is
    decided to be main text, its ambiguous blocks are in.
    """
    marked = any(b.main and not b.bad for b in blocks)
    named = not marked and any(b.good_name and not b.bad for b in blocks)
    label: list[bool | None] = []
    voters: list[int] = []
    for i, b in enumerate(blocks):
        inside = b.main or named and b.good_name
        found = _decide(b)
        if b.bad or (marked or named) and not inside:
            found = False
        elif inside and (b.linked <= LINKS * len(b.text) or b.heading):
            found = found or None
        label.append(found)
        if found is not None and not b.bad and (inside or not (marked or named)):
            voters.append(i)
    if (marked or named) and not any(label[i] for i in voters):
        voters = []
    out: list[bool] = []
    for i, x in enumerate(label):
        if x is not None:
            out.append(x)
            continue
        k = bisect_left(voters, i)
        before, after = voters[k - 1] if k > 0 else None, voters[k] if k < len(voters) else None
        if before is None and after is None:
            out.append(marked or named)
        elif before is None or after is None:
            out.append(bool(label[after if before is None else before]))
        elif i - before == after - i:
            out.append(bool(label[after]) if blocks[i].heading else bool(label[before] or label[after]))
        else:
            out.append(bool(label[before if i - before < after - i else after]))
    return out


def main_text(page: str) -> str:
    found = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each whole page.

    Nulls: null html counts as empty, and an empty page has an empty text; ids and urls go through as they are. Repeated rows
    give repeated results. Other columns are ignored. An empty table gives no rows. Nothing is cut or capped; the time is in
    proportion to a page's length. Blocks are joined by an empty line.

    Returns page_id, url, text, n_chars (code points).
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
