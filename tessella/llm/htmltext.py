"""Operator 9: the main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What stands in menus, headers, footers, sidebars, notices, adverts,
forms or reader comments is set aside, as is all outside of the page's articles, if these hold half of its long text; none
of it is text or has a say. Class, id and role names count by whole words of theirs (`comments`, `site-footer`, not
`comments-open`), and never on an article. A name or a form around most of the page, with next to nothing long and no
article outside, says nothing about what it holds: density decides there. Pass one labels the other blocks: mostly links are boilerplate (long ones of an article are text), long
blocks rich in stop words are text (all long blocks, if the page as a whole has few words of the listed languages);
other long blocks are boilerplate, or ambiguous in an article; short blocks stay ambiguous. Pass two gives each
ambiguous block the label of its nearest decided neighbour. If that is no text in an article, or two at equal
distance differ outside of one, a heading, a sentence end or stop words make it text; two that differ in an article
make it text, as does the want of any decided neighbour. Both passes, and the cutting, take time in proportion to the page.

Character references are decoded, white space in a block becomes one blank, blocks are joined by an empty
line in page order. Null and empty pages, and pages without text, give an empty text; markup that is cut off
at the end of a page is no text. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table

# Words of the four most frequent languages of the corpus that carry no subject.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has he in is it its of on or that the this to was were will with
    au aux avec ce ces dans de des du elle en est et il la le les leur ne pas par pour que qui se sur un une
    als auch auf aus bei das dem den der die ein eine er es für ich im ist mit nicht sich sie sind und von war wie zu
    al como con del el ella esta está las lo los más no para pero por su sus una uno y
    """.split()
)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "select", "button"}
#: These end with the page if they have no end tag; the others of RAW are then no more than a tag.
RAW_TEXT = {"script", "style", "title", "textarea", "noscript", "iframe"}
END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: Elements that may be hidden and have no mark otherwise, each with what an end tag of its name does not reach beyond.
HIDEABLE = {"p": frozenset(), "blockquote": frozenset(), "li": frozenset({"ul", "ol"}), "td": frozenset({"table"})}
#: Start tags that end an open element of these names.
SIBLINGS = {"li": ("li",), "td": ("td",), "th": ("td",), "tr": ("td",), "tbody": ("td",), "tfoot": ("td",)}
ASIDE = {"nav", "footer", "aside", "menu", "dialog"}
MAIN = {"article", "main"}
CONTAINER = ASIDE | MAIN | {"form", "header", "div", "section", "ul", "ol", "dl", "table", "body", "head", "fieldset", "figure", "details"}
BLOCK = CONTAINER | {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "blockquote", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "address", "summary", "center", "html", "option", "legend"}
#: Words of names for what is no main text, and words that may stand beside them in a name.
MARKS = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay
    comment comments disqus respond replies menu menus nav navbar navigation topbar breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations
    share sharing social newsletter subscribe signup login search pagination pager footer masthead siteheader pageheader copyright complementary contentinfo
    """.split()
)
BESIDE = frozenset("area articles bar block bottom box button buttons container form global group icons inner item items left link links list main media page panel post posts primary reader readers right secondary section side site slot top unit user wrap wrapper".split())
HEADERS = frozenset({"site-header", "page-header", "site_header", "page_header", "side-bar", "side_bar"})
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
LONG, FEW_LINKS, STOPS = 70, 0.5, 0.2
TEXT, BOILERPLATE, SHORT, ASIDE_LABEL = 1, 0, -1, -2
FAR = 1 << 62


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    aside: bool
    main: bool
    heading: bool
    #: the share of stop words, once it is asked for
    stops: float = -1.0

    def stop_share(self) -> float:
        if self.stops < 0:
            words = [w.strip(".,;:!?()[]\"'#$%&*").lower() for w in self.text.split()]
            self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        return self.stops

    def mostly_links(self) -> bool:
        return self.linked > FEW_LINKS * len(self.text)


def marked(names: str) -> bool:
    """Whether one of the names, as a whole, is one for what is no main text."""
    for name in names.lower().split():
        words = re.split("[-_]+", name)
        if name in HEADERS or any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


def blocks(html: str) -> tuple[list[Block], bool]:
    """The blocks of a page in order, and whether articles hold its main text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: name, whether set aside, number among the named ones
    places: dict[str, list[int]] = defaultdict(list)  # of each name in the stack
    named: list[list[int]] = []  # first and past-last block of each container that its name or a form sets aside
    parts: list[str] = []
    linked, in_link, heading, asides, mains = 0, False, False, 0, 0
    endless: set[str] = set()  # raw elements that have no end tag from here on

    def close() -> None:
        nonlocal linked, in_link
        if parts:
            text = "".join(parts)
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                out.append(Block(text, linked, asides > 0, mains > 0, heading))
        linked, in_link = 0, False

    def push(name: str, aside: bool, number: int = -1) -> None:
        nonlocal asides, mains
        places[name].append(len(stack))
        asides += aside
        mains += name in MAIN
        stack.append((name, aside, number))

    def shorten(size: int) -> None:
        nonlocal asides, mains
        while len(stack) > size:
            name, aside, number = stack.pop()
            places[name].pop()
            asides -= aside
            mains -= name in MAIN
            if number >= 0:
                named[number][1] = len(out)

    def leave(name: str, within: frozenset = frozenset()) -> None:
        here = places[name][-1] if places[name] else -1
        if here > max((places[w][-1] for w in within if places[w]), default=-1):
            shorten(here)

    at = 0
    while token := TOKEN.search(html, at):
        start, end = token.span()
        if start > at:
            piece = html[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = end
        name = token[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(token[1]), token[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                # what looks like tags or comments in there is none: only its own end tag counts
                last = None if name in endless else END[name].search(html, end)
                if not last:
                    endless.add(name)
                at = last.end() if last else len(html) if name in RAW_TEXT else end
            parts.append(" ")
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            close()
            if stack and stack[-1][0] == "p":
                shorten(len(stack) - 1)  # any block ends a hidden p
            for sibling in () if closing else SIBLINGS.get(name, ()):
                leave(sibling, HIDEABLE[sibling])
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name in CONTAINER:
                if closing:
                    leave(name)
                elif name == "body":
                    shorten(0)
                    push(name, False)
                else:
                    hidden = bool(attributes) and bool(HIDDEN.search(attributes))
                    aside = hidden or name in ASIDE or name == "header" and not mains or name == "head"
                    number = -1
                    if not aside and name not in MAIN and (name == "form" or attributes and marked(" ".join(x or y or z for x, y, z in NAMES.findall(attributes)))):
                        number = len(named)
                        named.append([len(out), -1])
                    push(name, aside, number)
            elif name in HIDEABLE:
                hidden = bool(HIDDEN.search(attributes))
                if closing:
                    leave(name, HIDEABLE[name])
                elif hidden or name == "blockquote" and places[name]:
                    push(name, hidden)  # hidden text is set aside up to its end
        # other tags are inline and part no words
    if at < len(html):
        parts.append(html[at:])
    close()
    shorten(0)
    return out, _set_aside(out, named)


def _set_aside(out: list[Block], named: list[list[int]]) -> bool:
    """Set aside what the named containers hold, but for those around most of the page; whether articles hold its main text."""
    within = [0] * (len(out) + 1)
    for first, last in named:
        within[first] += 1
        within[last] -= 1
    within = list(accumulate(within))
    size = [0 if b.aside else len(b.text) for b in out]
    long = [n if n >= LONG and not b.mostly_links() else 0 for n, b in zip(size, out, strict=True)]
    total, outside = sum(size), [i for i, n in enumerate(long) if n and not within[i]]
    rest, article = sum(long[i] for i in outside), any(b.main and n and not inside for b, n, inside in zip(out, size, within, strict=False))
    for first, last in named:  # outer ones first
        held = sum(size[first:last]) if not article else 0
        if 2 * held > total and 4 * rest < held:
            for i in range(first, last):
                within[i] -= 1
                if not within[i]:
                    rest += long[i]
                    article = article or out[i].main and size[i] > 0
    for b, n in zip(out, within, strict=False):
        b.aside = b.aside or n > 0
    long = [n for n, b in zip(long, out, strict=True) if not b.aside]
    in_main = [n for n, b in zip(long, (b for b in out if not b.aside), strict=True) if b.main]
    has_main = any(b.main and not b.aside for b in out) and 2 * sum(in_main) >= sum(long)
    for b in out:
        b.main = b.main and has_main
    return has_main


def first_labels(found: list[Block], has_main: bool) -> list[int]:
    """Pass one; SHORT are the ambiguous blocks."""
    known = 2.0  # whether the page as a whole has stop words: else, as in another language, length and links decide
    out = []
    for b in found:
        if b.aside or has_main and not b.main:
            out.append(ASIDE_LABEL)
        elif b.mostly_links() and not (b.main and b.heading):
            out.append(BOILERPLATE if not b.main or len(b.text) < LONG else TEXT)
        elif len(b.text) < LONG:
            out.append(SHORT)
        elif b.stop_share() >= STOPS / 2:
            out.append(TEXT)
        else:
            if known > 1:
                words = [(len(x.text.split()), x.stop_share()) for x in found if not x.aside and not x.mostly_links()]
                known = sum(n * share for n, share in words) / max(1, sum(n for n, _ in words))
            out.append(TEXT if known < STOPS / 2 else SHORT if b.main else BOILERPLATE)
    return out


def _nearest(labels: list[int]) -> list[tuple[int, int]]:
    """For each place the distance to the last decided label before it, and that label; none is far away."""
    out, at, label = [], -1, TEXT
    for i, x in enumerate(labels):
        out.append((i - at if at >= 0 else FAR, label))
        if x in (TEXT, BOILERPLATE):
            at, label = i, x
    return out


def labels(found: list[Block], has_main: bool) -> list[int]:
    """Both passes."""
    first = first_labels(found, has_main)
    out = []
    for b, label, before, after in zip(found, first, _nearest(first), reversed(_nearest(first[::-1])), strict=True):
        if label == SHORT:
            near = {x for d, x in (before, after) if d == min(before[0], after[0])}
            label = near.pop() if len(near) == 1 else SHORT
            if label == SHORT and b.main:
                label = TEXT
            elif label == SHORT or label == BOILERPLATE and b.main:
                label = TEXT if b.heading or b.text[-1] in ".!?" or b.stop_share() >= STOPS else BOILERPLATE
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    found, has_main = blocks(html or "")
    return "\n\n".join(b.text for b, label in zip(found, labels(found, has_main), strict=True) if label == TEXT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id_col, url_col, text, n_chars) of all pages; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
