"""Article HTML as sections, paragraphs and links: one nested row per article, one pass over its markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import pieces

# What is no prose in the supported projects.
SKIP_TAGS = {"head", "title", "script", "style", "nav", "noscript", "figure", "iframe", "svg", "audio", "video", "h1", "footer"}
SKIP_CLASSES = {
    "reference", "references", "mw-editsection", "thumb", "thumbinner", "thumbcaption", "hatnote", "noprint", "navbox", "toc", "metadata", "infobox", "sidebar", "mw-empty-elt", "gallery", "mw-references-wrap", "mw-indicators", "mw-jump-link", "printfooter",
    "catlinks", "rellink", "noexcerpt", "mwe-math-element", "mwe-math-fallback-image-inline", "mw-kartographer-container", "mw-halign-right", "mw-halign-left", "BKL", "Begriffsklaerung", "ad",
}
SKIP_CLASS_BEGINS = ("vector-toc", "mw-indicator", "mw-jump", "navbox-", "infobox_", "Vorlage_Begriffskl")
SKIP_IDS = {"toc", "mw-navigation", "footer", "siteNotice", "mw-panel", "mw-head", "p-lang"}
NAMESPACES = (
    "Datei:", "File:", "Kategorie:", "Category:", "Spezial:", "Special:", "Hilfe:", "Help:", "Wikipedia:", "Portal:", "Vorlage:", "Template:", "Diskussion:", "Benutzer:", "Klexikon:", "Wikibooks:", "Wikiversity:", "Media:", "Bild:",
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LEVELS = {"h2": 2, "h3": 3, "h4": 4, "h5": 4, "h6": 4}
BLOCKS = {"p", "blockquote", "dd", "dt", "div", "pre", "section", "article", "ul", "ol", "table"}
DISAMBIGUATION = re.compile(r"id=[\"']?disambig|Begriffskl(?:ä|ae)rung", re.I)

SCHEMA = "title string, is_disambiguation boolean, sections array<struct<position: int, heading: string, path: array<string>, level: int, paragraphs: array<struct<kind: string, text: string>>, links: array<string>>>"
_SECTION = pa.struct([("position", pa.int32()), ("heading", pa.string()), ("path", pa.list_(pa.string())), ("level", pa.int32()), ("paragraphs", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))), ("links", pa.list_(pa.string()))])


class _Reader(HTMLParser):
    """Collects sections; a skipped element hides all that stands in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.in_title = "", False
        self.skipped: list[str] = []
        self.path: list[tuple[int, str]] = []
        self.sections: list[dict] = []
        self.buffer: list[str] = []
        self.heading: int | None = None
        self.items: list[str] | None = None
        self.depth = 0
        self.rows: list[list[str]] | None = None
        self._open("", 0)

    def _open(self, heading: str, level: int) -> None:
        self.path = [p for p in self.path if p[0] < level] + ([(level, heading)] if level else [])
        self.sections.append({"position": len(self.sections), "heading": heading, "path": [h for _, h in self.path], "level": level, "paragraphs": [], "links": []})

    def _text(self) -> str:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        return text

    def _flush(self) -> None:
        text = self._text()
        if not text:
            return
        if self.rows is not None:
            self.rows[-1].append(text) if self.rows else None
        elif self.items is not None:
            self.items.append("  " * max(0, self.depth - 1) + "- " + text)
        else:
            self.sections[-1]["paragraphs"].append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        self.in_title = tag == "h1"
        classes = set((named.get("class") or "").split())
        plain = tag == "table" and "wikitable" not in classes
        marked = classes & SKIP_CLASSES or any(c.startswith(SKIP_CLASS_BEGINS) for c in classes) or named.get("id") in SKIP_IDS
        if tag in SKIP_TAGS - {"h1"} or plain or marked and tag not in ("html", "body", "main"):
            if tag in BLOCKS:  # what is skipped inside a line does not end it
                self._flush()
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in LEVELS:
            self._flush()
            self.heading = LEVELS[tag]
        elif tag == "br":
            self.buffer.append(" ")
        elif tag in ("ul", "ol"):
            self._flush()
            if self.items is None:
                self.items = []
            self.depth += 1
        elif tag == "table":
            self._flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self._flush()
            self.rows.append([])
        elif tag == "li" or tag in BLOCKS:
            self._flush()
        elif tag == "a":
            title = named.get("title") or (named.get("href") or "").lstrip("./").split("#")[0].replace("_", " ")
            if title and not title.startswith(NAMESPACES) and "://" not in title:
                self.sections[-1]["links"].append(title)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        if tag == "h1":
            self.in_title = False
        elif tag in LEVELS and self.heading is not None:
            level, self.heading = self.heading, None
            self._open(self._text(), level)
        elif tag in ("td", "th") and self.rows is not None:
            self._flush()
        elif tag == "table" and self.rows is not None:
            self._flush()
            rows, self.rows = [r for r in self.rows if r], None
            if len(rows) >= 2:
                self.sections[-1]["paragraphs"].append({"kind": "table", "text": "\n".join(" | ".join(r) for r in rows)})
        elif tag in ("ul", "ol") and self.items is not None:
            self._flush()
            self.depth -= 1
            if self.depth <= 0:
                items, self.items, self.depth = self.items, None, 0
                if items:
                    self.sections[-1]["paragraphs"].append({"kind": "list", "text": "\n".join(items)})
        elif tag == "li" or tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.buffer.append(data)


def parse(html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._flush()
    for section in reader.sections:
        section["links"] = list({link.lower(): link for link in reversed(section["links"])}.values())[::-1]
    kept = [s for s in reader.sections if s["paragraphs"] or s["links"] or s["level"]]
    return {"title": " ".join(reader.title.split()), "is_disambiguation": bool(DISAMBIGUATION.search(html or "")), "sections": kept}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, html) in, parsed rows out: some pages at a time, so that no batch lies parsed as a whole in memory."""
    for batch in batches:
        at = 0
        for part in pieces(batch.column(1)):
            rows = [parse(h) for h in part.to_pylist()]
            ids, at = batch.column(0).slice(at, len(rows)), at + len(rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array([r["title"] for r in rows], pa.string()), pa.array([r["is_disambiguation"] for r in rows], pa.bool_()), pa.array([r["sections"] for r in rows], pa.list_(_SECTION))], names=[batch.schema.names[0], "title", "is_disambiguation", "sections"])


def parsed(articles: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, title, is_disambiguation, sections): Arrow batches in, nested rows out, no shuffle."""
    return articles.select(id_col, html_col).mapInArrow(_parsed, f"`{id_col}` {articles.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def paragraphs(articles: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, section, position, heading, path, level, kind, text) of parsed articles."""
    rows = articles.select(id_col, F.explode("sections").alias("s")).select(id_col, "s.*")
    return rows.select(id_col, F.col("position").alias("section"), "heading", "path", "level", F.posexplode("paragraphs").alias("position", "p")).select(id_col, "section", "position", "heading", "path", "level", "p.*")
