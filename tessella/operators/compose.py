"""Composing of documents as string aggregates: sections with evidence, glossary, actors, sources, parts and front matter.

Every list is ordered inside its group's array, so the text of a group does not depend on partitions; what goes into
one text is bounded by budgets and by the limits named here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import markup as M
from tessella.functions.text import marker_encoded
from tessella.operators.subjects import title_word

LIST_ITEMS, TABLE_ROWS, GLOSSARY, REFERENCES, SNIPPET, EVIDENCE = 8, 8, 20, 15, 140, 600
KIND_ORDER = ["Person", "Organisation", "Vorhaben", "Netzwerk"]


def ordered_text(order: list[Column], line: Column, between: str = "\n") -> Column:
    """An aggregate: the lines of a group in order, joined."""
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(packed)), lambda r: r["line"]), between)


def list_body(text: Column) -> Column:
    """A list of at most LIST_ITEMS items, one a line."""
    items = F.filter(F.split(text, "\n"), lambda i: F.trim(i) != "")
    return F.array_join(F.transform(F.slice(items, 1, LIST_ITEMS), lambda i: F.concat(F.lit("- "), M.escaped(F.regexp_replace(i, r"^[ \-•*]+|[ \-•*]+$", "")))), "\n")


def table_body(text: Column) -> Column:
    """A table of at most TABLE_ROWS rows, the first as its head; text without any row stays text."""
    rows = F.slice(F.filter(F.split(text, "\n"), lambda r: F.contains(r, F.lit("|"))), 1, TABLE_ROWS)
    cells = F.transform(rows, lambda r: F.transform(F.split(r, r"\|"), lambda c: M.escaped(F.trim(c))))
    width = F.array_max(F.transform(cells, F.size))
    lines = F.transform(cells, lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(""), width - F.size(c))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    return F.when(F.size(rows) == 0, M.escaped(text)).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, TABLE_ROWS)), "\n"))


def extractive(chunks: DataFrame, by: list[str], sentences: int = 3, lead_sentences: int = 5) -> tuple[DataFrame, DataFrame]:
    """The text of each slot from its chunks, and the citations: (by, text) and (by, number, chunk_id, snippet).

    chunks has (by, order, chunk_id, kind, text, is_lead, sentences); kind is text, list or table. Each paragraph
    ends with its number; a table has it in a paragraph of its own. Bodies that repeat in a slot, and chunks
    without a sentence, give none.
    """
    picked = F.slice("sentences", F.lit(1), F.when(F.col("is_lead"), lead_sentences).otherwise(sentences))
    body = F.when(F.col("kind") == "list", list_body(F.col("text"))).when(F.col("kind") == "table", table_body(F.col("text"))).otherwise(M.escaped(F.array_join(picked, " ")))
    rows = chunks.withColumn("body", body).where("body <> ''")
    first = rows.groupBy(*by, "body").agg(F.min(F.struct("order", "chunk_id", "kind")).alias("m")).select(*by, "body", "m.*")
    rows = first.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("order", "chunk_id")))
    mark = F.concat(F.when(F.col("kind") == "table", F.lit("\n\n[")).otherwise(F.lit(" [")), F.col("number").cast("string"), F.lit("]"))
    texts = rows.groupBy(*by).agg(ordered_text([F.col("number")], F.concat("body", mark), "\n\n").alias("text"))
    return texts, rows.select(*by, "number", "chunk_id", F.substring(M.unescaped(F.col("body")), 1, 220).alias("snippet"))


def section_texts(sections: DataFrame) -> DataFrame:
    """sections (.., kept, generated, extracted) with text and status: what was kept, else generated, else extracted, else `empty`."""
    ways = ("kept", "generated", "extracted")
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    text = reduce(lambda rest, w: F.when(has(F.col(w)), F.col(w)).otherwise(rest), reversed(ways), F.lit(""))
    status = reduce(lambda rest, w: F.when(has(F.col(w)), F.lit(w)).otherwise(rest), reversed(ways), F.lit("empty"))
    return sections.withColumns({"section_text": text, "status": status})


def glossary(entries: DataFrame, by: str) -> DataFrame:
    """(by, text): a table of at most GLOSSARY terms: the article's own first, then by name.

    entries has (by, topic, term, definition, url, is_primary, is_alias, order). A term counts once, case aside; other articles
    whose title holds the topic's stem are narrower, the rest related. Entries without a definition are left out.
    """
    stem = F.expr("CASE WHEN length(_w) >= 5 THEN substring(_w, 1, length(_w) - 1) ELSE _w END")
    rows = entries.where("definition IS NOT NULL").withColumn("_w", title_word(F.col("topic"))).withColumn("_s", stem)
    narrower = (F.length("_s") >= 4) & F.contains(F.lower("term"), F.col("_s"))
    relation = F.when(F.col("is_primary"), "skos:prefLabel").when(F.col("is_alias"), "skos:altLabel").when(narrower, "skos:narrower").otherwise("skos:related")
    rows = rows.withColumn("relation", relation).withColumn("rank", F.when(F.col("is_primary"), 0).when(F.col("is_alias"), 1).otherwise(2))
    once = rows.groupBy(by, F.lower("term").alias("_t")).agg(F.min(F.struct("rank", "order", "term", "definition", "relation", "url")).alias("m")).select(by, "_t", "m.*")
    kept = once.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("rank", "order", "_t"))).where(F.col("_n") <= GLOSSARY)
    line = F.concat(F.lit("| **"), M.cell(F.col("term")), F.lit("** | "), M.cell(F.col("definition")), F.lit(" | `"), F.col("relation"), F.lit("` | "), M.link(M.cell(F.col("term")), F.col("url")), F.lit(" |"))
    head = "| Begriff | Definition | Relation | Beleg |\n| :--- | :--- | :--- | :--- |\n"
    return kept.groupBy(by).agg(F.concat(F.lit(head), ordered_text([F.col("relation") != "skos:prefLabel", F.col("_t")], line)).alias("text"))


# Words by which an actor's lead tells its function, in order.
FUNCTIONS = [
    ("Wissenschaft & Entwicklung", "Universität|Hochschule|Institut|Forschung|Akademie|Wissenschaft|Labor"),
    ("Rahmensetzung", "Behörde|Ministerium|Bundesamt|Norm|Aufsicht|Gesetz|Regulierung|Kammer"),
    ("Bildung", "Schule|Ausbildung|Lehre|Unterricht|Bildung|Didaktik|Lehrer"),
    ("Vernetzung & Fachgebietsentwicklung", "Verband|Verein|Gesellschaft|Netzwerk|Verbund|Community|Fachgesellschaft|Kooperation"),
]


def functions_of(lead: Column, kind: Column, most: int = 2) -> Column:
    """At most two functions of an actor by the words of its lead; a person without any is of science."""
    found = F.array_compact(F.array(*[F.when(F.rlike(F.substring(lead, 1, 600), F.lit(rf"(?iu)(?U)\b(?:{words})")), F.lit(name)) for name, words in FUNCTIONS]))
    default = F.when(kind == "Person", FUNCTIONS[0][0]).otherwise(FUNCTIONS[-1][0])
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(default))


def actors(sources: DataFrame, by: str, kind: Column, lookups: int = 40) -> DataFrame:
    """(by, name, kind, functions): sources (title, lead, order) that are actors; at most that many of each topic are looked at."""
    order = Window.partitionBy(by).orderBy("order", "title")
    rows = sources.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= lookups).withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select(by, F.col("title").alias("name"), "kind", functions_of(F.col("lead"), F.col("kind")).alias("functions"))


def actor_list(found: DataFrame, by: str, summary: Column) -> DataFrame:
    """(by, text): actors under a heading for each kind, by name."""
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    line = F.concat(F.lit("- **"), M.cell(F.col("name")), F.lit("** — "), M.cell(summary))
    groups = found.groupBy(by, "kind").agg(F.min(place).alias("place"), ordered_text([F.lower("name"), F.col("name")], line).alias("lines"))
    return groups.groupBy(by).agg(ordered_text([F.col("place")], F.concat(F.lit("#### "), F.col("kind"), F.lit("\n\n"), F.col("lines")), "\n\n").alias("text"))


def sources_block(sources: DataFrame, citations: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """(by, text): a line for each source, a table of citations, at most REFERENCES further sources, and the licences."""
    line = F.concat(F.lit("- **"), M.link(M.cell(F.col("title")), F.col("url")), F.lit("** · Lizenz "), M.cell(F.col("licence")))
    one = sources.groupBy(by).agg(ordered_text([F.col("order")], line).alias("one"), M.listed(F.array_sort(F.collect_set(M.cell(F.col("licence"))))).alias("licences"))
    snippet = F.regexp_replace(M.one_line(F.col("snippet")), rf"^(.{{{SNIPPET - 3}}}).{{4,}}$", "$1…")
    row = F.concat(F.lit("| ["), F.col("number").cast("string"), F.lit("] | "), M.cell(F.col("title")), F.lit(" | "), M.cell(snippet), F.lit(" |"))
    two = citations.groupBy(by).agg(ordered_text([F.col("number")], row).alias("two"))
    first = references.groupBy(by, "reference").agg(F.min("order").alias("order"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("order", "reference"))).where(F.col("_n") <= REFERENCES)
    three = first.groupBy(by).agg(ordered_text([F.col("_n")], F.concat(F.lit("- "), M.cell(F.col("reference")))).alias("three"))
    some = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c)))
    text = F.concat_ws("\n\n", "one", some("### Belegstellen\n\n| Beleg | Quelle | Textauszug |\n| :---: | :--- | :--- |\n", "two"), some("### Weiterführende Quellen\n\n", "three"), F.concat(F.lit("> Lizenzen: "), F.col("licences")))
    return one.join(two, by, "left").join(three, by, "left").select(by, text.alias("text"))


def evidence(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): numbered lines `[n] (source › heading) text` in order, each text on one line and cut."""
    rows = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("order", "chunk_id")))
    line = F.format_string("[%d] (%s › %s) %s", F.col("_n"), F.col("title"), F.col("heading"), M.cut(M.one_line(F.col("text")), EVIDENCE))
    return rows.groupBy(*by).agg(ordered_text([F.col("_n")], line).alias("text"))


def part_two(hits: DataFrame, by: str) -> DataFrame:
    """(by, text): hits grouped by level, state, curriculum and area, in that order; each group a heading and its items.

    hits has (level, state, curriculum, area, label, roles, note, score). Items of note 1 are counted with their
    area and not listed; an item that is called like its area stands for the area.
    """
    keys = [by, "level", "state", "curriculum", "area"]
    own = hits.where("label <> area")
    listed = F.coalesce(F.col("note"), F.lit(2)) == 2
    line = F.concat(F.lit("- „"), M.cell(F.col("label")), F.lit("“ ("), F.col("roles"), F.lit(")"))
    items = own.where(listed).groupBy(*keys).agg(ordered_text([-F.col("score"), F.col("label"), F.col("roles")], line).alias("items"))
    rest = own.where(~listed).groupBy(*keys).agg(F.count("*").alias("bundled"))
    groups = hits.select(*keys).distinct().join(items, keys, "left").join(rest, keys, "left")
    more = F.when(F.col("bundled") > 0, F.concat(F.lit("- und "), F.col("bundled").cast("string"), F.lit(" weitere")))
    head = F.concat(F.lit("### "), M.cell(F.col("area")), F.lit("\n\n*"), M.cell(F.col("curriculum")), F.lit("* · "), F.col("state"), F.lit(" · "), F.col("level"))
    return groups.groupBy(by).agg(ordered_text([F.col(k) for k in keys[1:]], F.concat_ws("\n", head, "items", more), "\n\n").alias("text"))


def part_three(nodes: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """(by, text, materials, undescribed): a node's line, its key figures, and a line for each item."""
    line = F.concat(F.lit("- "), M.link(M.cell(F.col("item")), F.col("url")), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), M.cell(M.first_sentence(F.col("description"))))).otherwise(""))
    of = items.groupBy(by).agg(F.count("*").alias("materials"), F.count(F.when(F.coalesce("description", F.lit("")) == "", 1)).alias("undescribed"), ordered_text([F.col("order")], line).alias("lines"))
    rows = nodes.join(of, by, "left").withColumns({"materials": F.coalesce("materials", F.lit(0)), "undescribed": F.coalesce("undescribed", F.lit(0))})
    figures = F.concat(F.col("materials").cast("string"), F.lit(" Materialien, davon "), F.col("undescribed").cast("string"), F.lit(" ohne Beschreibung"))
    text = F.concat_ws("\n\n", F.concat(F.lit("**Sammlung "), M.cell(F.col("title")), F.lit("**")), figures, "lines")
    return rows.select(by, text.alias("text"), "materials", "undescribed")


def section_marker(slot: Column, status: Column, text: Column, facets: Column) -> Column:
    """The comment by which a section is known again; facets is an encoded string or null."""
    shown = F.when(F.coalesce(facets, F.lit("")) != "", F.concat(F.lit(' facets="'), facets, F.lit('"'))).otherwise("")
    return F.concat(F.lit("<!-- kompendium:section id="), slot, F.lit(" status="), status, shown, F.lit(" hash="), M.digest(text), F.lit(" -->"))


def facet_value(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), marker_encoded(value))


def assembled(sections: DataFrame, by: str, front: dict[str, Column]) -> DataFrame:
    """(by, text): front matter and the sections in order, each with its marker and heading; sections (order, slot, title, status, text)."""
    head = F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{name}: "), M.inert(value), F.lit("\n")) for name, value in front.items()], F.lit("---"))
    part = F.concat(section_marker(F.col("slot"), F.col("status"), F.col("text"), F.lit(None).cast("string")), F.lit("\n## "), M.cell(F.col("title")), F.lit("\n\n"), F.col("text"))
    return sections.groupBy(by).agg(ordered_text([F.col("order")], part, "\n\n").alias("_t")).select(by, F.concat(head, F.lit("\n\n"), F.col("_t")).alias("text"))


def parsed_sections(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, slot, status, hash, title, body, untouched): the sections of earlier documents, read back by their
    markers; untouched tells whether the body still has the digest that was written."""
    mark = r"<!-- kompendium:section id=(\S+) status=(\S+)(?: facets=\"[^\"]*\")? hash=([0-9a-f]{12}) -->"
    parts = F.slice(F.split(text, r"(?=<!-- kompendium:section )"), 2, 1 << 30)
    rows = documents.select(key, F.posexplode(parts).alias("place", "p"))
    of = lambda i: F.regexp_extract("p", mark, i)
    body = F.regexp_replace(F.regexp_replace("p", rf"(?s)^{mark}\n(?:## [^\n]*\n\n)?", ""), r"\s+$", "")
    rows = rows.select(key, "place", of(1).alias("slot"), of(2).alias("status"), of(3).alias("hash"), F.regexp_extract("p", r"(?m)^## (.*)$", 1).alias("title"), body.alias("body"))
    return rows.withColumn("untouched", M.digest(F.col("body")) == F.col("hash"))


def prose(text: Column) -> Column:
    """The prose of a finished document: without comments, markers of evidence, headings and escapes."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)^#{1,6} .*$", ""), r" ?\[\d+\]", "")
    return F.regexp_replace(F.regexp_replace(M.unescaped(plain), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
