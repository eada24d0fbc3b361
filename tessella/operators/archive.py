"""Articles of archives: projects, redirects to sections, authority blocks, title suggestions, search, vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ranking as R
from tessella.sources.shared import cut

# Projects in the order in which a name is tried.
PROJECTS = ["klexikon", "wikibooks", "wikiversity", "wikiquote", "wikisource", "wiktionary", "wikivoyage", "wikipedia"]
HEAD, BLOCK = 2_000, 4_000


def project(*names: Column) -> Column:
    """The first of PROJECTS that stands in one of the names (file, creator, title), else `other`."""
    told = F.lower(F.concat_ws(" ", *names))
    return F.coalesce(*[F.when(F.contains(told, F.lit(p)), F.lit(p)) for p in PROJECTS], F.lit("other"))


def section_target(html: Column) -> Column:
    """The article that a page in an archive leads to by a refresh in its head; null for any other page."""
    found = F.regexp_extract(F.substring(html, 1, HEAD), r"""(?i)<meta\s+http-equiv=["']refresh["']\s+content=["']\d+;\s*url=['"]?\./([^'"#]+)""", 1)
    return F.when(found != "", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def authority(html: Column) -> Column:
    """(kind, gnd, viaf) of the authority block of an article; null without a block. What follows the block does not count."""
    start = F.instr(html, 'id="normdaten"')
    window = F.substring(html, start, F.lit(BLOCK))
    # fixed values: the marks of the block
    kind = F.regexp_extract(window, r"Normdaten(?:&nbsp;|\s)\(([^)<]+)\)", 1)
    behind = F.when(kind != "", F.instr(window, "Normdaten")).otherwise(1)
    end = F.position(F.lit("</div>"), window, behind)
    block = F.when(end > 0, F.substring(window, F.lit(1), end - 1)).otherwise(window)
    some = lambda c: F.when(c != "", c)
    found = F.struct(some(F.trim(kind)).alias("kind"), some(F.regexp_extract(block, r"d-nb\.info/gnd/([0-9X-]+)", 1)).alias("gnd"), some(F.regexp_extract(block, r"viaf\.org/viaf/(\d+)", 1)).alias("viaf"))
    return F.when(start > 0, found)


def same_as(gnd: Column, viaf: Column, qid: Column, resource: Column) -> Column:
    """Identifiers as addresses, those that are known, in a fixed order."""
    of = lambda base, c: F.concat(F.lit(base), c)
    return F.array_compact(F.array(of("https://d-nb.info/gnd/", gnd), of("https://viaf.org/viaf/", viaf), of("http://www.wikidata.org/entity/", qid), resource))


def suggestions(asked: DataFrame, titles: DataFrame, prefix: str = "prefix", title: str = "title", n: int = 8) -> DataFrame:
    """(prefix, title, place): the n shortest titles that begin with each prefix, case aside.

    Titles meet prefixes on equal begins, one row for each length that is asked for.
    """
    wanted = asked.select(F.lower(F.col(prefix)).alias("_p"), prefix).where("_p <> ''").distinct()
    lengths = F.broadcast(wanted.select(F.length("_p").alias("_l")).distinct())
    begins = titles.select(title).distinct().join(lengths, F.length(title) >= F.col("_l")).withColumn("_p", F.lower(F.substring(title, F.lit(1), F.col("_l"))))
    order = Window.partitionBy(prefix).orderBy(F.length(title), title)
    return begins.join(wanted, "_p").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(prefix, title, "place")


def search(queries: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    """(slot_id, chunk_id, place, score): the n articles of best BM25 score for each query (slot_id, text)."""
    found = R.bm25(queries, articles.withColumn("topic", F.lit("all")), "best", n)
    order = Window.partitionBy("slot_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("slot_id", "chunk_id", "place", "score")


def concepts(vocabularies: DataFrame, text: str = "json", most_levels: int = 16) -> DataFrame:
    """(id, label, parent, level) of all concepts of SKOS vocabularies, by way of `narrower`, level by level."""
    shape = "struct<id: string, prefLabel: struct<de: string>, narrower: array<string>, hasTopConcept: array<string>>"
    level = vocabularies.select(F.from_json(text, shape).alias("c")).select(F.explode("c.hasTopConcept").alias("json"), F.lit(None).cast("string").alias("parent"))
    found = []
    for depth in range(most_levels):
        read = level.select(F.from_json("json", shape).alias("c"), "parent")
        found.append(read.select("c.id", F.col("c.prefLabel.de").alias("label"), "parent", F.lit(depth).alias("level")))
        level = cut(read.select(F.explode("c.narrower").alias("json"), F.col("c.id").alias("parent")))  # else each level reads all above it again
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
