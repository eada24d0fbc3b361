"""Queries of formulas in texts and of archives that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import formulas as L
from tessella.operators import inverted
from tessella.plans.ranking import chunks, slots
from tessella.plans.registry import ORACLES, query, table
from tessella.sources import zim
from tessella.sources.shared import shared_folder


@query(
    "h10_formulas",
    r"""SELECT doc_id, md5(regexp_replace(t, '([a-z]+)([a-z])\.', '(\1\2ᵢ² + √\2)/(2\1) ≤ α · \1.', 'g')) AS digest, contains(t, '.') AS any_stop FROM (SELECT doc_id, regexp_replace(text, '[\\$_^]', '', 'g') AS t FROM documents)""",
)
def h10_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word before a full stop becomes a formula of its letters."""
    text = F.regexp_replace("text", r"[\\$_^]", "")
    made = F.regexp_replace(text, r"([a-z]+)([a-z])\.", r"\\(\\frac{$1$2_{i}^{2}+\\sqrt{$2}}{2$1}\\leq\\alpha\\cdot $1\\).")
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return L.in_texts(rows, "doc_id").select("doc_id", F.md5("text").alias("digest"), F.contains("text", F.lit(".")).alias("any_stop"))


@query("a1_archive_contents", "SELECT 'p/' || page_id AS path, url AS title, 'text/html' AS mime, md5(html) AS digest FROM pages")
def a1_archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, one a partition, and read again by way of directories and clusters."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), "page_id").alias("path"), F.col("url").alias("title"), F.lit("text/html").alias("mime"), F.encode("html", "UTF-8").alias("content"))
    folder = shared_folder(spark, "archives")
    zim.save(pages, folder)
    found = zim.contents(zim.entries(spark, folder, 1_000))
    return found.select("path", "title", "mime", F.md5("content").alias("digest"))


@query("a7_indexed_search", ORACLES["a7_search"])
def a7_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of a7_search by an index of all paragraphs that is written before."""
    path = shared_folder(spark, "indexes")
    inverted.build(chunks(spark, sf_dir).select("chunk_id", "text"), path)
    return inverted.search(spark, slots(spark, sf_dir), path)
