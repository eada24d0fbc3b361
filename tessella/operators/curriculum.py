"""Curriculum search: keywords at word borders, scores, and levels with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stands(text: Column, word: Column) -> Column:
    """Whether a word starts a word of the text or ends a compound after two letters or more, and is not negated."""
    letters = r"[\p{L}\p{N}_]"
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    not_negated = r"(?<!(?i:nicht[- ]))"
    start = F.concat(F.lit(f"(?iu){not_negated}(?<!{letters})"), quoted)
    end = F.concat(F.lit(r"(?iu)(?<!(?i:nicht[- ]))(?<=\p{L}\p{L})"), quoted, F.lit(f"(?!{letters})"))
    clean = F.translate(text, "\u00ad", "")
    return F.expr("true") & (F.rlike(clean, start) | F.rlike(clean, end))


def search(nodes: DataFrame, keywords: DataFrame, limit_generic: int | None = None) -> DataFrame:
    """(node columns, keyword, matched_in): the first keyword that stands in a node's label, else in its parent's.

    keywords has (pos, keyword). A word that stands in over limit_generic nodes is dropped, but never the first.
    Nodes meet the keywords by containment, a nested-loop join against a table as small as a request.
    """
    both = nodes.join(F.broadcast(keywords), F.contains(F.lower("label"), F.lower("keyword")) | F.contains(F.lower("parent_label"), F.lower("keyword")))
    own, parent = stands(F.col("label"), F.col("keyword")), stands(F.col("parent_label"), F.col("keyword"))
    hits = both.withColumn("rank", F.when(own, F.lit(0)).when(parent, F.lit(1))).where("rank IS NOT NULL")
    if limit_generic is not None:
        generic = hits.groupBy("keyword", "pos").agg(F.count("*").alias("n")).where((F.col("n") > limit_generic) & (F.col("pos") > 0)).select("keyword")
        hits = hits.join(F.broadcast(generic), "keyword", "left_anti")
    best = hits.groupBy(*nodes.columns).agg(F.min(F.struct("rank", "pos", "keyword")).alias("b"))
    return best.select(*nodes.columns, F.col("b.keyword").alias("keyword"), F.when(F.col("b.rank") == 0, "label").otherwise("parent").alias("matched_in"))


def score(role: Column, matched_in: Column, from_data: Column) -> Column:
    """100 for each step of the role's weight, 10 for a hit in the own label, 1 for a level taken from data."""
    return role * 100 + F.when(matched_in == "label", 10).otherwise(0) + F.when(from_data, 1).otherwise(0)


def grades(label: Column) -> Column:
    """Numbers from 1 to 13 that stand alone in a label."""
    found = F.transform(F.regexp_extract_all(label, F.lit(r"(?<![\p{L}\p{N}_])(\d{1,2})(?![\p{L}\p{N}_])"), F.lit(1)), lambda n: n.cast("int"))
    return F.filter(found, lambda n: (n >= 1) & (n <= 13))


def level_of(grade: Column) -> Column:
    return F.when(grade <= 4, "primary").when(grade <= 10, "lower secondary").when(grade.isNotNull(), "upper secondary")


def ladder(*steps: tuple[Column, str]) -> Column:
    """The first value that is not null, with where it comes from."""
    found = F.coalesce(*[F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"))) for value, source in steps])
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("value"), F.lit("none").alias("source")))
