"""Rule tables over text: the slot of a heading, facets of a paragraph. Rules are rows; they are tiny and broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(paths: DataFrame, rules: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, slot): the deepest heading that a rule matches decides, then the earlier slot.

    rules has (slot, slot_order, pattern); the join is a nested loop against as many rows as a lexicon has.
    """
    headings = paths.select(key, F.posexplode(path).alias("depth", "heading")).withColumn("heading", F.substring(F.regexp_replace(F.regexp_replace("heading", r"\s+", " "), r"^[ :]+|[ :]+$", ""), 1, 120))
    met = headings.join(F.broadcast(rules), F.expr("rlike(heading, concat('(?iu)', pattern))"))
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("depth")).alias("d"), "slot_order", "slot")).alias("b"))
    return best.select(key, F.col("b.slot").alias("slot"))


def facets(chunks: DataFrame, rules: DataFrame, key: str, text: str = "text", most: int | None = None) -> DataFrame:
    """(key, facet, values): values of matching rules in the order of the rules; rules has (facet, value, rule_order, pattern)."""
    met = chunks.select(key, text).join(F.broadcast(rules), F.expr(f"rlike({text}, concat('(?iu)', pattern))"))
    grouped = met.groupBy(key, "facet").agg(F.array_sort(F.collect_set(F.struct("rule_order", "value"))).alias("v"))
    values = F.array_distinct(F.transform("v", lambda r: r["value"]))
    return grouped.select(key, "facet", (F.slice(values, 1, most) if most else values).alias("values"))


def time_reference(chunks: DataFrame, past: str, future: str, as_of: int, key: str, text: str = "text") -> DataFrame:
    """(key, value): prospective, historical or present, by counts of words and of years over 30 years before as_of."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    old = F.size(F.filter(years, lambda y: y < as_of - 30))
    ahead, back = F.regexp_count(text, F.lit(f"(?iu){future}")), F.regexp_count(text, F.lit(f"(?iu){past}"))
    value = F.when((ahead >= 2) & (ahead >= back), "prospective").when(back + old >= 2, "historical").otherwise("present")
    return chunks.select(key, value.alias("value"))
