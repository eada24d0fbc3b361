"""Choices that depend on earlier accepted ones: kept as array folds inside a row, so nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_overlaps(mentions: DataFrame, by: list[str]) -> DataFrame:
    """The mentions of each text that are left when taken from left to right, longer ones first, none overlapping.

    mentions has (start, end, known) besides by; of equal spans a known kind comes first. A text's mentions are
    one array, folded once: hundreds at most.
    """
    row = F.struct("start", (-(F.col("end") - F.col("start"))).alias("shorter"), (~F.col("known")).alias("unknown"), "end", F.struct(*[c for c in mentions.columns if c not in by]).alias("whole"))
    kept = F.aggregate(
        F.sort_array(F.collect_list(row)),
        F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast(f"array<{mentions.drop(*by).schema.simpleString()}>").alias("rows")),
        lambda acc, m: F.when(m["start"] >= acc["at"], F.struct(m["end"].cast("long").alias("at"), F.concat(acc["rows"], F.array(m["whole"])).alias("rows"))).otherwise(acc),
        lambda acc: acc["rows"],
    )
    return mentions.groupBy(*by).agg(kept.alias("_kept")).select(*by, F.inline("_kept"))


def pick_meaning(meanings: DataFrame, by: str) -> DataFrame:
    """(by, index, confident): meanings has (index, side_topic, score). Side topics listed after an ordinary meaning
    come last; then the higher score, then the earlier one; sure if it alone is best and its score is not zero."""
    first = meanings.where("NOT side_topic").groupBy(by).agg(F.min("index").alias("_first"))
    ranked = meanings.join(first, by, "left").withColumn("demoted", F.col("side_topic") & (F.col("index") > F.coalesce("_first", F.lit(2**31 - 1))))
    rank = F.struct("demoted", (-F.col("score")).alias("low"), "index")
    best = ranked.groupBy(by).agg(F.min(rank).alias("b"), F.min_by("score", rank).alias("s"))
    equal = ranked.join(best, by).where((F.col("demoted") == F.col("b.demoted")) & (-F.col("score") == F.col("b.low"))).groupBy(by).agg(F.count("*").alias("n"))
    return best.join(equal, by).select(by, F.col("b.index").alias("index"), ((F.col("n") == 1) & (F.col("s") > 0)).alias("confident"))


def common_start(a: Column, b: Column) -> Column:
    """How many signs two words share from their start."""
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))
