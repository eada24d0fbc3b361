"""Budgets shared among sources: sequential by rank, water-filled within a rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fair_share(needs: DataFrame, budget: int) -> DataFrame:
    """(topic, source, allowed): needs has (topic, source, rank, position, need); ranks are served in order.

    Within a rank the sources come by need, ties by position; each gets at most an equal whole part of what is left. As needs
    go up, they are met in full up to the first that is over its part; what is left then is dealt evenly to it and all
    behind it, whole signs, the later ones one more where it does not come out even. A rank takes all its needs or all
    that is left, so what the ranks before have left follows from sums.
    """
    ranks = needs.groupBy("topic", "rank").agg(F.sum("need").alias("_all"), F.count("*").alias("_many"))
    earlier = F.sum("_all").over(Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranks.withColumn("_left", F.greatest(F.lit(0), budget - F.coalesce(earlier, F.lit(0))))
    of_rank = Window.partitionBy("topic", "rank").orderBy("need", "position", "source")
    rows = needs.join(ranks.withColumnRenamed("topic", "_topic").withColumnRenamed("rank", "_rank"), F.col("topic").eqNullSafe(F.col("_topic")) & F.col("rank").eqNullSafe(F.col("_rank")))
    rows = rows.withColumn("_waiting", F.col("_many") - F.row_number().over(of_rank) + 1)
    rows = rows.withColumn("_rest", F.col("_left") - F.coalesce(F.sum("need").over(of_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over = F.col("need") * F.col("_waiting") > F.col("_rest")
    # the first that is over its part: of those the one with most waiting
    first = F.max(F.when(over & (F.col("_rest") >= 0), F.struct("_waiting", "_rest"))).over(Window.partitionBy("topic", "rank"))
    rows = rows.withColumn("_first", first)
    part, more = F.floor(F.col("_first._rest") / F.col("_first._waiting")), F.pmod(F.col("_first._rest"), F.col("_first._waiting"))
    dealt = part + (F.col("_waiting") <= more).cast("int")
    allowed = F.when(F.col("_first").isNull() | (F.col("_waiting") > F.col("_first._waiting")), F.col("need")).otherwise(dealt)
    return rows.select("topic", "source", allowed.cast("long").alias("allowed"))


def widened(budget: int, factor: float) -> int:
    """A budget times a factor, rounded up."""
    return -int(-(budget * factor) // 1)


def scaled_targets(slots: DataFrame, total: int, least: int = 300) -> DataFrame:
    """Each slot's part of a total of signs by weight, at least 300."""
    whole = slots.agg(F.sum("weight").alias("_sum"))
    return slots.crossJoin(whole).select("slot_id", F.greatest(F.lit(least), F.floor(F.lit(total) * F.col("weight") / F.col("_sum"))).cast("long").alias("target"))
