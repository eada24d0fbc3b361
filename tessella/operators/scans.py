"""Running sums and numbers over groups of any size, in two levels.

Rows are put in order over all groups and cut into blocks, the partitions of a range partitioning. A block sums its rows by
itself, the few sums of a group's blocks are added up, and each row takes what stands before its block. So a group that
holds a third of all rows is spread over many tasks, where a window over the group would sort it in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import cut


def before(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """rows with the sum of value over the rows of their group (by) that come before them in order, 0 for the first.

    order is to tell the rows of a group apart; a null value counts as 0; null groups are groups.
    """
    placed = rows.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()).transform(cut)
    sums = placed.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    # a group has as many rows here as it has blocks
    earlier = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_number"), F.coalesce(earlier, F.lit(0)).alias("_offset"))
    inside = F.sum("_value").over(Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = reduce(lambda x, y: x & y, [placed[c].eqNullSafe(offsets[f"_{c}"]) for c in by] + [F.col("_block") == F.col("_number")])
    found = placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, same)
    return found.select(*rows.columns, (F.col("_inside") + F.col("_offset")).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with their place in their group, from 0."""
    return before(rows, by, order, F.lit(1), name)
