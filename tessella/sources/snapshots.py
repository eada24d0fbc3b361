"""Versioned snapshots: a table is written whole beside the old one, checked, and then named current."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(rows: DataFrame, root: str, guard: Callable[[DataFrame | None, DataFrame], str | None] | None = None) -> str:
    """Write a snapshot under root and append it to root/current; readers see the old one until then.

    guard gets the old and the new snapshot and may return a reason to refuse; the old one stays current.
    The list of versions is itself a table, so this works on any store that Spark writes to.
    """
    spark = rows.sparkSession
    path = f"{root}/v={uuid.uuid4().hex}"
    rows.write.parquet(path)
    fresh, old = spark.read.parquet(path), current(spark, root)
    reason = guard(old, fresh) if guard else None
    if reason:
        raise ValueError(reason)
    spark.sql("SELECT 1").select(F.lit(path).alias("path"), F.current_timestamp().alias("published")).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot published last, or None."""
    try:
        newest = spark.read.parquet(f"{root}/current").orderBy(F.desc("published")).first()
    except Exception as e:  # the pointer table does not exist before the first publication
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(newest.path)


def refuse_losses(key: str) -> Callable[[DataFrame | None, DataFrame], str | None]:
    """A guard: refuse a snapshot that would lose over half of the rows of any value of key."""

    def guard(old: DataFrame | None, new: DataFrame) -> str | None:
        if old is None:
            return None
        before = old.groupBy(key).agg(F.count("*").alias("before"))
        after = new.groupBy(key).agg(F.count("*").alias("after"))
        lost = before.join(after, key, "left").where("coalesce(after, 0) * 2 < before").orderBy(key).limit(5).collect()
        return f"over half would be lost of {', '.join(str(r[key]) for r in lost)}" if lost else None

    return guard
