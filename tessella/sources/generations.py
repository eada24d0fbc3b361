"""A table in generations: keyed changes are merged into the current one, and a log of commits tells which one is current.

A generation is a whole Parquet table beside the others. A commit is a small file in the log, whose name is the number of the
generation and which is created only where it does not exist yet. So of two writers that build on one generation one
commits; the other finds its number taken, reads anew and merges again. Readers see a generation that is committed, whole.
A commit names the batch that it holds: a batch that is merged again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a generation has besides those of the rows: when a row came, was changed, and (else null) went.
MARKS = {"adopted": "long", "changed": "long", "retired": "long"}
RETRIES = 20


class Log:
    """The commits of a table, on any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{number:010d}.json")

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(name[:10]) for f in self.fs.listStatus(self.folder) if (name := f.getPath().getName()).endswith(".json") and name[:10].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def commit(self, entry: dict) -> bool:
        """Whether the entry's number was still free."""
        try:
            stream = self.fs.create(self._path(entry["number"]), False)
        except Exception as e:  # taken by another writer
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def current(spark: SparkSession, root: str, retired: bool = False) -> DataFrame | None:
    """The rows of the current generation, without those that went unless asked for; None before the first commit."""
    last = Log(spark, root).last()
    if last is None:
        return None
    rows = spark.read.parquet(last["path"])
    return rows if retired else rows.where("retired IS NULL")


def merged(old: DataFrame | None, changes: DataFrame, keys: list[str], number: int) -> DataFrame:
    """Rows of the next generation, with a column `what`: adopted, updated, same, retired or kept.

    changes has the rows' columns and a boolean `gone`; of a key it has one row. A row that comes again after it went is adopted.
    """
    values = [c for c in changes.columns if c not in (*keys, "gone")]
    if old is None:
        old = changes.where("false").drop("gone").select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in MARKS.items()])
    new = changes.select(*[F.col(c).alias(f"_{c}") for c in keys], F.struct(*values).alias("_new"), F.coalesce("gone", F.lit(False)).alias("_gone"))
    same_key = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    held = old.select(*keys, F.struct(*values).alias("_old"), *MARKS, F.lit(True).alias("_held"))
    rows = held.join(new, same_key, "full_outer")
    told, here = F.col("_gone").isNotNull(), F.coalesce("_held", F.lit(False)) & F.col("retired").isNull()
    what = F.when(~told, "kept").when(F.col("_gone"), F.when(here, "retired").otherwise(F.when(F.col("_held"), "kept")))
    what = F.coalesce(what, F.when(~here, "adopted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("updated"))
    lost = told & F.col("_gone") & F.col("_held").isNull()  # goes before it came
    value = F.when(what.isin("adopted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    rows = rows.where(~lost).withColumn("what", what).withColumn("_value", value)
    return rows.select(
        *[F.coalesce(c, f"_{c}").alias(c) for c in keys], *[F.col(f"_value.`{c}`").alias(c) for c in values],
        F.when(F.col("what") == "adopted", number).otherwise(F.col("adopted")).cast("long").alias("adopted"),
        F.when(F.col("what").isin("adopted", "updated"), number).otherwise(F.col("changed")).cast("long").alias("changed"),
        F.when(F.col("what") == "retired", number).when(F.col("what") == "adopted", None).otherwise(F.col("retired")).cast("long").alias("retired"), "what",
    )


def merge(changes: DataFrame, root: str, keys: list[str], batch: str, before_commit: Callable[[], None] | None = None) -> dict:
    """Merge changes (see merged()) as a named batch; the commit, or that of the same batch merged before."""
    spark = changes.sparkSession
    log = Log(spark, root)
    for attempt in range(RETRIES):
        numbers = log.numbers()
        for number in reversed(numbers):
            if (entry := log.read(number))["batch"] == batch:
                return entry
        last = log.read(numbers[-1]) if numbers else None
        number = last["number"] + 1 if last else 0
        path = f"{root}/g={number:010d}-{uuid.uuid4().hex}"
        rows = merged(spark.read.parquet(last["path"]) if last else None, changes, keys, number)
        rows.write.partitionBy("what").parquet(f"{path}-new")
        fresh = spark.read.parquet(f"{path}-new")
        counts = {r.what: r["count"] for r in fresh.groupBy("what").count().collect()}
        fresh.drop("what").write.parquet(path)
        log.delete(f"{path}-new")
        if before_commit:
            before_commit()
        entry = {"number": number, "batch": batch, "path": path, "counts": counts, "time": time.time()}
        if log.commit(entry):
            return entry
        log.delete(path)
        time.sleep(min(1.0, 0.05 * 2**attempt))
    raise RuntimeError(f"{RETRIES} other commits came first")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the tables of all but the last generations; their commits stay, so that their batches are still known."""
    log = Log(spark, root)
    entries = [log.read(n) for n in log.numbers()]
    paths = [e["path"] for e in entries[: max(0, len(entries) - keep)]]
    for path in paths:
        log.delete(path)
    return paths


def follow(stream: DataFrame, root: str, keys: list[str], name: str, checkpoint: str):
    """Merge each micro-batch of a stream of changes; one that Spark repeats after a failure changes nothing."""

    def each(rows: DataFrame, number: int) -> None:
        merge(rows, root, keys, f"{name}-{number}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
