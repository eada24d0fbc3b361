"""The folder that the driver and all executors share, and lineage that is cut there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoints(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir gives; where it is unset a temporary one, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder."""
    return f"{_checkpoints(spark)}/{kind}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: their lineage ends, and they are worked out once."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table: for rows with texts, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession, 'tables')}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to four tasks a core: a small file of short rows is one task otherwise, however much work its rows are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
