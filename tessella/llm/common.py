"""Shared small helpers: tables, checkpoints, text columns as byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once with numpy; bounds temporary arrays, never the text.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: as spark.checkpoint.dir says; where it is unset a temporary one, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    return context.getCheckpointDir()


def by_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of bounded size; the function returned gives it in a task.

    Broadcasts are pickled by reference to their classes; packed like this, an executor needs no copy of this subpackage.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster shares."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


#: Where write_and_read() notes its tables while an owner is at work.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owning() -> Iterator[list[str]]:
    """The paths of the tables that write_and_read() writes meanwhile: the owner deletes them when what reads them is done."""
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield paths
    finally:
        _OWNED.reset(token)


def write_and_read(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table in the shared folder: for rows with texts. See owning() and done()."""
    path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of write_and_read(); those that are gone already are left out."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tables(df: DataFrame) -> set[str]:
    """The names of the tables of write_and_read() that a frame is read from."""
    return {file.split("/")[-2] for file in df.inputFiles() if file.split("/")[-3:-2] == ["tables"]}


def done(table_: DataFrame) -> None:
    """Delete the tables of write_and_read() that a frame is read from: for when nothing else needs them."""
    spark = table_.sparkSession
    delete(spark, [f"{_shared_folder(spark)}/tables/{name}" for name in tables(table_)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each; a longer row stands alone, whole."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


MIX = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64: (inverse, base)."""
    out = []
    for b in (pow(base, -1, 1 << 64), base):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class SpanHash:
    """64-bit polynomial hashes of byte spans that do not depend on the place of a span."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse, self.power = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.inverse) < n:
            self.inverse, self.power = powers(self.base, max(n, 1 << 16))

    def totals(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._room(n + 1)
        total = np.zeros(n + 1, np.uint64)
        value = data.astype(np.uint64)
        value += np.uint64(1)
        value *= self.inverse[:n]
        np.cumsum(value, out=total[1:])
        return total

    def each(self, total: np.ndarray, width: int) -> np.ndarray:
        """As of(), for the spans of width bytes from every byte on."""
        value = total[width:] - total[:-width]
        value *= self.power[: len(value)]
        value ^= value >> np.uint64(29)
        value *= MIX
        value ^= np.uint64(width)
        return value

    def of(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (total[ends] - total[starts]) * self.power[starts]
        value ^= value >> np.uint64(29)
        return (value * MIX) ^ (ends - starts).astype(np.uint64)


def fold(column: Column) -> Column:
    """The remainder of crc32(id as text) by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like the given ones that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)
