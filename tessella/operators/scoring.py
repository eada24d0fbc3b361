"""What leaves a task of the scores of its chunks against all slots: every row, the best rows of each slot, the best slots of each chunk, or totals.

A ranker scores nearly every pair of a chunk and a slot, as they share some word or gram. Who wants candidates or
totals takes them where the scores arise: the best rows of a topic's slot are among the best ones of its parts, and
counts, sums and maxima add up. So what is shuffled grows with the parts and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


class Sink:
    """Takes blocks of whole scores of one topic; slots are told apart by their places.

    what is `rows`, `best` (n rows of each slot; ties go to the earlier chunk), `totals`, or `chunks` (of each chunk the slots
    that may be its best one once scores are rounded to steps: those within `step` of its highest score, but none that another
    one beats in score and id).
    """

    def __init__(self, what: str, slot_ids: list, slot_type: DataType, chunk_type: DataType, n: int, step: int = 0) -> None:
        self.what, self.n, self.step = what, n, step
        self.slot_ids = pa.array(slot_ids, to_arrow_type(slot_type))
        self.chunk_type = to_arrow_type(chunk_type)
        if what == "totals":
            self.count, self.total, self.most = (np.zeros(len(slot_ids), np.int64) for _ in range(3))
        self.least = np.full(len(slot_ids), np.iinfo(np.int64).min)
        self.held = [pa.table({"slot": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], self.chunk_type)})]

    def add(self, ids: pa.Array, value: np.ndarray, hit: np.ndarray) -> None:
        """Scores of chunks (rows) and slots (columns), of which those marked in hit count."""
        if self.what == "totals":
            of = np.where(hit, value, 0)
            self.count += hit.sum(axis=0)
            self.total += of.sum(axis=0)
            self.most = np.maximum(self.most, of.max(axis=0, initial=0))
            return
        if self.what == "chunks":
            # slots are in the order of their ids: one counts if it is higher than all before it, and near the highest
            value = np.where(hit, value, np.iinfo(np.int64).min)
            before = np.maximum.accumulate(value, axis=1)
            hit = hit & (value >= before[:, -1:] - self.step)
            hit[:, 1:] &= value[:, 1:] > before[:, :-1]
            row, slot = np.nonzero(hit)
            some, counts = np.unique(row, return_counts=True)
            self.held.append(pa.table({"id": ids.take(pa.array(some)), "best": self._lists(counts, slot, value[row, slot])}))
            return
        row, slot = np.nonzero(hit & (value >= self.least) if self.what == "best" else hit)
        if not len(row):
            return
        self.held.append(pa.table({"slot": pa.array(slot, pa.int64()), "score": pa.array(value[row, slot], pa.int64()), "id": ids.take(pa.array(row))}))
        if self.what == "best":
            self._cut()

    def _lists(self, counts: np.ndarray, slot: np.ndarray, score: np.ndarray) -> pa.ListArray:
        each = pa.StructArray.from_arrays([self.slot_ids.take(pa.array(slot, pa.int64())), pa.array(score, pa.int64())], names=["slot_id", "score"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), each)

    def _cut(self) -> None:
        rows = pa.concat_tables(self.held)
        order = pc.sort_indices(rows, sort_keys=[("slot", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        slot = rows["slot"].to_numpy()
        first = np.searchsorted(slot, np.arange(len(self.slot_ids) + 1))
        rank = np.arange(len(slot)) - first[slot]
        last = np.flatnonzero(rank == self.n - 1)
        self.least[slot[last]] = rows["score"].to_numpy()[last]
        self.held = [rows.filter(pa.array(rank < self.n)).combine_chunks()]

    def table(self, topic: str | None) -> pa.Table:
        if self.what == "totals":
            at = np.flatnonzero(self.count)
            return pa.table({"slot_id": self.slot_ids.take(pa.array(at)), "topic": pa.array([topic] * len(at), pa.string()), "n": self.count[at], "total": self.total[at], "best": self.most[at]})
        if self.what == "chunks":
            nothing = np.array([], np.int64)
            rows = pa.concat_tables([*self.held[1:], pa.table({"id": pa.array([], self.chunk_type), "best": self._lists(nothing, nothing, nothing)})])
            return pa.table({"topic": pa.array([topic] * len(rows), pa.string()), "chunk_id": rows["id"], "best": rows["best"]})
        rows = pa.concat_tables(self.held)
        return pa.table({"slot_id": self.slot_ids.take(rows["slot"].combine_chunks()), "topic": pa.array([topic] * len(rows), pa.string()), "chunk_id": rows["id"], "score": rows["score"]})


def schema(what: str, slots: DataFrame, chunks: DataFrame) -> str:
    """The columns of Sink.table()."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    if what == "chunks":
        return f"topic string, chunk_id {kind(chunks, 'chunk_id')}, best array<struct<slot_id: {kind(slots, 'slot_id')}, score: long>>"
    tail = "n long, total long, best long" if what == "totals" else f"chunk_id {kind(chunks, 'chunk_id')}, score long"
    return f"slot_id {kind(slots, 'slot_id')}, topic string, {tail}"


def merged(parts: DataFrame, what: str) -> DataFrame:
    """The totals of (slot_id, topic) of all parts; of the best ones of parts, all are left, as the next step ranks them anyway."""
    if what != "totals":
        return parts
    return parts.groupBy("slot_id", "topic").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with their part among those of their topic: parts has (topic, parts). Only topics of several parts are
    broadcast, of which there are no more than rows of a part go into the table."""
    several = F.broadcast(parts.where("parts > 1").select("topic", "parts"))
    kept = rows.where(F.col("topic").isNotNull()).join(several, "topic", "left")
    return kept.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
