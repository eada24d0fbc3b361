"""Character n-gram TF-IDF of chunks against slots, by sparse products in Arrow batches.

Grams are 64-bit hashes of the signs of blank-padded words, so rows are narrow and all work on them is vectorised.
Two passes over the chunks: one counts in how many rows of a topic each gram stands, with counts of a task's batches
merged first; one weighs chunks and slots and multiplies them. In the second a topic's chunks are dealt to parts of
a bounded number of rows and signs, large ones, as each part gets a copy of the topic's gram counts, which grow with the
vocabulary and not with the rows. Slots are a template's and bounded; they travel with the function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scoring import Sink, dealt, merged, schema

#: Chunks and signs that one task weighs together, signs and rows that are counted at once, and grams that a task holds.
PART_ROWS, PART_SIGNS = 50_000, 1 << 24
SIGNS, ROWS, GRAMS_HELD = 1 << 18, 500, 2_000_000
CANDIDATES = 15
SIZES = (3, 4, 5)
_BLANKS = np.array([9, 10, 13, 32], np.uint32)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all n-grams of all rows, repeats included; a word shorter than a size counts once, as it is."""
    points = np.frombuffer("\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    # every run of blanks is one blank that ends a word and begins the next
    blank = np.isin(points, _BLANKS)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    row_of = np.repeat(np.arange(-1, len(texts)), np.append(1, sizes))[: len(points)]
    keep = ~blank | np.append(True, ~blank[:-1])
    points, row_of, blank = np.where(blank, np.uint32(32), points)[keep].astype(np.uint64), row_of[keep], blank[keep]
    edge = np.flatnonzero(blank)
    length = np.diff(edge) + 1  # of each padded word
    start = edge[:-1]
    rows, values = [], []
    for i, n in enumerate(SIZES):
        whole = length >= n
        count = np.where(whole, length - n + 1, 1 if i == 0 else 0)
        first = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        value = np.full(len(first), n, np.uint64)
        wide = np.repeat(np.where(whole, n, length), count)
        for k in range(n):
            at = np.minimum(first + k, len(points) - 1)
            value = (value ^ np.where(k < wide, points[at] + np.uint64(1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        values.append(value)
        rows.append(row_of[first + 1])
    return np.concatenate(rows), np.concatenate(values).view(np.int64)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, how often) of each row's distinct grams, in order of rows and grams, and the sorted grams that places name.

    A word's grams are made once for all rows that have it.
    """
    of_word: dict[str, int] = {}
    sizes, words = [], []
    for t in texts:
        found = [w for w in (t or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        sizes.append(len(found))
        words += [of_word.setdefault(w, len(of_word)) for w in found]
    word, gram = grams(list(of_word))
    known, place = np.unique(gram, return_inverse=True)
    place = place[np.argsort(word, kind="stable")]
    many = np.bincount(word, minlength=len(of_word))
    first = np.cumsum(many) - many
    token = np.array(words, np.int64)
    count = many[token]
    at = np.repeat(first[token] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key = np.repeat(np.repeat(np.arange(len(texts)), sizes), count) * max(1, len(known)) + place[at]
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // max(1, len(known)), key[at] % max(1, len(known)), np.diff(np.append(at, len(key))), known


def _slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts that are counted together, with the place of the first one: of SIGNS signs or a single one that is longer."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) if isinstance(texts, pa.Array) else pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
    a, held = 0, 0
    for b, n in enumerate(size.tolist()):
        if b > a and (held + n > SIGNS or b - a >= ROWS):
            yield a, texts.slice(a, b - a).to_pylist()
            a, held = b, 0
        held += n
    if len(size):
        yield a, texts.slice(a).to_pylist()


class _Counts:
    """In how many rows of a topic each gram stands; gives out what it has when it holds too much."""

    def __init__(self) -> None:
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, topic: str, gram: np.ndarray, df: np.ndarray) -> None:
        self.found.setdefault(topic, []).append((gram, df))
        self.held += len(gram)

    def merge(self) -> None:
        for topic, parts in self.found.items():
            if len(parts) > 1:
                gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                self.found[topic] = [(gram, np.bincount(at, np.concatenate([d for _, d in parts])).astype(np.int64))]
        self.held = sum(len(g) for parts in self.found.values() for g, _ in parts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for topic, ((gram, df),) in self.found.items():
            for a in range(0, len(gram), 50_000):
                some = gram[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([topic] * len(some), pa.string()), pa.array(some), pa.array(df[a : a + 50_000])], names=["topic", "gram", "df"])
        self.found, self.held = {}, 0


def _document_frequencies(rows: DataFrame) -> DataFrame:
    """Rows (topic, gram, df) of (topic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            topic = batch.column(0).dictionary_encode()
            names = topic.dictionary.to_pylist()
            of = topic.indices.to_numpy(zero_copy_only=False)
            # the rows of a topic one after the other, so that few topics meet in a slice
            order = np.argsort(of, kind="stable")
            of, texts = of[order], batch.column(1).take(pa.array(order))
            for a, some in _slices(texts):
                row, place, _, known = counted(some)
                mine = of[a : a + len(some)][row]
                for t in np.unique(mine).tolist():
                    df = np.bincount(place[mine == t], minlength=len(known))
                    at = np.flatnonzero(df)
                    counts.add(names[t], known[at], df[at])
                if counts.held > 2 * GRAMS_HELD:
                    counts.merge()
                    if counts.held > GRAMS_HELD:
                        yield from counts.batches()
        yield from counts.batches()

    found = rows.where(F.col("topic").isNotNull()).select("topic", "text").mapInArrow(run, "topic string, gram long, df long")
    return found.groupBy("topic", "gram").agg(F.sum("df").alias("df"))


def _weights(place: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) x idf in whole millionths; idf is that of each place."""
    log = np.array([0.0, *map(math.log, range(1, int(times.max(initial=0)) + 1))])
    return np.floor((log[times] + 1.0) * idf[place] * 1e6 + 0.5).astype(np.int64)


def _norms(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the sums of squared weights; sums beyond 64 bits are added as Python's integers."""
    if len(weight) and int(weight.max()) ** 2 * int(np.bincount(row).max()) < 1 << 62:
        total, first = np.zeros(n, np.int64), np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        total[row[first]] = np.add.reduceat(weight * weight, first)
        return np.sqrt(total.astype(np.float64))
    exact = [0] * n
    for r, w in zip(row.tolist(), weight.tolist(), strict=True):
        exact[r] += w * w
    return np.sqrt(np.array([float(x) for x in exact]))


def char_tfidf(slots: DataFrame, chunks: DataFrame, least: float = 0.02, part_rows: int = PART_ROWS, what: str = "rows", n: int = CANDIDATES) -> DataFrame:
    """Rows (slot_id, topic, chunk_id, score): cosine of TF-IDF weights of padded character 3- to 5-grams, in millionths.

    As usual for that measure: 1 + ln tf, ln((1 + n) / (1 + df)) + 1, unit length; counted over the topic's chunks and
    all slots together. slots is collected: it is a template's, of bounded size. what is `rows`, `best` (the n best chunks
    of each slot and some more, for a ranking that follows) or `totals` (slot_id, topic, n, total, best).
    """
    asked = slots.select("slot_id", F.lower("text").alias("text")).orderBy("slot_id").collect()
    slot_ids, slot_type, chunk_type = [r.slot_id for r in asked], slots.schema["slot_id"].dataType, chunks.schema["chunk_id"].dataType
    slot_row, slot_place, slot_times, grams_of_slots = counted([r.text for r in asked])
    slot_df = np.bincount(slot_place, minlength=len(grams_of_slots))

    rows = chunks.select("topic", "chunk_id", F.lower("text").alias("text"))
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("signs"))
    parts = F.greatest(F.ceil(F.col("n") / part_rows), F.ceil(F.col("signs") / PART_SIGNS)).cast("int")
    sizes = sizes.select("topic", (F.col("n") + len(slot_ids)).alias("n"), parts.alias("parts"))
    extra = chunks.sparkSession.createDataFrame(pd.DataFrame({"gram": grams_of_slots, "more": slot_df.astype(np.int64)}), "gram long, more long")
    # grams that only slots have are counted too
    own = sizes.select("topic").join(extra.select("gram", F.col("more").alias("df")))
    df = _document_frequencies(rows).unionByName(own).groupBy("topic", "gram").agg(F.sum("df").alias("df")).join(sizes, "topic")
    idf = df.select("topic", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "gram", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))

    def weigh(chunk_table: pa.Table, idf_table: pa.Table) -> pa.Table:
        sink = Sink(what, slot_ids, slot_type, chunk_type, n)
        if not chunk_table.num_rows or not len(grams_of_slots):
            return sink.table(None)
        order = np.argsort(known := idf_table["gram"].to_numpy(), kind="stable")
        known, idf = known[order], idf_table["idf"].to_numpy()[order]
        slot_weight = _weights(slot_place, slot_times, idf[np.searchsorted(known, grams_of_slots)])
        slot_norm = _norms(slot_row, slot_weight, len(slot_ids))
        table_ = np.zeros((len(grams_of_slots), len(slot_ids)), np.int64)
        table_[slot_place, slot_row] = slot_weight
        ids = chunk_table["chunk_id"].combine_chunks()
        for a, texts in _slices(chunk_table["text"].combine_chunks()):
            row, place, times, mine = counted(texts)
            weight = _weights(place, times, idf[np.searchsorted(known, mine)])
            norm = _norms(row, weight, len(texts))
            at = np.minimum(np.searchsorted(grams_of_slots, mine), len(grams_of_slots) - 1)
            shared = grams_of_slots[at] == mine
            both = np.flatnonzero(shared[place])
            ends = np.searchsorted(row[both], np.arange(len(texts) + 1))
            column, weight = at[place[both]], weight[both]
            large = len(weight) and int(weight.max()) * int(table_.max(initial=0)) * int(np.diff(ends).max()) >= 1 << 62
            dot = np.zeros((len(texts), len(slot_ids)))
            for i in range(len(texts)):
                span = slice(ends[i], ends[i + 1])
                # whole numbers, row by row: sums are exact, and no library's threads are started in a task
                dot[i] = (weight[span].astype(object)[:, None] * table_[column[span]]).sum(axis=0) if large else weight[span] @ table_[column[span]]
            with np.errstate(invalid="ignore", divide="ignore"):
                value = dot / (slot_norm * norm[:, None])
            hit = value > least
            sink.add(ids.slice(a, len(texts)), np.floor(np.where(hit, value, 0) * 1e6 + 0.5).astype(np.int64), hit)
        return sink.table(chunk_table["topic"][0].as_py())

    both = dealt(rows, sizes).groupBy("topic", "part").cogroup(idf.groupBy("topic", "part"))
    return merged(both.applyInArrow(weigh, schema(what, slots, chunks)), what)
