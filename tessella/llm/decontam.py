"""Operator 5: benchmark decontamination as a prefix-filtered set join.

A benchmark window (10 consecutive item words, or the whole of a shorter item) is contained in a document
only if all of its shingles are, so its rarest shingle, by the number of documents that hold it, is a
sufficient prefix. Documents probe an index of those prefix shingles; the place of the shingle in its window
bounds where the window can lie, and the words of each surviving place are compared exactly.

The benchmark is worked off in blocks of bounded size, each broadcast; documents are never shuffled.
Null or wordless texts have no words and are clean; a wordless item has no window; repeated rows give
repeated results; other columns are not read by decontaminate() and pass through clean() unchanged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SpanHash, by_value, cut, fresh, slices, table, utf8
from tessella.llm.words import Words

WINDOW, SHINGLE = 10, 5
#: Bytes of benchmark text that one block broadcasts at most (a longer single item stands alone).
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22


class Windows:
    """The distinct windows of a block of items, and their shingles by size."""

    def __init__(self, items: list[tuple[str, str]], hasher: SpanHash) -> None:
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets, hasher)
        self.items: list[set[str]] = []
        self.text: list[bytes] = []
        at: dict[bytes, int] = {}
        start, size = [], []
        for (item, _), a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for i in range(a, max(a + 1, b - WINDOW + 1) if b > a else a):
                end = min(b, i + WINDOW)
                text = words.joined(i, end)
                if text not in at:
                    at[text] = len(self.text)
                    self.text.append(text)
                    self.items.append(set())
                    start.append(i)
                    size.append(end - i)
                self.items[at[text]].add(item)
        self.size = np.array(size, np.int64)
        #: (size of shingle) -> its hash, window and place in the window
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for s in sorted(set(np.minimum(self.size, SHINGLE).tolist())):
            window = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            hashes = words.shingles(s)
            many = self.size[window] - s + 1
            place = np.concatenate([np.arange(m) for m in many]) if len(many) else np.zeros(0, np.int64)
            window = np.repeat(window, many)
            self.parts[s] = hashes[np.array(start)[window] + place], window, place

    def shingles(self) -> dict[int, np.ndarray]:
        return {s: np.unique(h) for s, (h, _, _) in self.parts.items()}

    def index(self, counts: dict[tuple[int, int], int]) -> "Index":
        """The rarest shingle of each window; ties go to the smaller hash, then to the earlier place."""
        chosen = {}
        for s, (h, window, place) in self.parts.items():
            rarity = np.array([counts.get((s, int(x)), 0) for x in h.view(np.int64)], np.int64)
            order = np.lexsort((place, h, rarity, window))
            first = order[np.unique(window[order], return_index=True)[1]]
            first = first[np.argsort(h[first], kind="stable")]
            chosen[s] = h[first], window[first], place[first]
        return Index(chosen, self.size, self.text, self.items)


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def _probe(hashes: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of hashes that are among the sorted keys, with the range of keys that each equals."""
    rows = np.flatnonzero(sieve[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    a, b = np.searchsorted(keys, hashes[rows], "left"), np.searchsorted(keys, hashes[rows], "right")
    hit = b > a
    return rows[hit], a[hit], b[hit]


class Index:
    def __init__(self, chosen: dict, size: np.ndarray, text: list[bytes], items: list[set[str]]) -> None:
        self.chosen, self.size, self.text, self.items = chosen, size, text, items
        self.sieves: dict[int, np.ndarray] = {}

    def find(self, words: Words) -> list[tuple[int, int, int]]:
        """(text, first word, window) of each occurrence."""
        found = []
        for s, (keys, window, place) in self.chosen.items():
            sieve = self.sieves.setdefault(s, _sieve(keys))
            rows, a, b = _probe(words.shingles(s), keys, sieve)
            many = b - a
            rows = np.repeat(rows, many)
            entry = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            start = rows - place[entry]
            text, wide = words.text[rows], self.size[window[entry]]
            fits = (start >= words.first[text]) & (start + wide <= words.first[text + 1])
            for t, i, w, n in zip(text[fits].tolist(), start[fits].tolist(), window[entry[fits]].tolist(), wide[fits].tolist(), strict=True):
                if words.joined(i, i + n) == self.text[w]:
                    found.append((t, i, w))
        return found


def _frequencies(docs: DataFrame, text_col: str, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """In how many documents each benchmark shingle stands; as many rows at most as the block has shingles."""
    shared = by_value(docs.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, keys = SpanHash(), shared()
        sieves = {s: _sieve(k) for s, k in keys.items()}
        total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                for s, k in keys.items():
                    rows, at, _ = _probe(words.shingles(s), k, sieves[s])
                    rows, at = rows[ok := words.within(s)[rows]], at[ok]
                    pair = np.unique(words.text[rows] * len(k) + at)
                    total[s] += np.bincount(pair % len(k), minlength=len(k))
        for s, k in keys.items():
            hit = np.flatnonzero(total[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), s, np.int32)), pa.array(k[hit].view(np.int64)), pa.array(total[s][hit])], names=["size", "shingle", "n"])

    counted = docs.select(text_col).mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    return {(r.size, r.shingle): r.n for r in counted.toLocalIterator()}


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of about BLOCK_BYTES, one at a time."""
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, r.text) for r in part.collect()]


def contamination(docs: DataFrame, items: DataFrame, names: tuple[str, str, str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with three more columns of the given names: the number of words, the hit runs (first and past-last
    word, in turn) and the ids of the items that hit. Runs of several blocks are joined row by row.
    """
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.array().cast("array<long>").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    column = docs.columns.index(text_col)
    blocks = 0
    for block in chain(_blocks(items, item_id, item_text), [[]]):
        if blocks and not block:
            break
        if blocks:
            out = cut(out)
        blocks += 1
        windows = Windows(block, SpanHash())
        shared = by_value(docs.sparkSession, windows.index(_frequencies(docs, text_col, windows.shingles()) if windows.text else {}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            hasher, index = SpanHash(), shared()
            for batch in batches:
                data, offsets = utf8(batch.column(column))
                n = batch.num_columns
                for a, b in slices(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    hit: dict[int, set[str]] = defaultdict(set)
                    for t, i, w in sorted(index.find(words)):
                        i -= int(words.first[t])
                        end = i + int(index.size[w])
                        hit[t] |= index.items[w]
                        if runs[t] and runs[t][-1][1] >= i:
                            runs[t][-1] = runs[t][-1][0], max(end, runs[t][-1][1])
                        else:
                            runs[t].append((i, end))
                    old_runs, old_items = batch.column(n - 2).slice(a, b - a), batch.column(n - 1).slice(a, b - a)
                    all_runs, all_items = [], []
                    for t, (r, x) in enumerate(zip(old_runs.to_pylist(), old_items.to_pylist(), strict=True)):
                        all_runs.append(_union(r, runs.get(t, [])))
                        all_items.append(sorted(hit.get(t, set()) | set(x)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(n - 3)), pa.array(np.diff(words.first)), pa.array(all_runs, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string()))], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def _union(flat: list[int], more: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(flat[::2], flat[1::2], strict=True), *more]):
        if out and out[-1] >= a:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items (ids in order), contaminated."""
    found = contamination(docs.select(id_col, text_col), items, ("_n_words", "_runs", "_items"), text_col)
    hit = F.aggregate(F.transform("_runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(id_col, F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), (F.size("_runs") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    names = fresh(docs, "_n_words", "_runs", "_items")
    return contamination(docs, items, names, text_col).where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
dwin AS (
  SELECT row_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM dw, (SELECT DISTINCT size FROM bwin) s, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
hits AS (SELECT row_id, i, d.size, item_id FROM dwin d JOIN bwin b ON d.size = b.size AND d.win = b.win),
hit_words AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS r(k) GROUP BY row_id),
hit_items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hits) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""
