"""Operator 2: quality classifier, histogram gradient-boosted trees over document statistics.

The statistics of a text are sums over its bytes and words, taken by array operations on whole texts. The
trees are fitted here, on the driver, to at most TRAIN_ROWS labelled rows (those of least hash of their id,
so the same rows each time, from all sources), and stand as flat arrays (feature, threshold, leaf value by
tree and node of a full binary tree) that a task walks for all of its rows at once.

Null and empty texts are scored like a text without words. A label table without usable rows, or with one
class only, gives the share of label 1 (0.5 without rows) as every score. Repeated ids in either table are
allowed: each document row is scored, and a repeated label counts once (the least). Labels, language, source
and id are never inputs of a score; other columns are not read by quality_scores() and pass through keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SpanHash, by_value, fold, slices, table, utf8

TRAIN_ROWS, BINS, DEPTH, TREES, RATE, L2, MIN_CHILD = 20_000, 64, 4, 80, 0.15, 1.0, 8
#: A document is kept from this score on.
THRESHOLD = 0.3

_BLANK, _NEWLINE, _LOWER, _UPPER, _DIGIT, _WIDE, _STOP, _BANG, _BAR, _PAIR, _MARK, _OTHER = range(12)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[128:] = _WIDE
    for chars, kind in ((b" \t\r\f\v", _BLANK), (b"\n", _NEWLINE), (b".,;:?'-", _STOP), (b"!", _BANG), (b"|", _BAR), (b"()[]{}<>\"=/\\", _PAIR), (b"#$%&*@^~+_", _MARK)):
        kinds[list(chars)] = kind
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    return kinds


BYTE_KINDS = _byte_kinds()


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values from at[t] to at[t + 1]."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """A row of features for each text; rates are by bytes, words or lines, so they do not grow with the text."""
    n, texts = len(data), len(offsets) - 1
    kind = BYTE_KINDS[data]
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(texts), np.diff(offsets))
    shares = np.bincount(doc * 12 + kind, minlength=texts * 12).reshape(texts, 12) / some[:, None]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind > _NEWLINE
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here[:n] & (~before[:n] | cut[:n]))
    end = np.flatnonzero(before & (~here | cut))
    first = np.searchsorted(start, offsets)
    words = np.diff(first).astype(np.float64)
    some_words = np.maximum(words, 1)
    of = np.repeat(np.arange(texts), np.diff(first))
    value = hasher.of(hasher.totals(data), start, end)
    length = (end - start).astype(np.float64)
    mean = _per_text(length, first) / some_words
    spread = np.sqrt(np.maximum(_per_text(length**2, first) / some_words - mean**2, 0))
    same = np.zeros(len(start))
    same[1:] = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
    again = np.zeros(len(start))
    for gap in range(2, 9):
        again[gap:] += (value[gap:] == value[:-gap]) & (of[gap:] == of[:-gap])
    key = np.unique(value ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
    distinct = np.bincount(of[key[1]], minlength=texts) / some_words
    most = np.zeros(texts)
    np.maximum.at(most, of[key[1]], key[2])
    head, tail = kind[start], kind[end - 1]
    marked = _per_text((tail >= _BANG) & (tail <= _MARK) & (tail != _PAIR), first) / some_words
    capital = _per_text(head == _UPPER, first) / some_words
    stops = _per_text(tail == _STOP, first) / some_words
    loud = _per_text((head == _UPPER) & (kind[np.minimum(start + 1, max(n - 1, 0))] == _UPPER), first) / some_words
    lone = _per_text((length == 1) & (head >= _STOP), first) / some_words
    lines = shares[:, _NEWLINE] * size + 1
    columns = [np.log1p(size), np.log1p(words), mean, spread, _per_text(same, first) / some_words, _per_text(again, first) / some_words, distinct, most / some_words, marked, capital, stops, loud, lone, np.log1p(words / lines), np.log1p(lines)]
    return np.column_stack([shares, *columns]).astype(np.float32)


class Forest:
    """Trees as arrays: feature and bin limit of each inner node, value of each leaf."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray, base: float) -> None:
        self.edges, self.feature, self.limit, self.leaf, self.base = edges, feature, limit, leaf, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), int)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > limit[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting with logistic loss on at most BINS quantile bins of each feature."""
    none = np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1))
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Forest([], *none, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)])
    flat = binned + np.arange(x.shape[1]) * BINS
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, inner, leaves = np.full(len(y), base), 2**DEPTH - 1, 2**DEPTH
    features, limits, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        for level in range(DEPTH):
            low, wide = 2**level - 1, 2**level
            cells = ((node - low)[:, None] * flat.shape[1] * BINS + flat).ravel()
            shape = wide, flat.shape[1], BINS
            g, h, c = (np.bincount(cells, np.repeat(v, flat.shape[1]), wide * flat.shape[1] * BINS).reshape(shape).cumsum(axis=2) for v in (gradient, hessian, np.ones(len(y))))
            gain = g**2 / (h + L2) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + L2) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + L2)
            gain[(c < MIN_CHILD) | (c[:, :, -1:] - c < MIN_CHILD)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            use = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            feature[low : low + wide] = best // BINS
            limit[low : low + wide] = np.where(use, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > limit[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, gradient, leaves) / (np.bincount(at, hessian, leaves) + L2)
        raw += leaf[at]
        features.append(feature)
        limits.append(limit)
        values.append(leaf)
    return Forest(edges, np.array(features), np.array(limits), np.array(values), base)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """Fit to labelled documents whose fold is not 0; at most train_rows of them reach the driver, as features."""
    order = F.xxhash64("doc_id"), F.col("doc_id")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("_y")).orderBy(*order).limit(train_rows)
    hasher = SpanHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())), batch.column(2).slice(a, b - a)], names=["doc_id", "x", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(run, f"doc_id {kind}, x array<float>, y double")
    got = rows.orderBy(F.xxhash64("doc_id"), F.hash("x"), "doc_id").limit(train_rows).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, 1), np.float32), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()).astype(np.float32), got["y"].to_numpy())


def scorer(spark: SparkSession, forest: Forest):
    """A column function: text to score."""
    shared = by_value(spark, forest)

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, forest = SpanHash(), shared()
        for column in columns:
            data, offsets = utf8(column)
            parts = [forest.scores(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)) for a, b in slices(offsets)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    score.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of all documents."""
    score = scorer(docs.sparkSession, train(docs, labels))
    scored = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(predicted(score(F.coalesce("text", F.lit("")))) == 1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
