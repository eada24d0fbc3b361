"""Operator 3: language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a blank, and each run of 1 to 4 signs that does not lie
in blanks only is hashed to one of BUCKETS rows of an embedding table. The mean of the rows goes through a
linear layer and a softmax. Both are trained by stochastic gradient descent in numpy on the driver, from at
most PER_LANGUAGE documents of each language (those of least hash of their id, MAX_ROWS in all). A temperature
fitted to every fifth of them calibrates the scores, and their error rate gives the score below which a
prediction is marked rejected.

Texts that are null or have no letter are `und` with score 0. Without any learned language all texts are `und`.
Documents of null language are never learned from; repeated rows get equal predictions; other columns are not
read. For prediction the embedding and the linear layer are multiplied out: averaging is linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import by_value, fold, slices, table, utf8

BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
PER_LANGUAGE, MAX_ROWS, EPOCHS, BATCH, RATE = 500, 6_000, 8, 32, 0.5
#: Parts of a language whose least rows are found apart.
PARTS = 64
#: Share of wrong answers that an accepted prediction may have on the calibration rows.
ERROR = 0.01
UNDETERMINED = "und"


def letter_classes() -> np.ndarray:
    """Per code point: whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: bytes, letters: np.ndarray) -> np.ndarray:
    """Buckets of all subwords of a text; empty if it has no letter."""
    points = np.frombuffer(text.decode("utf-8").lower().encode("utf-32-le"), np.uint32)
    inside = letters[points]
    if not inside.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[0], np.where(inside, points, 0), [0]]).astype(np.uint32)
    inside = points != 0
    out, hashed, some = [], np.zeros(len(points), np.uint32), np.zeros(len(points), bool)
    for order in range(1, max(ORDERS) + 1):
        m = len(points) - order + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint32(0x01000193) + points[order - 1 :] + np.uint32(order)
        some = some[:m] | inside[order - 1 :]
        if order in ORDERS:
            mixed = hashed ^ (hashed >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(32 - 15))[some])
    return np.concatenate(out).astype(np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Weights of each bucket for each language, a bias, a temperature and the least accepted score."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, accept: float) -> None:
        self.names, self.weights, self.bias, self.temperature, self.accept = names, weights, bias, temperature, accept

    def predict(self, texts: list[bytes], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = grams(text, letters)
            if not len(found) or not self.names:
                names.append(UNDETERMINED)
                continue
            total = np.bincount(found, minlength=BUCKETS) @ self.weights if len(found) > BUCKETS else self.weights[found].sum(axis=0, dtype=np.float64)
            p = _softmax((total / len(found) + self.bias)[None] / self.temperature)[0]
            names.append(self.names[int(p.argmax())])
            scores[i] = p.max()
        return names, scores


def _examples(texts: list[bytes], names: list[str], classes: list[str], letters: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Whole texts and, so that short texts are learned too, their first lines and stretches of 12 words."""
    x, y = [], []
    for text, name in zip(texts, names, strict=True):
        words = text.split()
        parts = [text, *text.split(b"\n")[1:3], *(b" ".join(words[i : i + 12]) for i in range(0, min(len(words), 96), 48))]
        for part in parts:
            found = grams(part, letters)
            if len(found):
                x.append(found)
                y.append(classes.index(name))
    return x, np.array(y, np.int64)


def fit(texts: list[bytes], names: list[str], seed: int = 7) -> Model:
    classes = sorted(set(names))
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    letters, rng = letter_classes(), np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    x, y = _examples([t for t, h in zip(texts, held, strict=True) if not h], [n for n, h in zip(names, held, strict=True) if not h], classes, letters)
    embedding = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    linear, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    packed = [np.unique(g, return_counts=True) for g in x]
    sizes = [len(g) for g in x]
    steps, done = EPOCHS * -(-len(x) // BATCH), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // BATCH))):
            if not len(part):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            bucket = np.concatenate([packed[i][0] for i in part])
            share = np.concatenate([packed[i][1] / sizes[i] for i in part]).astype(np.float32)
            first = np.cumsum([0, *(len(packed[i][0]) for i in part[:-1])])
            hidden = np.add.reduceat(embedding[bucket] * share[:, None], first, axis=0)
            wrong = _softmax(hidden @ linear + bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            back = wrong @ linear.T
            linear -= rate * (hidden.T @ wrong) / 4
            bias -= rate * wrong.mean(axis=0)
            step = np.repeat(back, np.diff(np.append(first, len(bucket))), axis=0) * share[:, None]
            np.subtract.at(embedding, bucket, (rate * 40 * step).astype(np.float32))
    model = Model(classes, embedding @ linear, bias, 1.0, 0.0)
    _calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], [n for n, h in zip(names, held, strict=True) if h], letters)
    return model


def _calibrate(model: Model, texts: list[bytes], names: list[str], letters: np.ndarray) -> None:
    """The temperature of least log loss, then the least score from which on at most ERROR of the answers are wrong."""
    x, y = _examples(texts, names, model.names, letters)
    if not len(x):
        return
    raw = np.array([np.bincount(g, minlength=BUCKETS) @ model.weights / len(g) + model.bias for g in x])
    losses = [(-np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean(), t) for t in np.geomspace(0.1, 10, 41)]
    model.temperature = float(min(losses)[1])
    p = _softmax(raw / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= ERROR)
    model.accept = float(p.max(axis=1)[order[fine[-1]]]) if len(fine) else 1.0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Choose the rows by id and language alone, then fetch their texts: a bounded sample of whole documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    # the least of each language among the least of each of its parts, so no task meets a whole language
    chosen = known.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(PARTS)).alias("_part"))
    for keys in (("lang", "_part"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("_n", rank).where(F.col("_n") <= per_language)
    chosen = chosen.groupBy("doc_id").agg(F.min("lang").alias("_lang"), F.min("_n").alias("_n")).orderBy("_n", *order).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "_lang")), "doc_id")
    # of repeated ids one text, the least, is learned from
    rows = rows.groupBy("doc_id", "_lang").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    data, offsets = utf8(rows["text"])
    raw, at = data.tobytes(), offsets.tolist()
    return fit([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows["_lang"].to_pylist())


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected) of all documents."""
    shared = by_value(docs.sparkSession, (model, letter_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = shared()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                raw, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
                names, scores = model.predict([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], letters)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores), pa.array(scores < model.accept)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, train(docs))
