"""Operator 12: PCA whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become whole numbers (floor(256 * c)), so the scatter of n * x - S over the distinct vectors (n of them, with
sums S) is a matrix of whole numbers. Its bound follows from n, S and the extremes of each dimension, and so many primes
are taken that their product is over twice the bound. Each partition multiplies its centred rows modulo each prime;
symmetric residues are so small that a block's product is exact in doubles. Residues are summed by Spark, rebuilt by
Chinese remaindering, divided by n cubed with one rounding, and decomposed in double precision on the driver, which
holds matrices of dimension times dimension only.

A vector that is null, empty, or holds a null or non-finite entry gives no rows, and neither does one of another length
than most vectors have (ties: the longer), as it is no point of their space. Repeated rows are returned each, and count
once in the fit list. Entries beyond the range of a long are held at its ends. Along components without variance (an
eigenvalue of no more than rounding) whitened is null, and without any variance explained and identity_error are too.
A deviation beyond the range of a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_value, table, write_and_read

SCALE, COMPONENTS = 256, 4
#: Primes are below 2 ** BITS; products of BLOCK symmetric residues then sum to less than 2 ** 53.
BITS, BLOCK = 22, 2048


def whole(vector: Column) -> Column:
    """The entries of a vector as whole numbers; null if the vector is null or holds a null or non-finite entry."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** BITS whose product is over the bound."""
    out, p = [], (1 << BITS) - 1
    while prod(out) <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def extremes(fit: DataFrame, width: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows of the fit list, and the sum, least and largest entry of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0), width)
            # sums of halves: neither overflows
            rows = [np.arange(width), np.full(width, len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["at", "n", "high", "low", "least", "most"])

    found = fit.select("x").mapInArrow(run, "at long, n long, high long, low long, least long, most long")
    rows = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()
    return rows[0].n if rows else 0, [(r.high << 32) + r.low for r in rows], [r.least for r in rows], [r.most for r in rows]


def residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n * x - S modulo p, as doubles between -p / 2 and p / 2."""
    r = (x % p * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return (r - p * (r > p // 2)).astype(np.float64)


def scatter(fit: DataFrame, width: int, n: int, sums: list[int], bound: int) -> np.ndarray:
    """The sum of (n * x - S)(n * x - S)' over the fit list, as whole numbers of Python."""
    moduli = primes(2 * bound)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), width, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for a in range(0, len(x), BLOCK):
                for k, p in enumerate(moduli):
                    r = residues(x[a : a + BLOCK], n, sums, p)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        if total.any():
            cells = total[:, upper[0], upper[1]].T
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(list(cells), pa.list_(pa.int64()))], names=["cell", "residues"])

    parts = fit.select("x").mapInArrow(run, "cell long, residues array<long>")
    rows = parts.groupBy("cell").agg(F.array(*[F.sum(F.col("residues")[k]) for k in range(len(moduli))]).alias("residues")).collect()
    out = np.zeros((width, width), object)
    product = prod(moduli)
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    for row in rows:
        value = sum(int(r) % p * w for r, p, w in zip(row.residues, moduli, weights, strict=True)) % product
        i, j = upper[0][row.cell], upper[1][row.cell]
        out[i, j] = out[j, i] = value - product if 2 * value > product else value
    return out


class Whitening:
    """What the fit list gives: size, sums, and by falling eigenvalue the eigenvalues, their shares and the eigenvectors (columns)."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int) -> None:
        self.n, self.sums, cube = n, sums, n**3
        values, vectors = np.linalg.eigh(np.array([[int(v) / cube for v in row] for row in matrix], np.float64))
        trace = sum(int(matrix[i, i]) for i in range(len(sums))) / cube
        k = min(components, len(sums))
        self.values, self.vectors = values[::-1][:k], np.ascontiguousarray(vectors[:, ::-1][:, :k])
        self.varies = self.values > len(sums) * np.finfo(np.float64).eps * max(values[-1], 0.0)
        self.explained = [float(v / trace) if trace else None for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on the components, over the root of their eigenvalues; NaN along components without variance."""
        centred = x.astype(np.float64) - np.array([s / self.n for s in self.sums])
        # row by row, so that equal rows give equal values wherever they stand in a batch
        projected = np.stack([(centred * v).sum(1) for v in self.vectors.T], 1)
        return projected / np.sqrt(np.where(self.varies, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2 of each row, exactly."""
        reach = max([abs(s) for s in self.sums] + [self.n * int(abs(v)) for v in (x.min(), x.max())])
        kind = np.int64 if len(self.sums) * (2 * reach) ** 2 < 1 << 63 else object
        centred = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [v if v < 1 << 63 else None for v in map(int, (centred * centred).sum(1))]


def _identity_error(fit: DataFrame, width: int, model: Whitening) -> float | None:
    """The largest entry, without sign, of the covariance of the whitened fit list minus the identity."""
    at = [c for c, varies in enumerate(model.varies) if varies]
    if not at:
        return None
    get = by_value(fit.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            if len(batch):
                w = own.whitened(_matrix(batch.column(0), width))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in at], names=[f"w{c}" for c in at])

    rows = fit.select("x").mapInArrow(run, ", ".join(f"w{c} double" for c in at))
    pairs = [(i, j) for i in at for j in at if i <= j]
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"v{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (id_col, component, n, deviation, whitened, explained, identity_error) for each usable vector and component."""
    spark = rows.sparkSession
    found = rows.select(F.col(id_col).alias("id"), whole(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = found.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    width = lengths.width
    found = found.where(F.size("x") == width)
    fit = write_and_read(found.select("x").distinct())
    n, sums, least, most = extremes(fit, width)
    reach = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, least, most, strict=True))
    model = Whitening(n, sums, scatter(fit, width, n, sums, n * reach * reach), components)
    error = _identity_error(fit, width, model)
    get = by_value(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        k = len(own.values)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), width)
            w = own.whitened(x)
            at = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(own.deviations(x), pa.int64())
            columns = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(at), own.n), pa.int64()), deviation.take(pa.array(at))]
            columns += [pa.array(w.ravel(), from_pandas=True), pa.array(own.explained * len(x), pa.float64()), pa.array([error] * len(at), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
