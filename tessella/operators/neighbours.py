"""Nearest vectors by cosine, from an inverted file: vectors lie in cells around centroids, and a query looks into few of them.

The centroids are fitted on the SAMPLE vectors of least hash of their ids; every vector is put into a cell. A cell is dealt
to parts of about PART vectors, so that a task holds a bounded part of a cell, with the queries that look into it; each part
gives the k best of each of its queries, and these are merged. A look into some cells finds most of the nearest vectors. An
exact search then looks on where it has to: by the angle between a query and a centroid, less that between the centroid and
the vector of the cell that lies farthest from it, no vector of a cell can be nearer, so cells beyond the k-th best found are left out.

Vectors that are null, hold a null or non-finite entry, or have another length than the fitted ones are in no cell; vectors
of length zero are like nothing (cosine 0). Equal vectors are all found; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import cut

SAMPLE, CELLS, MEMBERS, ROUNDS = 20_000, 64, 32, 12
#: The share of the cells that a search looks into, if no number of them is given. Vectors without clusters, as the given ones,
#: need over half of the cells for nine of ten neighbours; clustered ones need few.
PROBES = 0.65
#: Vectors, and queries, that a task holds of a cell, on average.
PART, ASKED = 50_000, 2_000
#: Vectors that all_pairs holds against ASKED queries at a time, on average, and pairs of a batch that it gives.
HELD, PAIRS = 1_000, 1 << 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _sound(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(sound & (F.size(vector) > 0)).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def fit(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length, by a few rounds of spherical k-means over a bounded sample; none for no vectors.

    Unless cells says otherwise there are CELLS, or fewer, so that MEMBERS vectors of the sample lie in each.
    """
    rows = _sound(vectors, ident, vector).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    lengths = np.array([len(r.v) for r in rows])
    width = int(np.bincount(lengths).argmax())
    x = _unit(np.array([r.v for r in rows if len(r.v) == width]))
    centroids = x[np.linspace(0, len(x) - 1, min(cells or min(CELLS, -(-len(x) // MEMBERS)), len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        kept = np.bincount(near, minlength=len(centroids)) > 0
        centroids = np.where(kept[:, None], _unit(sums), centroids)
    return centroids


def _with_cells(rows: DataFrame, centroids: np.ndarray, probes: int, broadcast) -> DataFrame:
    """Rows (id, v, cell, angle): the nearest cells of each vector (id, v), and the angle to their centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(broadcast.value)
        width, k = own.shape[1], min(probes, len(own))
        for batch in batches:
            fit_ = pc.equal(pc.list_value_length(batch.column(1)), width)
            batch = batch.filter(fit_)
            if not len(batch):
                continue
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            like = x @ own.T
            near = np.argsort(-like, axis=1, kind="stable")[:, :k]
            at = pa.array(np.repeat(np.arange(len(x)), k))
            angle = np.arccos(np.clip(np.take_along_axis(like, near, 1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32)), pa.array(angle.ravel())], names=["id", "v", "cell", "angle"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, angle double")


def _looked(asked: DataFrame, held: DataFrame, k: int, itself: bool) -> DataFrame:
    """Rows (query, id, like): the k best of each query (id, v, cell) in each part of the cells that it looks into."""
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    dealt = F.sequence(F.lit(0), F.col("groups") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    place = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) AS int)")
    vectors = held.join(sizes, "cell").join(many, "cell").select("cell", place("parts").alias("part"), F.explode(dealt[0]).alias("group"), "id", "v")
    queries = asked.join(sizes, "cell").join(many, "cell").select("cell", F.explode(dealt[1]).alias("part"), place("groups").alias("group"), "id", "v")

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "like": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        q, x = matrix(left), _unit(matrix(right))
        asked_, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, out = x[order], ids[order], []
        for name, row in zip(asked_.tolist(), _unit(q), strict=True):
            # row by row, so that equal vectors are alike to the last bit
            like = (x * row).sum(1)
            if not itself:
                like[ids == name] = -np.inf
            top = np.argsort(-like, kind="stable")[:k]
            top = top[like[top] > -np.inf]
            out.append((np.full(len(top), name), ids[top], like[top]))
        return pa.table({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query", "id", "like"))})

    return queries.groupBy("cell", "part", "group").cogroup(vectors.groupBy("cell", "part", "group")).applyInArrow(best, "query long, id long, like double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("like", 9)), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ident: str = "vec_id", vector: str = "embedding", probes: int | None = None, exact: bool = False, itself: bool = False, centroids: np.ndarray | None = None) -> DataFrame:
    """Rows (query, id, like, place): for each of the queries the k vectors of largest cosine; itself: a query's own id counts."""
    spark = vectors.sparkSession
    centroids = fit(vectors, ident, vector) if centroids is None else centroids
    if not len(centroids):
        return spark.createDataFrame([], "query long, id long, like double, place int")
    probes = probes or max(1, round(PROBES * len(centroids)))
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(centroids))
    held = _with_cells(_sound(vectors, ident, vector), centroids, 1, packed).transform(cut)
    asked = _with_cells(_sound(queries, ident, vector), centroids, len(centroids) if exact else probes, packed)
    if not exact:
        return _merged(_looked(asked, held, k, itself), k)
    asked = asked.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("angle", "cell"))).transform(cut)
    first = _merged(_looked(asked.where(F.col("rank") <= probes), held, k, itself), k).transform(cut)
    reach = held.groupBy("cell").agg(F.max("angle").alias("reach"))
    least = first.where(F.col("place") == k).select(F.col("query").alias("id"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("like") - 1e-9))).alias("least"))
    open_ = asked.where(F.col("rank") > probes).join(reach, "cell").join(least, "id", "left")
    open_ = open_.where(F.coalesce(F.col("angle") - F.col("reach") <= F.col("least") + 1e-9, F.lit(True)))
    return _merged(first.drop("place").unionByName(_looked(open_.select("id", "v", "cell", "angle"), held, k, itself)), k)


def _by_width(rows: pa.Table) -> dict:
    """Ids, vectors and their lengths, no less than 1e-9, by the number of entries; those without a vector by -1."""
    rows, found = rows.combine_chunks(), {}
    width = pc.fill_null(pc.list_value_length(rows.column("v")), -1).to_numpy()
    for w in np.unique(width).tolist():
        own = rows.filter(pa.array(width == w))
        x = pc.list_flatten(own.column("v")).to_numpy().reshape(len(own), max(w, 0))
        found[w] = own.column("id").to_numpy(), x, np.maximum(np.sqrt(_dots(x, x)), 1e-9)
    return found


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot product of each row, its terms added one by one, so that it is the same whoever adds them."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _whole(q: np.ndarray, qn: np.ndarray, x: np.ndarray, xn: np.ndarray, scale: int) -> np.ndarray:
    """floor(cosine * scale + 0.5) of each pair, by one product of matrices; what lies close to a whole number is added up anew in order."""
    long = np.iinfo(np.int64)
    with np.errstate(all="ignore"):
        value = q @ x.T / (qn[:, None] * xn) * scale + 0.5
        at, to = np.nonzero(~(np.abs(value - np.rint(value)) > 1e-15 * scale * (q.shape[1] + 8)))
        for k in range(0, len(at), PAIRS):
            i, j = at[k : k + PAIRS], to[k : k + PAIRS]
            value[i, j] = _dots(q[i], x[j]) / (qn[i] * xn[j]) * scale + 0.5
        value = np.floor(np.nan_to_num(value, nan=0.0))
        whole = np.clip(value, -(2.0**62), 2.0**62).astype(np.int64)
    return np.where(value >= 2.0**63, long.max, np.where(value <= -(2.0**63), long.min, whole))


def all_pairs(vectors: DataFrame, queries: DataFrame, scale: int = 10_000, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query, id, like): floor(cosine * scale + 0.5) of every query and every vector of another id, as many as their product.

    Vectors and queries are dealt to blocks by their ids, and each block of one meets each of the other in a task, which holds
    two blocks and gives batches. Lengths are no less than 1e-9; like is null if a vector is null, holds a null, or they differ in length.
    """
    parts, groups = (max(1, -(-rows.count() // most)) for rows, most in ((vectors, HELD), (queries, ASKED)))
    tasks = min(4 * parts * groups, 32 * vectors.sparkSession.sparkContext.defaultParallelism)
    key = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) AS int)")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(rows: DataFrame, part, group) -> DataFrame:
        v = F.when(F.forall(vector, lambda c: c.isNotNull()), F.col(vector).cast("array<double>"))
        rows = rows.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL")
        return rows.withColumn("part", part).withColumn("group", group).repartition(tasks, "part", "group").groupBy("part", "group")

    def like(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema({"query": pa.int64(), "id": pa.int64(), "like": pa.int64()})
        batches, held = [], _by_width(right)
        for width, (asked, q, qn) in _by_width(left).items():
            for other, (ids, x, xn) in held.items():
                step = max(1, PAIRS // len(ids))
                for k in range(0, len(asked), step):
                    own = asked[k : k + step]
                    pair = [pa.array(np.repeat(own, len(ids))), pa.array(np.tile(ids, len(own)))]
                    if width == other >= 0:
                        pair.append(pa.array(_whole(q[k : k + step], qn[k : k + step], x, xn, scale).ravel()))
                    else:
                        pair.append(pa.nulls(len(pair[0]), pa.int64()))
                    batch = pa.RecordBatch.from_arrays(pair, schema=shape)
                    batches.append(batch.filter(pc.not_equal(pair[0], pair[1])) if np.isin(own, ids).any() else batch)
        return pa.Table.from_batches(batches, shape)

    return dealt(queries, each(parts), key(groups)).cogroup(dealt(vectors, key(parts), each(groups))).applyInArrow(like, "query long, id long, like long")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours that were found."""
    both = true.select("query", "id").join(found.select("query", "id"), ["query", "id"], "left_semi").count()
    return both / max(1, true.count())
