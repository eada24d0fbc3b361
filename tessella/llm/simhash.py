"""Operator 6: SimHash fingerprints and near-duplicate groups found with pivot distance tables.

Each fingerprint gets a row of Hamming distances to PIVOTS reference fingerprints. Two fingerprints that differ
in at most two bits agree in at least two of four 16-bit blocks (these are the join keys: pivots alone cannot
key an equi-join) and their distances to any pivot differ by at most two; pairs whose largest coordinate
difference is over two are discarded, and the rest are verified by counting differing bits.

Only distinct fingerprints are joined. A key with over HOT_KEY of them would give a square of pairs, so its
fingerprints are linked another way, also exact: two fingerprints within two bits share one within one bit of
both, so each is listed under itself and its 64 neighbours, and each such list is linked to its least member.

Null and wordless texts have fingerprint zero; fewer than three words are one shingle; repeated rows share a
group; a null id is kept, with a null component unless a copy has an id. Other columns are not read.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, fresh, slices, table, utf8
from tessella.llm.components import components

SHINGLE, DISTANCE, PIVOTS, HOT_KEY = 3, 2, 16, 256
#: For each byte, its bits in eight counters of eight bits, the highest bit in the lowest counter.
_SPREAD = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of hashes (from first[g] to first[g + 1]) the bits set in over half of them."""
    groups, sizes = len(first) - 1, np.diff(first)
    # counters of eight bits hold 255 rows: count in pieces of at most 255 rows of one group
    pieces = -(-sizes // 255)
    group = np.repeat(np.arange(groups), pieces)
    start = first[group] + 255 * (np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    counts = np.zeros((groups, 64), np.int64)
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        if len(start):
            part = np.add.reduceat(_SPREAD[rows[:, byte]], start).view(np.uint8).reshape(-1, 8)
            wide = np.zeros((len(part) + 1, 8), np.int64)
            np.cumsum(part, axis=0, out=wide[1:])
            ends = np.append(0, np.cumsum(pieces))
            counts[:, 8 * byte : 8 * byte + 8] = wide[ends[1:]] - wide[ends[:-1]]
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts; words are split at ASCII white space, A-Z lower-cased."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    first = [0]
    for text in texts:
        words = text.lower().split()
        if len(words) > SHINGLE:
            whole, at, n = b" ".join(words), 0, len(words)
            start, end = [0] * n, [0] * n
            for i, w in enumerate(map(len, words)):
                start[i] = at
                end[i] = at = at + w
                at += 1
            hashes += [digest(whole[a:b], 42) for a, b in zip(start, end[SHINGLE - 1 :], strict=False)]
        elif words:
            hashes.append(digest(b" ".join(words), 42))
        first.append(len(hashes))
    return majority(np.array(hashes, np.uint64), np.array(first))


def fingerprint(text: Column) -> Column:
    """The fingerprint of each whole text as a signed 64-bit integer."""

    def run(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        parts = [pa.array([], pa.int64())]
        for a, b in slices(offsets):
            whole, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
            parts.append(pa.array(simhash([whole[x:y] for x, y in pairwise(at)]).view(np.int64)))
        return pa.concat_arrays(parts)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")))


def _pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints drawn by a fixed rule: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 42) - (1 << 63) for i in range(n)]


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column) -> Column:
    """The six pairs of 16-bit blocks, each with its number."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(pairs)])


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) that verify, or stars over groups that are linked throughout; distinct has distinct fp."""
    table_ = distinct.select("fp", *[_differing(F.col("fp"), F.lit(p).cast("long")).cast("byte").alias(f"p{i}") for i, p in enumerate(_pivots())])
    keyed = table_.withColumn("key", F.explode(_keys(F.col("fp"))))
    sizes = keyed.groupBy("key").count().where("count > 1")
    keyed = cut(keyed.join(sizes, "key"))
    few, hot = keyed.where(F.col("count") <= HOT_KEY).drop("count"), keyed.where(F.col("count") > HOT_KEY).select("fp").distinct()
    a, b = few.alias("x"), few.alias("y")
    apart = F.greatest(*[F.abs(F.col(f"x.p{i}").cast("int") - F.col(f"y.p{i}").cast("int")) for i in range(PIVOTS)])
    near = a.join(b, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (apart <= DISTANCE) & (_differing(F.col("x.fp"), F.col("y.fp")) <= DISTANCE))
    pairs = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [0, *[1 << i for i in range(63)], -(1 << 63)]
    ball = hot.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = ball.groupBy("mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = ball.join(least, "mid").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def classes(found: DataFrame, id_col: str, grouped: DataFrame | None = None) -> DataFrame:
    """Rows (fp, root, component_id) of all distinct fingerprints of (id_col, fp), by components (node, component) or those of links()."""
    distinct = found.groupBy("fp").agg(F.min(id_col).alias("least"))
    grouped = components(links(distinct.select("fp"))) if grouped is None else grouped
    rows = distinct.join(grouped, distinct.fp == grouped.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return rows.join(rows.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, fp, component_id): the smallest id of all texts reachable over links."""
    found = cut(docs.select(id_col, fingerprint(F.col(text_col)).alias("fp")))
    return found.join(classes(found, id_col), "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: a row of the group's least id, or of none if none has one."""
    mark = fingerprint(F.col(text_col))
    found = cut(docs.select(F.col(id_col).alias("id"), mark.alias("fp")))
    return chosen(docs, found, classes(found, "id"), id_col, mark)


def chosen(docs: DataFrame, found: DataFrame, grouped: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of docs that one_of_each() keeps, by the fingerprints (id, fp) of all rows and their classes().

    A least id that one row has names its document by itself, so texts are shuffled once. Only rows whose least id
    is null or repeated are told apart by their fingerprints (mark, of docs) as well.
    """
    id_, fp, root, component = fresh(docs, "_id", "_fp", "_root", "_component")
    grouped = cut(grouped.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component)))
    rows = found.groupBy(F.col("id").alias(id_)).agg(F.count("*").alias("n"))
    least = grouped.select(F.col(component).alias(id_)).distinct()
    plain = least.join(rows.where((F.col("n") == 1) & F.col(id_).isNotNull()), id_, "left_semi")
    odd = cut(rows.where((F.col("n") > 1) | F.col(id_).isNull()).select(id_))
    kept = docs.join(plain, docs[id_col] == F.col(id_), "left_semi")
    if not odd.isEmpty():
        some = docs.join(odd, docs[id_col].eqNullSafe(F.col(id_)), "left_semi").withColumn(fp, mark)
        some = some.join(grouped, fp).where(F.col(id_col).eqNullSafe(F.col(component))).dropDuplicates([root])
        kept = kept.unionByName(some.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
