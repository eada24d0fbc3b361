"""Full-text search by an inverted index that is written once: a search reads the postings of its words, and works out of
these only the blocks that can hold one of the best.

The index is divided by chunks: a chunk belongs to a part by the low bits of the hash of its id, and a part of about PART_ROWS
chunks is indexed by one task, so texts are shuffled once and postings never. The postings of a term in df chunks of a part lie
in as many blocks as a power of two near df / BLOCK, each the chunks of some higher bits, so the blocks of all terms nest. A
block carries the largest weight that its term has in it. The weights of blocks sum to a bound of what any chunk in them can
score. A part works out the blocks of highest bounds first; the n-th best score found there rules out all blocks whose bound
is lower, and the rest is worked out in full, so nothing is missed. Each part gives its n best for each query.

Null texts are no part of the index, texts without words are never found, and words that no text holds find nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.text import STOP_WORDS, words
from tessella.operators.ranking import B, K1

#: Chunks of a block, chunks of a part on average, bits of the hash of a chunk, and bytes that a file keeps together.
BLOCK, PART_ROWS, SLOT_BITS, FILE_ROWS = 128, 16_384, 40, 8 << 20
#: Blocks that a query works out in a part before it knows what it can skip.
FIRST = 4
_RUNS, _STOP = re.compile("[a-zäöüß0-9]+").findall, frozenset(STOP_WORDS)


def _slot(chunk: str) -> Column:
    return F.xxhash64(chunk).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def _damped(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return np.maximum(tf + K1 * (1 - B + B * dl / max(avgdl, 1.0)), 1e-6)


def _shape(kind: str) -> str:
    """A row is a block of a term, or, without a term, the chunks of a part: ids in order, lengths and hashes."""
    return f"part int, term string, block long, blocks long, n long, most double, chunks array<int>, tf array<int>, ids array<{kind}>, dl array<int>, slots array<long>"


def _words(text: str) -> list[str]:
    """What functions.text.words gives, of a text in lower case."""
    return [w for w in _RUNS(text) if len(w) > 2 and w not in _STOP]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts a batch has, and how many words these have."""
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [len(batch)], "total": [sum(len(_words(t)) for t in batch.column(0).to_pylist())]})


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _tasks(spark: SparkSession, parts: int) -> int:
    return min(parts, 32 * spark.sparkContext.defaultParallelism)


def build(articles: DataFrame, path: str, block: int = BLOCK, part_rows: int = PART_ROWS) -> None:
    """Write the index of (chunk_id, text) under a path: postings by parts of the chunks, and the totals."""
    spark, texts = articles.sparkSession, articles.where("text IS NOT NULL")
    totals = texts.select(F.lower("text")).mapInArrow(_lengths, "n long, total long")
    totals = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("n", "total")])
    kind = articles.schema["chunk_id"].dataType
    totals = totals.select("n", (F.col("total") / F.greatest("n", F.lit(1.0))).alias("avgdl"), F.lit(kind.simpleString()).alias("kind"))
    totals = totals.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("n", F.lit(1.0)) / part_rows))).cast("int"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    total = spark.read.parquet(f"{path}/totals").first()
    avgdl, bits, id_type = total.avgdl, total.bits, to_arrow_type(kind)
    schema = pa.schema([("part", pa.int32()), ("term", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("n", pa.int64()), ("most", pa.float64()), *((c, pa.list_(t)) for c, t in (("chunks", pa.int32()), ("tf", pa.int32()), ("ids", id_type), ("dl", pa.int32()), ("slots", pa.int64())))])

    def index(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["chunk_id"], null_placement="at_start")).combine_chunks()
        part, ids = table["part"][0].as_py(), table["chunk_id"].combine_chunks()
        # rows of one chunk_id are one chunk
        new = np.ones(len(ids), bool)
        new[1:] = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
        found, size = [], np.zeros(len(ids), np.int64)
        for i, text in enumerate(table["text"].to_pylist()):
            before = len(found)
            found += _words(text)
            size[i] = len(found) - before
        ids, slots, dl = ids.filter(pa.array(new)), table["slot"].to_numpy()[new], size[new]
        whole = pa.table([pa.array([v], f.type) for f, v in zip(schema, (part, None, 0, 1, 0, 0.0, [], [], ids.to_pylist(), dl.tolist(), slots.tolist()), strict=True)], schema=schema)
        if not found:
            return whole
        known = sorted(set(found))
        place = {t: i for i, t in enumerate(known)}
        term = np.fromiter((place[t] for t in found), np.int64, len(found))
        key, tf = np.unique(np.repeat(np.cumsum(new) - 1, size) * len(known) + term, return_counts=True)
        row, term = key // len(known), key % len(known)
        blocks = (2 ** np.maximum(np.ceil(np.log2(np.bincount(term) / block)), 0)).astype(np.int64)
        sub = (slots[row] >> bits) & (blocks[term] - 1)
        order = np.lexsort((row, sub, term))
        row, term, tf, sub = row[order], term[order], tf[order], sub[order]
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (sub[1:] != sub[:-1])))
        ends, at = np.append(starts, len(row)), term[starts]
        most = np.maximum.reduceat(tf * (K1 + 1) / _damped(tf, dl[row], avgdl), starts)
        many = len(starts)
        columns = [pa.array(np.full(many, part, np.int32)), pa.array(known, pa.string()).take(pa.array(at)), pa.array(sub[starts]), pa.array(blocks[at]), pa.array(np.diff(ends)), pa.array(most)]
        columns += [_lists(pa.array(v.astype(np.int32)), ends) for v in (row, tf)] + [pa.nulls(many, schema.field(c).type) for c in ("ids", "dl", "slots")]
        return pa.concat_tables([whole, pa.table(columns, schema=schema)])

    dealt = texts.select("chunk_id", F.lower("text").alias("text"), _slot("chunk_id").alias("slot"))
    dealt = dealt.withColumn("part", F.col("slot").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")).repartition(_tasks(spark, 1 << bits), "part")
    dealt.groupBy("part").applyInArrow(index, _shape(total.kind)).write.option("parquet.block.size", FILE_ROWS).mode("overwrite").parquet(f"{path}/postings")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, Row]:
    """Postings and totals of an index; an index of no texts has no file of postings."""
    totals = spark.read.parquet(f"{path}/totals").first()
    return spark.read.schema(_shape(totals.kind)).parquet(f"{path}/postings"), totals


def _parts(spark: SparkSession, queries: DataFrame, path: str, n: int, skipping: bool, bounds: bool = False) -> DataFrame:
    """(slot_id, chunk_id, score) of the n best of each query in each part; bounds: (slot_id, bound) of all blocks instead.

    Queries are a request, and travel with the function.
    """
    postings, totals = _read(spark, path)
    asked = queries.select("slot_id", F.explode(words(F.col("text"))).alias("term")).groupBy("slot_id", "term").agg(F.count("*").alias("times")).collect()
    slot_kind = queries.schema["slot_id"].dataType
    out = {"slot_id": slot_kind.simpleString()} | ({"bound": "long"} if bounds else {"chunk_id": totals.kind, "score": "long"})
    shape = ", ".join(f"{k} {v}" for k, v in out.items())
    if not asked:
        return spark.createDataFrame([], shape)
    mine = postings.where(F.col("term").isin(sorted({r.term for r in asked})))
    df = F.sum("n").cast("double")
    rarity = mine.groupBy("term").agg(F.log(1 + (totals.n - df + 0.5) / (df + 0.5)).alias("idf"))
    idf = {r.term: r.idf for r in rarity.collect()}
    wanted: dict = {}
    for r in asked:
        if r.term in idf:
            wanted.setdefault(r.slot_id, []).append((r.term, r.times))
    avgdl, bits, slot_type = totals.avgdl, totals.bits, to_arrow_type(slot_kind)
    id_type = to_arrow_type(postings.schema["ids"].dataType.elementType)

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.floor(x * 1e6 + 0.5).astype(np.int64)

    def find(table: pa.Table) -> pa.Table:
        if table["term"].null_count == len(table):  # a part without any word of the queries
            return pa.table({"slot_id": pa.array([], slot_type)} | ({"bound": pa.array([], pa.int64())} if bounds else {"chunk_id": pa.array([], id_type), "score": pa.array([], pa.int64())}))
        whole = table.filter(pc.is_null(table["term"])).combine_chunks()
        flat = lambda rows, c: pc.list_flatten(rows[c]).combine_chunks()
        ids, dl, sub = flat(whole, "ids"), flat(whole, "dl").to_numpy(), flat(whole, "slots").to_numpy() >> bits
        rows = table.filter(pc.is_valid(table["term"])).sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        names, block, blocks, most, size = rows["term"].to_pylist(), *(rows[c].to_numpy() for c in ("block", "blocks", "most", "n"))
        chunk, tf = flat(rows, "chunks").to_numpy(), flat(rows, "tf").to_numpy().astype(np.float64)
        ends = np.append(0, np.cumsum(size))
        rare = np.array([idf[t] for t in names])
        part = scaled(np.repeat(rare, size) * tf * (K1 + 1) / _damped(tf, dl[chunk], avgdl))
        # a weight is rounded when it is scored; one more than its bound is over it
        over = scaled(rare * most) + 1
        first = [i for i, t in enumerate(names) if not i or names[i - 1] != t]
        place = {names[a]: slice(a, b) for a, b in zip(first, [*first[1:], len(names)], strict=True)}
        slot_ids, found, scores = [], [], []

        def add(mine: list, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Chunks in the blocks to keep, and their scores."""
            score = np.zeros(len(ids), np.int64)
            for at, times in mine:
                low, high = ends[at.start], ends[at.stop]
                got, weight = chunk[low:high], part[low:high]
                if keep is not None:
                    some = np.repeat(keep.reshape(-1, blocks[at.start]).any(0)[block[at]], size[at])
                    got, weight = got[some], weight[some]
                score[got] += weight * times
            hit = np.flatnonzero(score > 0)
            if keep is not None:
                hit = hit[keep[sub[hit] & (len(keep) - 1)]]
            return hit, score[hit]

        for slot_id, terms in wanted.items():
            mine = [(place[t], times) for t, times in terms if t in place]
            if not mine:
                continue
            widest = max(int(blocks[at.start]) for at, _ in mine)
            bound, keep = np.zeros(widest, np.int64), None
            for at, times in mine:
                own = np.zeros(int(blocks[at.start]), np.int64)
                own[block[at]] = over[at] * times
                bound += np.tile(own, widest // len(own))
            if bounds:
                found.append(bound[bound > 0])
                slot_ids += [slot_id] * len(found[-1])
                continue
            if skipping and widest > FIRST:
                tried = np.zeros(widest, bool)
                tried[np.argpartition(-bound, FIRST)[:FIRST]] = True
                score = add(mine, tried)[1]
                if len(score) >= n:
                    keep = tried | (bound >= np.partition(score, -n)[-n])
            hit, score = add(mine, keep)
            if len(hit) > n:
                near = score >= np.partition(score, -n)[-n]
                hit, score = hit[near], score[near]
            best = np.lexsort((hit, -score))[:n]
            found.append(hit[best])
            scores.append(score[best])
            slot_ids += [slot_id] * len(best)
        joined = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        if bounds:
            return pa.table({"slot_id": pa.array(slot_ids, slot_type), "bound": joined(found)})
        return pa.table({"slot_id": pa.array(slot_ids, slot_type), "chunk_id": ids.take(pa.array(joined(found))).cast(id_type), "score": joined(scores)})

    dealt = mine.unionByName(postings.where("term IS NULL")).repartition(_tasks(spark, 1 << bits), "part")
    return dealt.groupBy("part").applyInArrow(find, shape)


def _best(scored: DataFrame, n: int) -> DataFrame:
    """The n best of each query, kept as n rows for each task before anything is shuffled whole."""
    order = F.struct((-F.col("score")).alias("low"), "chunk_id")
    listed = scored.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).groupBy("slot_id", "part").agg(F.slice(F.sort_array(F.collect_list(order)), 1, n).alias("best"))
    merged = listed.groupBy("slot_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, n).alias("best"))
    rows = merged.select("slot_id", F.posexplode("best").alias("at", "b"))
    return rows.select("slot_id", F.col("b.chunk_id").alias("chunk_id"), (F.col("at") + 1).alias("place"), (-F.col("b.low")).alias("score"))


def search(spark: SparkSession, queries: DataFrame, path: str, n: int = 10, skipping: bool = True) -> DataFrame:
    """(slot_id, chunk_id, place, score): the n chunks of best BM25 score for each query (slot_id, text)."""
    return _best(_parts(spark, queries, path, n, skipping), n)


def skipped(spark: SparkSession, queries: DataFrame, path: str, n: int = 10) -> tuple[int, int]:
    """How many blocks a search of all parts at once would work out, and how many there are for its words."""
    bounds = _parts(spark, queries, path, n, True, bounds=True)
    least = search(spark, queries, path, n).where(F.col("place") == n).select("slot_id", F.col("score").alias("least"))
    needed = bounds.join(least, "slot_id", "left").where(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    return needed.count(), bounds.count()
