"""Operator 7: sharding by a two-pass external shuffle, with DataFrame functions only.

Law `key`: the shard of a row depends on its id and the number of shards alone. Each shard draws a seeded hash
of the id and the largest draw wins, so a further shard takes rows only into itself. Pass one scatters the
rows of a shard uniformly over buckets by a seeded hash of id and text; the number of buckets follows the
number of rows, so that a bucket's row keys fit in memory. Pass two shuffles each bucket (F.shuffle is a
seeded Fisher-Yates) and numbers its rows after those of the shard's earlier buckets.

A null id is a key like any other; null text has no bytes and CRC 0; rows of one id share a shard. Copies of
one row (same id, same text) are counted, not gathered: the copies of a row are laid out next to each other.
The result depends on rows, seed, shards and buckets; the order within a bucket also on the partition that
shuffles it, which a retried task keeps. Other columns are carried by write_shards() and unread by assign().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, table

SHARDS, SEED, BUCKET_ROWS, ROW_OVERHEAD = 40, 20_240, 20_000, 16


def _draw(key: Column, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), shard.cast("int"), key)


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest seeded hash of the key; of equal hashes the larger shard wins.

    The draws are a loop over an array: spelled out, they make one method so long that compiling it takes
    more memory than the data.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(_draw(key, s, seed).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"]


def grown_shard(key: Column, shard: Column, shards: int, seed: int = SEED) -> Column:
    """shard_of(key, shards + 1), from the shard among the first ones."""
    return F.when(_draw(key, F.lit(shards), seed) >= _draw(key, shard, seed), F.lit(shards)).otherwise(shard)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (id_col, size, text_crc32, law, shard, slot, grown_shard); slots of a shard are 0, 1, 2 and so on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    buckets = max(1, -(-docs.count() // (shards * bucket_rows)))
    key = F.col(id_col)
    rows = docs.select(key, (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(key, shards, seed)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), key, "text_crc32", "size"), F.lit(buckets)).cast("int"))
    copies = rows.groupBy("shard", "bucket", id_col, "size", "text_crc32").agg(F.count("*").alias("copies"))
    row = F.struct(F.hash(id_col, "text_crc32", "size").alias("h"), key.alias("id"), "size", "text_crc32", "copies")
    gathered = copies.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    gathered = gathered.sortWithinPartitions("shard", "bucket").withColumn("rows", F.shuffle("rows", F.lit(seed + 2)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = gathered.join(sizes, ["shard", "bucket"]).select("shard", "bucket", "offset", F.posexplode("rows").alias("place", "r"))
    placed = placed.select("shard", "bucket", "offset", "place", "r.*")
    # running counts of copies turn places among distinct rows into slots
    end = F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")
    placed = placed.withColumn("end", end).withColumn("slot", F.explode(F.sequence(F.col("end") - F.col("copies"), F.col("end") - 1)))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown_shard(F.col("id"), F.col("shard"), shards, seed).alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **law) -> None:
    """Write whole rows by shard, in slot order, under path/shard=N; docs has no column named shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_, crc, size, slot, copy = fresh(docs, "_id", "_crc", "_size", "_slot", "_copy")
    placed = assign(docs, id_col, text_col, **law).select(F.col(id_col).alias(id_), F.col("text_crc32").alias(crc), F.col("size").alias(size), "shard", F.col("slot").alias(slot))
    same = Window.partitionBy(id_, crc, size)
    placed = placed.withColumn(copy, F.row_number().over(same.orderBy(slot)))
    rows = docs.withColumns({id_: F.col(id_col), crc: F.crc32(text.cast("binary")), size: (F.octet_length(text) + ROW_OVERHEAD).cast("long")})
    rows = rows.withColumn(copy, F.row_number().over(same.orderBy(F.lit(0))))
    met = rows[id_].eqNullSafe(placed[id_]) & (rows[crc] == placed[crc]) & (rows[size] == placed[size]) & (rows[copy] == placed[copy])
    joined = rows.join(placed, met).select(*[rows[c] for c in docs.columns], placed["shard"], placed[slot])
    joined.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
