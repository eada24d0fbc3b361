import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import sharding


def check(docs, rows, shards):
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    of = {}
    for r in rows:
        assert of.setdefault(r.doc_id, r.shard) == r.shard


def test_slots_sizes_and_growth(spark, odd, empty):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    rows = sharding.assign(docs, bucket_rows=10).collect()
    check(docs, rows, 40)
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 90
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 15 < moved < 100
    check(odd, sharding.assign(odd).collect(), 40)
    assert sharding.assign(empty).count() == 0


def test_copies_are_not_gathered(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.lit("t")).alias("text"))
    check(docs, sharding.assign(docs, shards=5, bucket_rows=50).collect(), 5)


def test_growth_equals_a_fresh_assignment(spark):
    rows = spark.range(500).select(sharding.shard_of(F.col("id"), 9).alias("a"), sharding.grown_shard(F.col("id"), sharding.shard_of(F.col("id"), 8), 8).alias("b"))
    assert rows.where("a <> b").count() == 0


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda rows: Counter((r.doc_id, r.text, r.key) for r in rows)
    assert key(back.collect()) == key(odd.collect())


def test_no_python_in_the_plan(odd):
    plan = sharding.assign(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_and_slots_equal_a_plain_assignment(spark):
    docs = spark.range(300).select((F.col("id") % 250).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 240).alias("text"))
    found = sharding.assign(docs, shards=7, bucket_rows=20).collect()
    # every draw of every row, and the largest of each id
    draws = docs.select("doc_id").distinct().join(spark.range(8).select(F.col("id").cast("int").alias("s"))).select("doc_id", "s", F.xxhash64(F.lit(sharding.SEED), "s", "doc_id").alias("draw")).collect()
    best = {}
    for r in draws:
        for n in (7, 8):
            if r.s < n:
                best[r.doc_id, n] = max(best.get((r.doc_id, n), (-(2**63) - 1, -1)), (r.draw, r.s))
    assert all((r.shard, r.grown_shard) == (best[r.doc_id, 7][1], best[r.doc_id, 8][1]) for r in found)
    # slots go bucket by bucket, as the seeded hash scatters the rows
    buckets = max(1, -(-300 // (7 * 20)))
    key = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c"), (F.octet_length("text") + 16).cast("long").alias("size"))
    of = {(r.doc_id, r.c): r.b for r in key.select("doc_id", "c", F.pmod(F.xxhash64(F.lit(sharding.SEED + 1), "doc_id", "c", "size"), F.lit(buckets)).alias("b")).collect()}
    for shard in range(7):
        rows = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        order = [of[r.doc_id, r.text_crc32] for r in rows]
        assert order == sorted(order)
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in found)
