from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.streaming import caches

START = datetime(2026, 1, 1)
SCHEMA = "ts timestamp, user_id long, event_type string, value double"


def source(spark, tmp_path):
    rows = [(START + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.coalesce(1).write.parquet(str(tmp_path / "events"))
    return batch, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_windows_equal_a_batch_run(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(caches.windows(stream, "1 hour"), "w", "complete")
    want = caches.windows(batch, "1 hour")
    assert spark.table("w").exceptAll(want).count() == 0 and want.exceptAll(spark.table("w")).count() == 0


def test_sessions_equal_a_batch_run(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(caches.sessions(stream, "15 minutes"), "s", "complete")
    assert spark.table("s").exceptAll(caches.sessions(batch, "15 minutes")).count() == 0


def test_cache_keeps_the_last_write(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    run(caches.last_writes(stream, ["user_id"], 3600), "c", "update")
    got = {r.user_id: (r.last_ts, r.writes) for r in spark.table("c").collect()}
    want = {r.user_id: (r.t, r.n) for r in batch.groupBy("user_id").agg(F.max("ts").alias("t"), F.count("*").alias("n")).collect()}
    assert got == want


def test_refresh_publishes_what_is_new(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    seen = []
    for _ in range(2):
        caches.refresh(stream, lambda b: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 60
