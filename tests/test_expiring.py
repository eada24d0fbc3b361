"""A cached entry goes by itself, without another event of its key."""

import time
from datetime import datetime

from tessella.streaming import caches


def test_entries_go_without_an_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema, folder = "ts timestamp, user_id long", tmp_path / "in"
        put = lambda users, name: spark.createDataFrame([(datetime(2026, 1, 1), u) for u in users], schema).coalesce(1).write.mode("append").parquet(str(folder))
        put([1, 1, 2], "a")
        stream = spark.readStream.schema(schema).parquet(str(folder))
        seen = []
        query = (
            caches.expiring(stream, ["user_id"], 8).writeStream.outputMode("update").trigger(processingTime="1 second")
            .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda batch, _: seen.extend(tuple(r) for r in batch.collect())).start()
        )
        until = time.monotonic() + 120
        while len(seen) < 2 and time.monotonic() < until and query.isActive:
            time.sleep(0.3)
        put([2], "b")  # one of the two is written again in time, the other is not
        while sum(s == "gone" for *_, s in seen) < 2 and time.monotonic() < until and query.isActive:
            time.sleep(0.3)
        query.stop()
        assert query.exception() is None
        live = [r for r in seen if r[2] == "live"]
        assert (1, 2, "live") in live and (2, 1, "live") in live
        assert {r[0] for r in seen if r[2] == "gone"} == {1, 2}
        assert (1, 2, "gone") in seen
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
