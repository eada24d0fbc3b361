"""Archives: what is written comes back row for row, in parts."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.sources import zim


def rows_of(n):
    rows = [("C", f"A/{i:04d}", f"Titel {i}" if i % 3 else f"A/{i:04d}", ["text/html", "image/png"][i % 2], None, (f"<p>äö {i}</p>" * (i % 50)).encode()) for i in range(n)]
    return [*rows, *[("C", f"R/{i}", f"Zu {i}", None, f"A/{i:04d}", None) for i in range(0, n, 10)], ("M", "Title", "Title", "text/plain", None, b"Ein Archiv"), ("C", "lang" * 300, "T" * 900, "text/html", None, b"x")]


@pytest.mark.parametrize("cluster", [1 << 20, 3_000])
def test_archives_come_back(spark, tmp_path, monkeypatch, cluster):
    monkeypatch.setattr(zim, "CLUSTER_BYTES", cluster)
    rows = rows_of(300)
    (tmp_path / "a.zim").write_bytes(zim.packed(rows))
    (tmp_path / "b.zim").write_bytes(zim.packed(rows[:5]))
    (tmp_path / "c.txt").write_text("no archive")
    listed = zim.entries(spark, str(tmp_path), size=50)
    assert listed.rdd.getNumPartitions() == -(-len(rows) // 50) + 1
    got = {(r.archive.rsplit("/", 1)[1], r.namespace, r.path, r.title, r.mime, r.redirect, None if r.content is None else bytes(r.content)) for r in zim.contents(listed).collect()}
    assert got == {("a.zim", *r) for r in rows} | {("b.zim", *r) for r in rows[:5]}
    plain = spark.read.format("zim").option("path", str(tmp_path / "a.zim")).load()
    assert plain.where("namespace = 'M'").select("path").collect()[0].path == "Title" and plain.count() == len(rows)


def test_each_cluster_goes_to_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zim, "CLUSTER_BYTES", 2_000)
    (tmp_path / "a.zim").write_bytes(zim.packed(rows_of(200)))
    found = zim.contents(zim.entries(spark, str(tmp_path), size=20)).withColumn("task", F.spark_partition_id()).where("cluster IS NOT NULL")
    tasks = found.groupBy("cluster").agg(F.count_distinct("task").alias("n")).collect()
    assert len(tasks) > 5 and all(r.n == 1 for r in tasks)


def test_clusters_of_other_kinds():
    blobs = [b"one", b"", b"three"]
    for width, sign, kind in ((4, "I", zim.PLAIN), (8, "Q", zim.PLAIN | zim.EXTENDED), (8, "Q", zim.ZSTD | zim.EXTENDED), (4, "I", 0)):
        offsets = [width * 4]
        for b in blobs:
            offsets.append(offsets[-1] + len(b))
        body = struct.pack(f"<4{sign}", *offsets) + b"".join(blobs)
        body = pa.compress(body, "zstd", asbytes=True) if kind & 15 == zim.ZSTD else body
        file = pa.BufferReader(struct.pack("<Q", 8) + bytes([kind]) + body)
        cluster = zim.Cluster(file, zim.Header(0, 1, 0, 0, 0), 0)
        assert [cluster.blob(i) for i in range(3)] == blobs
    with pytest.raises(ValueError, match="cluster 0"):
        zim.Cluster(pa.BufferReader(struct.pack("<Q", 8) + bytes([zim.XZ]) + b"....."), zim.Header(0, 1, 0, 0, 0), 0)


def test_broken_and_empty_archives(spark, tmp_path):
    with pytest.raises(ValueError, match="no ZIM archive"):
        zim.header(pa.BufferReader(b"x" * 100))
    with pytest.raises(ValueError, match="no ZIM archive"):
        zim.header(pa.BufferReader(b""))
    with pytest.raises(FileNotFoundError):
        zim.archives(str(tmp_path / "none.zim"))
    (tmp_path / "e.zim").write_bytes(zim.packed([]))
    assert zim.contents(zim.entries(spark, str(tmp_path))).count() == 0
    (tmp_path / "none").mkdir()
    assert zim.contents(zim.entries(spark, str(tmp_path / "none"))).count() == 0


def test_saved_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zim, "ARCHIVE_BYTES", 500)
    rows = [(f"p{i}", f"t{i}", "text/html", (f"{i} " * 40).encode()) for i in range(60)] + [("none", "none", "text/html", None)]
    zim.save(spark.createDataFrame(rows, "path string, title string, mime string, content binary").repartition(3), f"file:{tmp_path}/out")
    assert len(zim.archives(f"{tmp_path}/out")) > 10
    got = {(r.path, r.title, r.mime, bytes(r.content)) for r in zim.contents(zim.entries(spark, f"file:{tmp_path}/out")).collect()}
    assert got == {(p, t, m, c or b"") for p, t, m, c in rows}
