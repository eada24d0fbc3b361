"""Tables in generations: adopted, updated, retired and pruned; writers that meet; batches that come again."""

import random

from tessella.sources import generations as G

SCHEMA = "id long, name string, n int, gone boolean"


def rows_of(frame):
    return {(r.id, r.name, r.n) for r in frame.collect()}


def test_a_life_of_a_table(spark, tmp_path):
    root = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert G.current(spark, root) is None
    one = G.merge(make((1, "a", 1, False), (2, "b", None, None), (9, "x", 1, True)), root, ["id"], "b0")
    assert one["counts"] == {"adopted": 2} and rows_of(G.current(spark, root)) == {(1, "a", 1), (2, "b", None)}
    two = G.merge(make((1, "a", 2, False), (2, "b", None, False), (3, "c", 1, False), (None, "null", 0, False)), root, ["id"], "b1")
    assert two["counts"] == {"updated": 1, "same": 1, "adopted": 2}
    three = G.merge(make((1, None, None, True), (2, "b", None, False)), root, ["id"], "b2")
    assert three["counts"] == {"retired": 1, "same": 1, "kept": 2} and rows_of(G.current(spark, root)) == {(2, "b", None), (3, "c", 1), (None, "null", 0)}
    assert {(r.id, r.n, r.adopted, r.changed, r.retired) for r in G.current(spark, root, retired=True).where("id = 1").collect()} == {(1, 2, 0, 1, 2)}
    again = G.merge(make((1, "back", 5, False), (1_000, "z", 0, False)), root, ["id"], "b3")
    assert again["counts"] == {"adopted": 2, "kept": 3} and (1, "back", 5) in rows_of(G.current(spark, root))
    assert G.merge(make((1, "other", 5, False)), root, ["id"], "b1") == two and (1, "back", 5) in rows_of(G.current(spark, root))
    gone = G.prune(spark, root, 2)
    assert len(gone) == 2 and len(list((tmp_path / "t").glob("g=*"))) == 2 and len(rows_of(G.current(spark, root))) == 5
    assert G.merge(make(), root, ["id"], "b4")["counts"] == {"kept": 5}


def test_two_writers_that_meet(spark, tmp_path):
    root = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    G.merge(make((1, "a", 1, False)), root, ["id"], "b0")
    met = []

    def other():
        if not met:  # another writer commits between our merge and our commit
            met.append(G.merge(make((2, "other", 2, False)), root, ["id"], "other"))

    mine = G.merge(make((3, "mine", 3, False)), root, ["id"], "mine", before_commit=other)
    assert mine["number"] == met[0]["number"] + 1
    assert rows_of(G.current(spark, root)) == {(1, "a", 1), (2, "other", 2), (3, "mine", 3)}
    assert len(list((tmp_path / "t").glob("g=*"))) == 3


def test_streams_and_a_plain_loop(spark, tmp_path):
    rng, want, root = random.Random(4), {}, str(tmp_path / "t")
    for batch in range(4):
        rows = [(i, rng.choice("abc"), rng.randint(0, 2), rng.random() < 0.3) for i in rng.sample(range(30), 12)]
        for i, name, n, gone in rows:
            want.pop(i, None) if gone else want.update({i: (i, name, n)})
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = G.follow(stream, root, ["id"], "s", str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
        assert rows_of(G.current(spark, root)) == set(want.values())
    # a stream whose checkpoint is lost begins anew: its batches are known
    last = G.Log(spark, root).last()
    G.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), root, ["id"], "s", str(tmp_path / "cp2")).awaitTermination(120)
    assert G.Log(spark, root).last() == last
