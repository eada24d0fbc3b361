"""Nearest vectors equal brute force; a look into few cells finds most."""

import numpy as np
import pytest

from tessella.operators import neighbours as V


def brute(x, ids, asked, k):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out = set()
    for q in asked:
        like = np.round((unit * unit[ids.index(q)]).sum(1), 9)
        order = [i for i in sorted(range(len(ids)), key=lambda i: (-like[i], ids[i])) if ids[i] != q][:k]
        out |= {(q, ids[i], p + 1) for p, i in enumerate(order)}
    return out


@pytest.mark.parametrize("part", [50_000, 40])
def test_exact_search_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "ASKED", part)
    rng = np.random.default_rng(part)
    x = rng.normal(size=(600, 8)) + 3 * rng.normal(size=(9, 8))[rng.integers(0, 9, 600)]
    x[50:60] = x[3]
    x[70] = 0
    ids = list(range(600))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 20 = 0 OR vec_id = 70")
    centroids = V.fit(frame, cells=12)
    got = {(r.query, r.id, r.place) for r in V.nearest(frame, asked, 7, probes=2, exact=True, centroids=centroids).collect()}
    assert got == brute(x, ids, [i for i in ids if i % 20 == 0 or i == 70], 7)
    few = V.nearest(frame, asked, 7, probes=4, centroids=centroids)
    assert V.recall(few, V.nearest(frame, asked, 7, exact=True, centroids=centroids)) > 0.8


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    true = V.nearest(vectors, asked, exact=True)
    assert V.recall(V.nearest(vectors, asked), true) >= 0.9


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.1]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0]), (7, []), (8, [-1.0, 0.0]), (2, [0.5, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.nearest(frame, frame, 3, exact=True).collect()
    assert {r.query for r in got} == {1, 2, 8} and {r.id for r in got} == {1, 2, 8}
    assert V.nearest(frame.where("false"), frame).count() == 0 and V.nearest(frame, frame.where("false")).count() == 0


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 20)
    monkeypatch.setattr(V, "ASKED", 7)
    monkeypatch.setattr(V, "PAIRS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6)).tolist()
    x[5], x[6], x[7], x[8], x[9], x[11], x[12] = x[0], [0.0] * 6, None, [None] + [1.0] * 5, [1.0] * 4, [], [3.0, 4.0, 0.0, 0.0, 0.0, 0.0]
    x[20], x[40] = [-v for v in x[0]], [4.0, -3.0, 0.0, 0.0, 0.0, 0.0]
    x[60], x[61] = None, [1e200] * 6
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id int, embedding array<double>")

    def like(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda p, q: sum(u * v for u, v in zip(p, q, strict=True))
        value = dot(a, b) / (max(dot(a, a) ** 0.5, 1e-9) * max(dot(b, b) ** 0.5, 1e-9)) * 1e4 + 0.5
        return int(value // 1) if value == value else 0

    found = V.all_pairs(frame, frame.where("vec_id % 20 = 0"))
    got = {(r.query, r.id): r.like for r in found.collect()}
    assert got == {(q, i): like(x[q], x[i]) for q in range(0, 90, 20) for i in range(90) if i != q}
    assert got[0, 5] == 10_000 and got[40, 12] == 0 and got[60, 1] is None


def test_neighbours_are_no_nested_loop(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["c16_cosine_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
