from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id double, component string"


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "clash", 1.0, "clash") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors):
    """n, sums, the covariance and its eigenvalues and vectors by fractions and one float64 decomposition."""
    fit = sorted({tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit]
    d = len(sums)
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)]
    values, vectors_ = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    return n, sums, cov, values[::-1], vectors_[:, ::-1]


def test_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 0.5).astype(np.float32).tolist()
    vectors += vectors[:40] + [vectors[0]] * 50
    rows = whitening.whiten(frame(spark, vectors).repartition(7)).collect()
    n, sums, cov, values, basis = plain(vectors)
    trace = float(sum(cov[i][i] for i in range(6)))
    assert len(rows) == 4 * len(vectors) and {r.n for r in rows} == {n}
    signs = {}
    for r in rows:
        x = [int(np.floor(256 * c)) for c in vectors[r.vec_id]]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        c = r.component - 1
        want = sum((a - s / n) * b for a, s, b in zip(x, sums, basis[:, c], strict=True)) / values[c] ** 0.5
        sign = signs.setdefault(c, np.sign(want * r.whitened))
        assert abs(r.whitened - sign * want) < 1e-9
        assert abs(r.explained - values[c] / trace) < 1e-12 and r.identity_error < 1e-9


def test_scatter_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**40), 2**40, (5000, 3))
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
    n, sums, least, most = whitening.extremes(fit, 3)
    assert (n, sums, least, most) == (5000, [sum(map(int, c)) for c in x.T], x.min(0).tolist(), x.max(0).tolist())
    reach = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, least, most, strict=True))
    got = whitening.scatter(fit, 3, n, sums, n * reach * reach)
    centred = n * x.astype(object) - np.array(sums, object)
    assert (got == centred.T @ centred).all()
    assert len(whitening.primes(2 * n * reach * reach)) > 3


def test_primes():
    found = whitening.primes(1 << 100)
    assert found == sorted(found, reverse=True) and all(p < 1 << 22 and all(p % q for q in range(2, 2100)) for p in found)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [-1.0, 0.5], [3.0, -0.0]]
    odd = [None, [], [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0, -inf], [1.0, 2.0, 3.0], [1.0]]
    rows = whitening.whiten(frame(spark, good + odd + [good[0]], [0, 1, 2, 3, *range(10, 18), None])).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in rows) == [(i, c) for i in (-1, 0, 1, 2, 3) for c in (1, 2)]
    assert {r.n for r in rows} == {4}
    assert len({(r.component, r.whitened) for r in rows if r.vec_id in (0, None)}) == 2
    assert whitening.whiten(frame(spark, odd[:6])).collect() == []
    empty = whitening.whiten(frame(spark, good).where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_no_variance(spark, vectors):
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == 2 * len(vectors)
    assert all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in rows)


def test_flat_component_and_huge_entries(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and all(r.identity_error < 1e-9 for r in rows)
    rows = whitening.whiten(frame(spark, [[1e30, 0.0], [0.0, 1.0], [-1e30, 2.0]])).collect()
    assert len(rows) == 6 and any(r.deviation is None for r in rows)
