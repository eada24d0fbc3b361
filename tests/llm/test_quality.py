import math
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tessella.llm import quality
from tessella.llm.common import SpanHash


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, prose(rng.randint(5, 90)) if i % 4 else " ".join(f"{word().upper()}!!" for _ in range(rng.randint(5, 90)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = quality.quality_scores(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 60 < len(held) < 180
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_keep_has_all_columns(corpus):
    docs, labels = corpus
    kept = quality.keep(docs.selectExpr("*", "1 AS score", "'x' AS _y"), labels)
    assert kept.columns == ["doc_id", "text", "score", "_y"]
    assert 440 <= kept.count() <= 460


def test_odd_documents_and_tables(odd, empty, corpus, spark):
    _, labels = corpus
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(empty, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    doubled = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    assert quality.quality_scores(odd, doubled).count() == odd.count()


def test_equal_texts_equal_scores(corpus, spark):
    docs, labels = corpus
    twice = docs.where("doc_id < 2").selectExpr("doc_id", "text").unionByName(docs.where("doc_id < 2").selectExpr("doc_id + 9000 AS doc_id", "text"))
    rows = {r.doc_id: r.score for r in quality.quality_scores(twice, labels).collect()}
    assert rows[0] == rows[9000] and rows[1] == rows[9001]


def plain_statistics(text):
    """Some of the features of a text, by plain loops."""
    kinds = [int(quality.BYTE_KINDS[b]) for b in text]
    words = [w for w in re.split(rb"[ \t\r\f\v\n]+", text) if w]
    counts = Counter(words)
    n = max(1, len(words))
    mean = sum(map(len, words)) / n
    return {
        **{k: kinds.count(k) / max(1, len(text)) for k in range(12)},
        12: np.log1p(len(text)), 13: np.log1p(len(words)), 14: mean, 15: np.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2)), 16: sum(a == b for a, b in pairwise(words)) / n,
        17: sum(words[i] == words[i - g] for i in range(len(words)) for g in range(2, 9) if i >= g) / n, 18: len(counts) / n, 19: max(counts.values(), default=0) / n,
    }


def test_statistics_equal_plain_loops():
    rng = random.Random(7)
    texts = [b"", b" \n ", b"a", b"a a a\nb", "Üß ß".encode(), *[" ".join(rng.choice(["ab", "AB", "a!", "||", "1", "ab"]) for _ in range(rng.randint(1, 60))).encode() for _ in range(60)]]
    offsets = np.cumsum([0, *map(len, texts)])
    found = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), offsets, SpanHash())
    for row, text in zip(found, texts, strict=True):
        for i, value in plain_statistics(text).items():
            assert abs(row[i] - value) < 1e-5, (text, i)


def test_trees_equal_plain_loops():
    rng = np.random.default_rng(8)
    x = np.round(rng.random((400, 3)), 2).astype(np.float32)
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] < 0.3)).astype(float)
    forest = quality.fit(x, y)
    binned = [[sum(e < v for e in edges) for v, edges in zip(row, forest.edges, strict=True)] for row in x]
    for row, score in zip(binned[:80], forest.scores(x)[:80], strict=True):
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        assert abs(1 / (1 + math.exp(-total)) - score) < 1e-9
    # the first split is the best of all by exhaustive search
    p = y.mean()
    gradient, hessian = p - y, np.full(len(y), p * (1 - p))
    gain = lambda g, h: g * g / (h + quality.L2)
    best = max((gain(gradient[b <= t].sum(), hessian[b <= t].sum()) + gain(gradient[b > t].sum(), hessian[b > t].sum()), -i, -t) for i in range(3) for b in [np.array([r[i] for r in binned])] for t in range(b.max()) if quality.MIN_CHILD <= (b <= t).sum() <= len(y) - quality.MIN_CHILD)
    b = np.array([r[forest.feature[0][0]] for r in binned])
    left = b <= forest.limit[0][0]
    assert abs(gain(gradient[left].sum(), hessian[left].sum()) + gain(gradient[~left].sum(), hessian[~left].sum()) - best[0]) < 1e-6
