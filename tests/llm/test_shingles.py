import random

import corpus_pipeline
import numpy as np
import pytest

from tessella.llm import shingles


def brute(texts):
    """For each text the least number of a text reachable over pairs of similarity 0.8 or more."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    out = list(range(len(texts)))

    def find(i):
        while out[i] != i:
            i = out[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = find(i), find(j)
                out[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_kept_documents_equal_brute_force(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [None, "", " \n", "a b", "A  b", "one two three four five", "one two three four five six"]
    for _ in range(60):
        base = prose(rng.randint(20, 300))
        texts += [base, *[edited(rng, base, rng.randint(0, len(base.split()) // 25 + 1)) for _ in range(rng.randint(0, 4))]]
    line, base = prose(40), prose(120)
    texts += [line + " " + prose(rng.randint(5, 60)) for _ in range(60)] + [edited(rng, base, rng.randint(1, 4)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(texts)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert len(set(want)) < len(set(texts)) - 50


@pytest.mark.parametrize("text", [b"", b"one", b"A b C d E", b"a b c d e f a b c d e f"])
def test_distinct_shingles_of_a_text(text):
    words = text.lower().split()
    assert len(shingles.shingles(text)) == len({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else ())


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in (9, 90, 900):
        for _ in range(200):
            base, other = (rng.integers(0, 2**63, n, np.uint64) for _ in range(2))
            differ = n // 9  # of n: similarity 0.8
            keys = shingles._keys([base, np.concatenate([base[differ:], other[:differ]])])
            assert (keys[0] == keys[1]).any()


def test_odd_documents(odd, empty):
    kept = shingles.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8]
    assert shingles.one_of_each(empty).count() == 0
