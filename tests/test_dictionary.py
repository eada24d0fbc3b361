"""Dictionaries in texts equal a plain loop."""

import random

import numpy as np
import pytest

from tessella.operators import dictionary as D


def plain(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern] if pattern else []


@pytest.mark.parametrize("stretch", [2048, 7])
def test_automaton_equals_a_loop(monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(40):
        alphabet = rng.choice(["ab", "abcé", "a\U0001f600"])
        word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        patterns = [word(rng.randint(1, 9)) for _ in range(rng.randint(0, 12))]
        texts = [word(rng.randint(0, 60)) + rng.choice(["", "z", "zz"]) + word(rng.randint(0, 60)) for _ in range(rng.randint(0, 9))]
        row, which, end = D.Automaton(patterns).read(texts)
        got = sorted(zip(row.tolist(), which.tolist(), end.tolist(), strict=True))
        assert got == sorted((t, p, i + len(patterns[p])) for t, text in enumerate(texts) for p in range(len(patterns)) for i in plain(text, patterns[p]))


@pytest.mark.parametrize("size", [1 << 19, 12])
def test_found_in_parts(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abä") for _ in range(rng.randint(1, 4)))
    patterns = [(i, word()) for i in range(30)] + [(30, None), (31, ""), (32, "ab"), (33, "ab"), (34, "a b")]
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(50)] + [(90, None), (91, ""), (92, "ab_ab-ab ab1"), (92, "ab")]
    frame, listed = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(patterns, "entry int, pattern string")
    assert len(list(D.parts(listed, "entry", "pattern", size))) > (1 if size == 12 else 0)
    for words in (False, True):
        want = []
        for i, text in texts:
            for e, p in patterns:
                at = plain(text or "", p)
                if words:
                    part = lambda k, text=text: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
                    at = [k for k in at if not part(k - 1) and not part(k + len(p))]
                if at:
                    want.append((i, e, at[0] + 1, len(at)))
        assert sorted(tuple(r) for r in D.found(frame, ["id"], "text", listed, words=words, size=size).collect()) == sorted(want)
    none = D.found(frame, ["id"], "text", listed.where("false"))
    assert none.count() == 0 and none.columns == ["id", "entry", "first", "times"]


def test_many_patterns_and_a_long_text_in_proportion():
    rng = np.random.default_rng(1)
    patterns = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(20_000)]
    text = "".join(map(chr, rng.integers(97, 123, 1_000_000))) + patterns[7]
    row, which, end = D.Automaton(patterns).read([text])
    assert (7, len(text)) in set(zip(which.tolist(), end.tolist(), strict=True))
