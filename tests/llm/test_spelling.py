import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tessella.llm import spelling


def made(rows):
    """Occurrences of the words by the contract, rows of (id, text)."""
    found = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def beside(a, b):
    """Whether one edit makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if beside(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 10 * n else None, None, n, len(near)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {(w, f, r, n, k, words.get(f)) for w, (f, r, n, k) in out.items()}


def vocabulary(seed, many, alphabet="abé"):
    rng, words = random.Random(seed), {}
    while len(words) < many:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 11)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]]) or "a"
        words[w] = rng.choice([2, 3, 5, 20, 50, 200, 500, 5000])
    return words


@pytest.mark.parametrize("bound", [4096, 3])
def test_near_words_equal_brute_force(spark, bound):
    words = vocabulary(1, 400) | {"": 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.near, r.near_n) for r in spelling.near_words(frame, bound).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b, words[b]) for a in words for b in words if beside(a, b)}


def test_tries_hold_at_most_what_may_differ(spark):
    words = {f"aaaaaaa{''.join(w)}bbbbbbb": 2 for w in product("xyz", repeat=6)}
    rows = spelling.tries(spark.createDataFrame(list(words.items()), "word string, n long"), bound=20)
    assert max(r["count"] for r in rows.groupBy("trie").count().collect()) <= 20


def test_variants_equal_brute_force(spark):
    words = vocabulary(2, 300)
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(rows) == len(words)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain(words)
    assert any(r.form and r.root != r.form for r in rows)


def test_long_chain_of_forms(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    rows = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert len(rows) == 100 and {r.root for r in rows} == {"w100"}


def test_pairs_across_batches(monkeypatch, spark):
    monkeypatch.setattr(spelling, "ROWS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        words = vocabulary(3, 120)
        got = {(r.word, r.near) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(a, b) for a in words for b in words if beside(a, b)}


def test_active_nodes_by_themselves():
    strings = ["abc", "abd", "ab", "bc", "abcd", "xyz", "", "a"]
    codes = np.array([ord(c) for s in strings for c in s], np.uint32)
    offsets = np.append(0, np.cumsum([len(s) for s in strings]))
    a, b = spelling.Tries(np.zeros(len(strings), np.int64), codes, offsets).near()
    assert {(strings[i], strings[j]) for i, j in zip(a, b, strict=True)} == {(x, y) for x in strings for y in strings if beside(x, y)}


def test_occurrences_of_odd_documents(spark, odd, empty):
    rng = random.Random(4)
    base = ["Überraschung", "naïveté", "committee", "accommodate", "ÀÉÎÕÜÿ×÷", "short", "x" * 3000]
    rows = [(i, " ".join(rng.choice(base).upper() if rng.random() < 0.3 else rng.choice(base) for _ in range(40)) + rng.choice([".", "-", "1", ""]) ) for i in range(60)]
    rows += [(None, "committee committee"), (3, None), (4, ""), (5, "mañanátion nonLatinжжcommittee")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.word: r.n for r in spelling.occurrences(frame).collect()} == made(rows)
    assert {r.word: r.n for r in spelling.occurrences(odd).collect()} == made([(r.doc_id, r.text) for r in odd.collect()])
    got = spelling.variants(spelling.occurrences(frame)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain(made(rows))
    none = spelling.variants(spelling.occurrences(empty))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_task_gives_out_counts_before_it_holds_too_many(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 2)
    rows = [(i, "alphabet betagamma gammadelta " * 2) for i in range(30)]
    assert {r.word: r.n for r in spelling.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == made(rows)
