import random
import re

import pytest

from tessella.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    vocabulary = ["ab", "Cd", "é9", "x", "yz", "The", "of", "7"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, some(25)), (2, some(12)), (3, "only three words"), (4, "ONE"), (5, None), (6, "!!"), (7, some(10)), (7, some(11)), (8, "only three words")]
    texts = [None, "", "only, three! WORDS", "one", *[some(rng.randint(0, 40)) for _ in range(60)]]
    texts += [some(5) + "... " + rng.choice(items[:4] + items[6:])[1][rng.randint(0, 9) :] + " " + some(6) for _ in range(60)]
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_hits_equal_brute_force(spark, planted, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    texts, items, benchmark = planted
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _runs long")
    rows = {r.doc_id: tuple(r)[1:] for r in decontam.decontaminate(docs, benchmark).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, items)
    clean = {r.doc_id for r in decontam.clean(docs, benchmark).collect()}
    assert clean == {i for i, r in enumerate(brute(texts, items)) if not r[-1]}


def test_odd_documents_and_empty_tables(odd, empty, planted):
    _, items, benchmark = planted
    rows = decontam.decontaminate(odd, benchmark).collect()
    assert sorted(map(str, (tuple(r)[1:] for r in rows))) == sorted(map(str, brute([r.text for r in odd.collect()], items)))
    assert decontam.decontaminate(empty, benchmark).count() == 0
    none = benchmark.where("false")
    assert decontam.clean(odd, none).count() == odd.count()
    assert decontam.clean(odd, none).columns == odd.columns
    assert {r.n_hit for r in decontam.decontaminate(odd, none).collect()} == {0}
