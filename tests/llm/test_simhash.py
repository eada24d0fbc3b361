import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash
from tessella.llm.components import components


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(values):
    """The least value reachable over pairs that differ in two bits or fewer."""
    out = {v: v for v in values}
    unsigned = np.array([v & (2**64 - 1) for v in values], np.uint64)

    def find(v):
        while out[v] != v:
            v = out[v]
        return v

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 2):
            a, b = find(v), find(values[j])
            out[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Aa", "b", "ÄÖ", "c d", "e"]) for _ in range(rng.randint(0, 700))) for _ in range(40)]
    texts += ["", " \t\n\x0b\x0c\r", "one", "one two", "A B C", "same " * 600]
    assert simhash.simhash([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


@pytest.mark.parametrize("hot", [256, 4])
def test_links_and_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng, found = random.Random(2), set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            near = base
            for _ in range(rng.randint(0, 3)):
                near ^= 1 << rng.randrange(64)
            found.add(near)
    base = rng.getrandbits(64)
    for _ in range(150):
        found.add(base ^ sum(1 << b for b in rng.sample(range(30), rng.randint(1, 4))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in found)
    rows = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    want = classes(values)
    assert {v: rows.get(v, v) for v in values} == want


def test_long_chain_ends_in_one_component(spark):
    chain = [(i, i + 1) for i in range(120)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(rows) == 121 and {r.component for r in rows} == {0}


def test_odd_documents(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.fp, []).append(r)
    zero = {r.doc_id for r in by[0]}
    assert {1, 2, 6} <= zero and {r.component_id for r in by[0]} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({r.component_id or 0 for r in rows})
    assert simhash.one_of_each(empty).count() == 0
