import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import jaccard


def shingled(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """(id, size, component) of each (id, text), by all pairs."""
    sets = [shingled(t) for _, t in rows]
    owner = list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                owner[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return sorted(repr((id_, len(s), least.get(find(i)) if s else id_)) for i, ((id_, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    """Texts of 1 to 150 words, many of them edits of few, and a passage that a third of them hold."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice(["", "É", "x"])
    passage, texts = [word() for _ in range(30)], []
    bases = [[word() for _ in range(rng.choice([2, 3, 25, 60, 150]))] for _ in range(25)]
    for _ in range(220):
        w = list(rng.choice(bases[:6] if rng.random() < 0.6 else bases))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        texts.append(w)
    for _ in range(110):
        at = rng.randint(0, 3)
        texts.append([word() for _ in range(at)] + passage + [word() for _ in range(rng.randint(0, 4))])
    rows = [(i, rng.choice([" ", "\t", "\n "]).join(w) if rng.random() < 0.7 else " ".join(w).upper()) for i, w in enumerate(texts)]
    return [*rows, *((1000 + i, rows[i][1]) for i in range(0, 60, 3)), (2000, None), (2001, ""), (2002, " \n"), (None, rows[5][1]), (None, "alone with no id"), (7, "again " * 40), (7, "again " * 40)]


@pytest.mark.parametrize(("list_", "rows_"), [(2048, 1 << 16), (3, 8)])
def test_equals_all_pairs(spark, monkeypatch, list_, rows_):
    monkeypatch.setattr(jaccard, "LIST", list_)
    monkeypatch.setattr(jaccard, "ROWS", rows_)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = corpus(list_)
        got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain(rows)
    assert len({r.component_id for r in got}) < len(got) - 100


def part(rows):
    names = ("part", "token", "low", "high", "side", "split", "sid", "n", "pos", "root", "lead", "n_lead", "shared")
    return pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)})


def test_answers_of_a_leader_decide():
    rows = [(1, 1, 0, 0, 0, False, sid, 100, 0, sid, 9, 100, shared) for sid, shared in ((1, 99), (2, 99), (3, 80), (4, 92))]
    found = jaccard._skipped(part(rows)).to_pylist()
    # 98 shared of 100 at least: a link; 3 shares 81 with 1 and 2 at most; 4 shares 91 to 93 with 1 and 2
    assert found == [{"a": 1, "b": 2, "sure": True}]
    rows[3] = rows[3][:-1] + (95,)
    assert {(r["a"], r["b"], r["sure"]) for r in jaccard._skipped(part(rows)).to_pylist()} == {(1, 2, True), (1, 4, False), (2, 4, False)}


def test_parts_of_a_long_list_meet_once():
    rows = [(1, 1, 0, 1, side, True, sid, 50, 0, sid, -1, -1, -1) for sid, side in ((1, 0), (2, 0), (3, 1))]
    assert {(r["a"], r["b"]) for r in jaccard._skipped(part(rows)).to_pylist()} == {(1, 3), (2, 3)}


def test_positions_and_sizes_rule_out():
    rows = [(1, 1, 0, 0, 0, False, sid, n, pos, sid, -1, -1, -1) for sid, n, pos in sorted([(1, 100, 0), (2, 100, 5), (3, 100, 6), (4, 89, 0), (5, 100, 40)], key=lambda r: r[2])]
    assert {(r["a"], r["b"]) for r in jaccard._skipped(part(rows)).to_pylist()} == {(1, 2)}


def test_first_shingles_in_one_order(spark):
    frame = spark.createDataFrame([(i, b"k", f"common words here and rare{i} ones follow it") for i in range(20)], "id long, key binary, text string")
    ranks = jaccard.rarity(frame.select("text"))
    assert ranks().shape == (1 << jaccard.TABLE_BITS,) and np.bincount(ranks())[8] == 3  # 20 times: "common words here", "words here and", "ones follow it"
    rows = jaccard.sketch(frame, ranks).collect()
    assert all(r.n == 6 and r.first == sorted(r.first) and len(r.first) == 1 for r in rows)


def test_odd_documents(odd, empty):
    got = jaccard.jaccard_classes(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain(rows)
    none = jaccard.jaccard_classes(empty)
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id"]
