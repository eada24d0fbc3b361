"""Running sums over groups of any size equal a plain loop, and no task holds a group."""

import random

from pyspark.sql import functions as F

from tessella.operators import scans, selection


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, 1, 5])) for i in range(3_000)] + [("c", 0, 7)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.before(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], ["o"], F.col("v")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = set(), {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want.add((g, o, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + (v or 0)
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert scans.numbered(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).count() == 0


def brute(chunks, limit, lead_limit):
    seen, out = {}, []
    for topic, chunk, _, lead, sentences, marks in sorted(chunks, key=lambda c: c[2]):
        taken = 0
        for s, m in zip(sentences, marks, strict=True):
            if m in seen.setdefault(topic, set()):
                continue
            seen[topic].add(m)
            out.append((topic, chunk, taken, s))
            taken += 1
            if taken >= (lead_limit if lead else limit):
                break
    return sorted(out)


def test_sentences_once_in_few_rounds(spark, monkeypatch):
    rng, rounds = random.Random(2), []
    settled = selection._settled
    monkeypatch.setattr(selection, "_settled", lambda state: rounds.append(1) or settled(state))
    chunks = []
    for i in range(400):
        n = rng.choice([0, 1, 3, 8, 12])
        marks = [rng.choice(["x", "y"]) if rng.random() < 0.2 else str(rng.randint(0, 150)) for _ in range(n)]
        chunks.append((rng.choice(["t", "t", "u"]), f"c{i}", i, rng.random() < 0.2, [f"{i}-{j}" for j in range(n)], marks))
    frame = spark.createDataFrame(chunks, "topic string, chunk_id string, order int, is_lead boolean, sentences array<string>, fingerprints array<string>")
    got = sorted(tuple(r) for r in selection.unseen_sentences(frame.repartition(5), 2, 4).collect())
    assert got == brute(chunks, 2, 4)
    assert len(rounds) < 40
    assert selection.unseen_sentences(frame.where("false")).count() == 0


def test_only_chunks_with_shared_sentences_wait(spark, monkeypatch):
    """All chunks with their texts and marks were written anew in each round."""
    written, cut = [], selection.cut
    monkeypatch.setattr(selection, "cut", lambda df: written.append((df.columns, df.count())) or cut(df))
    chunks = [("t", f"c{i}", i, i == 5, [f"{i}-{j}" for j in range(6)], [f"{i}-{j}" for j in range(6)]) for i in range(200)]
    chunks[30][5][1], chunks[70][5][:] = "5-0", [None, "30-0", "30-4", "x", "x", "5-0"]
    chunks += [("u", "c0", 0, False, ["a"], ["5-0"]), ("u", "c0", 0, False, ["b"], ["5-0"]), (None, "c1", 1, False, ["c"], ["c"])]
    frame = spark.createDataFrame(chunks, "topic string, chunk_id string, order int, is_lead boolean, sentences array<string>, fingerprints array<string>")
    got = sorted(tuple(r) for r in selection.unseen_sentences(frame.repartition(3)).collect())
    u = [r for r in got if r[0] == "u"]
    assert [r for r in got if r[0] == "t"] == brute(chunks[:200], 3, 5) and len(u) == 1
    assert all("sentences" not in columns and n <= 5 for columns, n in written)
    assert written[-1][1] < written[0][1]
