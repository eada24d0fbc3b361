"""What is worked out once: by the expressions and plans, and by the same rows as from all scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import sentences as N
from tessella.operators import questions as Q
from tessella.operators import resolution as R
from tessella.operators import strategies as G
from tessella.operators import verification as V


def test_best_and_totals_of_vectors_are_those_of_all_scores(spark):
    vector = lambda i: F.array(*[F.sin(i * (k + 1)) for k in range(4)])
    slots = spark.range(5).select(F.col("id").alias("slot_id"), vector(F.col("id") + 1).alias("vector"))
    topic = F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3))
    chunks = spark.range(0, 3_000, 1, 3).select(topic.alias("topic"), F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 7 > 0, vector(F.col("id"))).alias("vector"))
    rows = G.embedding(slots, chunks)
    want = rows.groupBy("slot_id", "topic").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))
    assert sorted(map(str, G.embedding(slots, chunks, what="totals").collect())) == sorted(map(str, want.select("slot_id", "topic", "n", "total", "best").collect()))
    best = G.embedding(slots, chunks, what="best", n=4)
    assert best.count() <= 5 * 3 * 4 * 3
    ranked = lambda df: sorted(map(str, G.R.top_candidates(df, 4).collect()))
    assert ranked(best) == ranked(rows)


def test_runs_and_places_are_worked_out_once(spark):
    spark.range(1)
    assert R.runs(F.col("t"))._jc.toString().count("regexp_extract_all(") == 1
    assert R.placed(F.col("t"), F.col("w"))._jc.toString().count("regexp_instr(") == 4


def test_sentences_are_cut_once(spark):
    spark.range(1)
    assert N.sentences(F.col("t"))._jc.toString().count("regexp_replace(") < 10
    assert V.claims(F.col("t"))._jc.toString().count("(?<=[.!?…])") == 1


def test_keywords_are_made_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "Was ist Die Kleine Hexe und Peter Pan von Oben? Der saure Regen."), (2, None), (3, "")], "id int, text string")
    found = Q.keywords(texts, "id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in found.collect()} == {1}


def test_stop_words_are_looked_up_in_a_set(spark):
    from tessella.functions import text as X

    rows = spark.createDataFrame([("Der Mond und die Ebbe, ab 1990",), ("",), (None,)], "t string").repartition(1)
    found = rows.select("t", X.words(F.col("t")).alias("w"), X.words(F.col("t"), []).alias("all"))
    assert "INSET" in found._jdf.queryExecution().optimizedPlan().toString() and "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.t: (r.w, r.all) for r in found.collect()} == {"Der Mond und die Ebbe, ab 1990": (["mond", "ebbe", "1990"], ["der", "mond", "und", "die", "ebbe", "1990"]), "": ([], []), None: (None, None)}
