"""Answers are left with what their evidence shows."""

from pyspark.sql import functions as F

from tessella.operators import verification as V

EVIDENCE = [(1, 1, "Die Photosynthese bildet Zucker und Sauerstoff aus Wasser und Kohlendioxid."), (1, 2, "Pflanzen nutzen dafür 4,6 Milliarden Tonnen Wasser im Jahr."), (1, 7, "Chlorophyll absorbiert rotes und blaues Licht besonders stark.")]


def run(spark, texts, evidence=EVIDENCE, mark=None):
    answers = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    rows = [(i, n, t) for i in range(1, len(texts) + 1) for _, n, t in evidence]
    proof = spark.createDataFrame(rows, "id int, number int, text string")
    return {r.id: r for r in V.verified(answers, proof, "id", mark).collect()}


def test_claims_stay_that_are_shown(spark):
    texts = [
        "Chlorophyll absorbiert blaues Licht stark [7]. Die Photosynthese bildet Zucker aus Wasser und Kohlendioxid [1]. Das ist frei erfunden und steht nirgends [2]. Ohne Beleg gesagt.",
        "Pflanzen nutzen 4.600.000.000 Tonnen Wasser [2]. Pflanzen nutzen 5 Milliarden Tonnen Wasser [2].",
        "Die Photosynthese bildet Zucker. Chlorophyll absorbiert rotes Licht. [1, 7] Mehr steht da nicht drin, leider [9].",
        "# Kopf\n\n- Chlorophyll absorbiert rotes Licht [7]\n- Etwas ganz anderes ohne jeden Beleg\n\nPflanzen nutzen\nTonnen Wasser im Jahr [1-2].",
        None, "", "[1]: //böse.example/x [1]", "1. [2]",
        "Die [Photosynthese](http://x/y) bildet <b>Zucker</b> aus Wasser <!-- x --> und Kohlendioxid [1].",
    ]
    got = run(spark, texts)
    assert got[1].text == "Chlorophyll absorbiert blaues Licht stark [1]. Die Photosynthese bildet Zucker aus Wasser und Kohlendioxid [2]." and got[1].sources == [7, 1] and (got[1].kept, got[1].dropped) == (2, 2)
    assert got[2].text == "Pflanzen nutzen 4.600.000.000 Tonnen Wasser [1]." and got[2].sources == [2] and got[2].dropped == 1
    assert got[3].text == "Die Photosynthese bildet Zucker [1][2]. Chlorophyll absorbiert rotes Licht [1][2]." and got[3].sources == [1, 7] and got[3].dropped == 1
    assert got[4].text == "Chlorophyll absorbiert rotes Licht [1]\n\nPflanzen nutzen Tonnen Wasser im Jahr [2][3]." and got[4].sources == [7, 1, 2]
    assert [got[i].text for i in (5, 6, 7, 8)] == [""] * 4 and got[5].sources == [] and got[5].kept == 0
    assert got[9].text == "Die Photosynthese bildet Zucker aus Wasser und Kohlendioxid [1]."


def test_claims_that_fail_are_marked(spark):
    got = run(spark, ["Das hat die Sonne nachts einmal gemacht [2]. Wer weiß das schon [5]? Chlorophyll absorbiert rotes Licht [7]."], mark="Schlussfolgerung")[1]
    assert got.text == "<!-- f: Evidenzgrad=Schlussfolgerung -->Das hat die Sonne nachts einmal gemacht.<!-- /f --> Chlorophyll absorbiert rotes Licht [1]."
    assert (got.kept, got.dropped, got.sources) == (1, 2, [7])


def test_answers_without_evidence_and_no_answers(spark):
    answers = spark.createDataFrame([(1, "Satz eins über Pflanzen [1].")], "id int, text string")
    none = spark.createDataFrame([], "id int, number int, text string")
    assert [tuple(r) for r in V.verified(answers, none, "id").select("id", "text", "kept", "dropped").collect()] == [(1, "", 0, 1)]
    assert V.verified(answers.where("false"), none, "id").count() == 0


def test_texts_are_shuffled_once(spark):
    """The checkpoint and four shuffles of claims, stems and texts took nine times the input on disk."""
    from tessella.plans.registry import QUERIES

    found = QUERIES["p3_verified_answers"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") <= 2 and "Scan ExistingRDD" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert found.count() > 0


def test_units(spark):
    row = spark.range(1).select(V.units(F.lit("a\nb\n- c\n1. d\ne")).alias("u")).first()
    assert row.u == ["a b", "c", "1. d", "e"]
