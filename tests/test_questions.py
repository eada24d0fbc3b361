"""Keywords of questions, likeness of texts and depths in trees with cycles, against plain loops."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessella.operators import answers, questions, trees


def plain(text, most=50):
    """Each word's keywords by what the module says of them."""
    words = re.findall("[A-Za-zÄÖÜäöüßẞ-]+", text or "")
    named = lambda w: w[:1].isupper() and w.lower() not in questions.FUNCTION + questions.GENERIC
    nouns = lambda n: list(dict.fromkeys([n] + [n[: -len(e)] for e in ("es", "s", "e", "en", "n") if n.endswith(e) and len(n) - len(e) >= 4]))

    def adjectives(a):
        stem = next((a[: -len(e)] for e in ("en", "em", "er", "es", "e") if a.lower().endswith(e) and len(a) - len(e) >= 3), a)
        return [stem[:1].upper() + stem[1:] + e for e in ("e", "er", "es")]

    out = []
    for i, w in enumerate(words):
        one, two = (words[i + 1 :] + ["", ""])[:2]
        if named(w) and one == "und" and named(two):
            out.append(f"{w} und {two}")
        if w[0].islower() and w not in questions.FUNCTION and len(w) > 4 and named(one) and re.search("(en|em|er|es|e)$", w):
            out += [f"{a} {n}" for a in adjectives(w) for n in nouns(one)]
        if named(w):
            end = i + 1
            while end < len(words) and (named(words[end]) or words[end] == "von"):
                end += 1
            for stop in range(end, i + 1, -1):
                if words[stop - 1] != "von":
                    out += [" ".join(words[i : stop - 1] + [n]) for n in nouns(words[stop - 1])] if stop > i + 1 else []
                    if stop == i + 2 and re.search("(en|em|er|es|e)$", w.lower()):
                        out += [f"{a} {n}" for a in adjectives(w) for n in nouns(words[stop - 1])]
            out += nouns(w)
    return list(dict.fromkeys(out))[:most]


def test_keywords_equal_a_plain_loop(spark):
    rng = random.Random(3)
    pool = "wie entsteht Ebbe und Flut nachhaltiger Landwirtschaft Ersten Weltkriegs Joseph von Eichendorff Unterschied die Netzwerke großes Haus im 19 Jahrhundert Weimarer Republik Tiere zwischen roten Blutes Äpfeln e-mail".split()
    texts = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) + rng.choice(["?", ""])) for i in range(150)]
    texts += [(900, None), (901, ""), (902, " ".join(f"Wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(130))), (903, "Wie entsteht ein Regenbogen?")]
    got = {}
    for r in questions.keywords(spark.createDataFrame(texts, "id int, text string"), "id").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.keyword)
    assert got == {i: want for i, t in texts if (want := plain(t))}
    assert got[903] == ["Regenbogen", "Regenboge"] or got[903][0] == "Regenbogen"


def test_keywords_are_sliced_in_arrow_batches(spark, monkeypatch):
    """Array functions took a step of an interpreter for each word of each name; batches that leave Python early hold the same rows."""
    words = [f"Wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    texts = spark.createDataFrame([(i, " ".join(words[i % 7 :])) for i in range(40)], "id int, text string").repartition(4)
    found = questions.keywords(texts, "id")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(questions, "TOGETHER", 1000)
    assert sorted(found.collect()) == sorted((i, k, w) for i, t in texts.collect() for k, w in enumerate(plain(t)))


def test_all_keywords_of_long_runs_and_of_runs_that_repeat(spark):
    rng = random.Random(9)
    pool = "wie Ersten Weltkriegs Weltkrieg Weltkriege Joseph von Eichendorff und Große Netzwerke roten die Tiere".split()
    texts = [(i, " ".join(rng.choice(rng.sample(pool, k)) for _ in range(rng.randint(0, 40)))) for i in range(60) for k in (2, 5, 9)]
    texts = [(i, t) for i, (_, t) in enumerate(texts)] + [(900, "Haus " * 60), (901, "Rotes Haus Am See " * 12), (902, None)]
    got = {}
    for r in questions.keywords(spark.createDataFrame(texts, "id int, text string"), "id", most=None).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.keyword)
    assert got == {i: want for i, t in texts if (want := plain(t, 10**9))}


def test_the_query_gives_all_keywords(spark):
    from tessella.plans.registry import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("concat_ws('-', conv_id, turn) AS id", "initcap(text) AS text").collect()
    want = {(r.id, i, k) for r in rows for i, k in enumerate(plain(r.text, 10**9))}
    got = [tuple(r) for r in QUERIES["h19_question_keywords"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(want) and set(got) == want


def test_likeness_equals_the_standard_library(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(0, 40)))
    pairs = [(text(), text()) for _ in range(200)] + [("", ""), (None, "a"), ("a", None)]
    pairs += [(r.text, r.text[::2] + "x") for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(20).collect()]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", answers.likeness(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        a, b = pairs[r.i]
        assert r.r == (None if a is None or b is None else SequenceMatcher(None, a, b).ratio())


def test_depths_with_cycles(spark):
    rng = random.Random(7)
    edges = {i: rng.choice([None, *range(40)]) if i % 3 else max(0, i - 1) or None for i in range(40)}
    edges |= {50: 51, 51: 52, 52: 50, 53: 52, 54: 53, 55: 55}

    def depth(n):
        seen, steps, at = {n}, 0, n
        while edges[at] is not None and edges[at] in edges and edges[at] not in seen:
            at = edges[at]
            seen.add(at)
            steps += 1
        return steps

    tree = spark.createDataFrame([(str(n), f"l{n}", None if p is None else str(p)) for n, p in edges.items()], "node string, label string, parent string")
    assert {r.node: r.depth for r in trees.depths(spark, tree, cycles=True).collect()} == {str(n): depth(n) for n in edges}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_tree")]
