import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import sentences as N
from tessella.functions import text as X
from tessella.operators import articles, citations, curriculum, keys, lexicon, mentions, policy, ranking, sharing, trees


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Am 3. Mai kam er. Dann ging er.", ["Am 3. Mai kam er.", "Dann ging er."]),
        ("Das gilt z. B. Hier nicht. Ende!", ["Das gilt z. B. Hier nicht.", "Ende!"]),
        ("Vitamin C. Die Zitrone ist sauer.", ["Vitamin C.", "Die Zitrone ist sauer."]),
        ("Max M. Mustermann lebt. Er lacht.", ["Max M. Mustermann lebt.", "Er lacht."]),
        ("Im 18. Jh. wurde es gebaut. Ja.", ["Im 18. Jh. wurde es gebaut.", "Ja."]),
        ("Es kostet 10.000 Euro. 5 Leute zahlen.", ["Es kostet 10.000 Euro.", "5 Leute zahlen."]),
        ("Die Hauptstadt. Das Kapital. Weiter.", ["Die Hauptstadt.", "Das Kapital.", "Weiter."]),
        ("", []),
        ("ohne\n\tEnde", ["ohne Ende"]),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, N.sentences, text) == parts


def test_sentence_fingerprints_and_usable(spark):
    assert one(spark, N.fingerprint, "Eins, zwei: DREI vier fünf sechs sieben acht") == "eins, zwei: drei vier fünf sechs sieben"
    parts = F.array(F.lit("Zu kurz."), F.lit("Dieser Satz ist lang genug dafür."), F.lit("Dieser Satz ist lang genug aber:"))
    assert one(spark, lambda t: N.usable(parts), "x") == ["Dieser Satz ist lang genug dafür."]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("10.000 oder 10000 oder 10 000", ["10000"]),
        ("4,6 Milliarden und 4600000000", ["4600000000"]),
        ("3,50 und 3,5", ["3.5"]),
        ("10 Tausend, 0,0 und 007", ["10000", "0", "7"]),
        ("15 372 Euro in 12 Jahren", ["15372", "12"]),
        ("keine", []),
        ("1,2345 Mio", ["1234500"]),
    ],
)
def test_numbers(spark, text, values):
    assert one(spark, citations.numbers, text) == values


def test_markers(spark):
    assert one(spark, citations.expand_markers, "a [1, 2] b [3-5] c [9-7] d [1-99] e [7] f [1; 3–4 und 6]") == "a [1][2] b [3][4][5] c [9-7] d [1-99] e [7] f [1][3][4][6]"
    assert one(spark, citations.markers, "x [3] y [1] z [3] [12]") == [3, 1, 12]


def test_neutralise(spark):
    text = "A <!-- c --> ![i](http://x/y.png) [Wort](http://z(a)) <b>fett</b> www.evil.example\nEnde"
    assert one(spark, citations.neutralise, text) == "A Wort fett Ende"


def test_support(spark):
    claims = spark.createDataFrame([(1, "Wasserkreislauf Verdunstung Niederschlag [1]", [1]), (2, "Gletscher Lawine Moräne Gestein [1]", [1]), (3, "Es sind 12.000 Tonnen [2]", [2]), (4, "Es sind 13.000 Tonnen [2]", [2]), (5, "kurz", [])], "claim_id int, text string, cited array<int>")
    evidence = spark.createDataFrame([(1, "Der Wasserkreislauf beschreibt Verdunstung und Niederschläge."), (2, "12 Tausend Tonnen wurden gezählt")], "number int, text string")
    rows = {r.claim_id: r.supported for r in citations.support(claims, evidence).collect()}
    assert rows == {1: True, 2: False, 3: True, 4: False, 5: True}


@pytest.mark.parametrize(("text", "word", "stands"), [("Lichtbrechung", "Licht", True), ("Wahlpflichtbereich", "Licht", False), ("Kernphysik", "Physik", True), ("Herdplatten", "Erdplatten", False), ("Eizelle", "Zelle", True), ("nicht-Licht", "Licht", False), ("das licht (hell)", "Licht", True), ("a+b", "a+b", True)])
def test_keywords_at_word_borders(spark, text, word, stands):
    row = spark.createDataFrame([(text, word)], "t string, w string").select(curriculum.stands(F.col("t"), F.col("w")).alias("r")).first()
    assert row.r is stands


def test_generic_words_are_dropped_but_never_the_first(spark):
    nodes = spark.createDataFrame([(i, "Musik und Licht", "") for i in range(5)] + [(9, "Physik", "Licht")], "node int, label string, parent_label string")
    words = spark.createDataFrame([(0, "Licht"), (1, "Musik")], "pos int, keyword string")
    rows = curriculum.search(nodes, words, limit_generic=3).collect()
    assert {r.keyword for r in rows} == {"Licht"} and {r.matched_in for r in rows if r.node == 9} == {"parent"}


def test_mentions_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(t, s, s + rng.randint(1, 6), rng.random() < 0.5, i) for t in range(20) for i, s in enumerate(rng.choices(range(30), k=12))]
    df = spark.createDataFrame(rows, "text int, start int, end int, known boolean, i int")
    got = sorted((r.text, r.start, r.end) for r in mentions.without_overlaps(df, ["text"]).collect())
    want = []
    for t in range(20):
        at = -1
        for s, e in sorted({(s, e) for x, s, e, _, _ in rows if x == t}, key=lambda p: (p[0], p[0] - p[1])):
            if s >= at:
                want.append((t, s, e))
                at = e
    assert got == sorted(want)


def test_fair_share_equals_a_plain_loop(spark):
    needs = [("t", "a", 0, 0, 500), ("t", "b", 1, 1, 10), ("t", "c", 1, 2, 400), ("t", "d", 1, 3, 400), ("t", "e", 2, 4, 0), ("u", "a", 0, 0, 3)]
    df = spark.createDataFrame(needs, "topic string, source string, rank int, position int, need long")
    rows = {(r.topic, r.source): r.allowed for r in sharing.fair_share(df, 700).collect()}
    assert rows == {("t", "a"): 500, ("t", "b"): 10, ("t", "c"): 95, ("t", "d"): 95, ("t", "e"): 0, ("u", "a"): 3}
    assert sharing.widened(7, 1.5) == 11 and sharing.widened(8, 1.5) == 12


def test_tree_from_direct_edges_equals_tree_from_closure_and_cycles_end(spark):
    nodes = spark.createDataFrame([(n, n.upper()) for n in "abcdxy"], "node string, label string")
    direct = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")]
    closed = [*direct, ("c", "a"), ("d", "a"), ("d", "b")]
    both = [trees.parents(spark.createDataFrame(e, "node string, ancestor string"), nodes) for e in (direct, closed)]
    a, b = ({r.node: r.parent for r in t.collect()} for t in both)
    assert a == b == {"a": None, "b": "a", "c": "b", "d": "c", "x": "y", "y": "x"}
    assert {r.node: r.depth for r in trees.depths(spark, both[1]).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_redirects_are_followed_three_hops(spark):
    redirects = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("z", "a")], "name string, to string")
    names = spark.createDataFrame([(n,) for n in "abcdzq"], "name string")
    assert {r.name: r.target for r in keys.follow(redirects, names).collect()} == {"a": "d", "b": "d", "c": "d", "d": "d", "z": None, "q": "q"}


def test_first_matching_spelling(spark):
    wanted = spark.createDataFrame([("foo bar",), ("baz",), ("none",)], "t string")
    titles = spark.createDataFrame([("Foo_bar", 1), ("foo_bar", 2), ("Baz", 3)], "title string, id int")
    rows = {r.t: r.chosen for r in keys.first_match(wanted, keys.spellings(F.col("t")), titles, "t", "title", "id").collect()}
    assert rows == {"foo bar": 2, "baz": 3}


def test_article_sections(spark):
    html = """<html><head><title>x</title></head><body><h1>Optik</h1><p>Lead <sup class="reference">[1]</sup>text
      <p>Second &amp; more <a href="./Licht" title="Licht">Licht</a><h2>Teil</h2><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>
      <h3>Unter</h3><table class="wikitable"><tr><th>H</th><td>1</td></tr><tr><th>I</th><td>2</td></tr></table><table><tr><td>no</td></tr></table>
      <h2>Ende</h2><div class="navbox"><br><p>no</p></div><p>Last <a title="Datei:x.png">f</a><a href="Licht_(Physik)">l</a> <a title="licht">l</a><a title="Licht">l</a></body>"""
    rows = articles.parsed(spark.createDataFrame([(1, html), (2, None), (3, "<p id=disambig>x")], "page_id int, html string"))
    found = {r.page_id: r for r in rows.collect()}
    one_ = found[1]
    assert one_.title == "Optik" and not one_.is_disambiguation and found[3].is_disambiguation and found[2].sections == []
    assert [(s.heading, s.path, s.level) for s in one_.sections] == [("", [], 0), ("Teil", ["Teil"], 2), ("Unter", ["Teil", "Unter"], 3), ("Ende", ["Ende"], 2)]
    assert [[(p.kind, p.text) for p in s.paragraphs] for s in one_.sections] == [[("text", "Lead text"), ("text", "Second & more Licht")], [("list", "- a\n  - b\n- c")], [("table", "H | 1\nI | 2")], [("text", "Last fl ll")]]
    assert one_.sections[3].links == ["Licht (Physik)", "licht"]
    flat = articles.paragraphs(rows)
    assert flat.where("page_id = 1").count() == 5


def test_heading_rules_prefer_the_deepest_heading(spark):
    rules = spark.createDataFrame([("overview", 0, "^Überblick$"), ("history", 1, "geschichte"), ("other", 2, "^Über")], "slot string, slot_order int, pattern string")
    paths = spark.createDataFrame([(1, ["Überblick", "Geschichte der Optik"]), (2, ["Überblick:", "Sonstiges"]), (3, ["Sonstiges"]), (4, ["ÜBERBLICK"])], "id int, path array<string>")
    assert {r.id: r.slot for r in lexicon.classify(paths, rules, "id").collect()} == {1: "history", 2: "overview", 4: "overview"}


def test_policy_fixed_scores(spark):
    base = {"topic": "t", "is_primary": True, "origin": "primary", "source_role": "article", "title_has_topic": False, "topical": True, "is_section_lead": False, "is_lead": False, "lexicon_slot": None, "lexicon_defines": False, "heading_level": 2, "position": 3, "project": "w", "fused": 400_000}
    cases = {"lead": {"is_lead": True}, "weak": {}, "named": {"lexicon_slot": "k2"}, "twin": {"is_primary": False, "origin": "same_topic", "heading_level": 0, "position": 0}, "sub": {"is_primary": False, "origin": "linked", "heading_level": 0, "position": 0, "title_has_topic": True}}
    slots = [("s1", 0, "k1", "definition", []), ("s2", 1, "k2", "systematik", []), ("s3", 2, "k3", "", [])]
    rows = [{**base, **c, "chunk_id": name, "slot_id": s, "slot_order": o, "slot_key": k, "slot_role": r, "preference": p} for name, c in cases.items() for s, o, k, r, p in slots]
    schema = "topic string, is_primary boolean, origin string, source_role string, title_has_topic boolean, topical boolean, is_section_lead boolean, is_lead boolean, lexicon_slot string, lexicon_defines boolean, heading_level int, position int, project string, fused long, chunk_id string, slot_id string, slot_order int, slot_key string, slot_role string, preference array<string>"
    got = {r.chunk_id: (r.slot_id, r.score) for r in policy.assign(spark.createDataFrame(rows, schema), "s3").collect()}
    assert got == {"lead": ("s1", 2_000_000), "weak": ("s3", 250_000), "named": ("s2", 900_000), "twin": ("s1", 1_500_000), "sub": ("s2", 900_000)}


def test_bm25_counts_repeated_query_words(spark):
    chunks = spark.createDataFrame([("t", "a", "Licht Licht Linse"), ("t", "b", "Linse Spiegel"), ("u", "a", "Licht")], "topic string, chunk_id string, text string")
    slots = spark.createDataFrame([(1, "Licht"), (2, "Licht Licht"), (3, "der die das")], "slot_id long, text string")
    rows = {(r.slot_id, r.topic, r.chunk_id): r.score for r in ranking.bm25(slots, chunks).collect()}
    assert set(rows) == {(s, t, "a") for s in (1, 2) for t in "tu"}
    assert rows[2, "t", "a"] == 2 * rows[1, "t", "a"]


def test_text_helpers(spark):
    assert one(spark, X.marker_decoded, "a%253B%3B") == "a%3B;"
    assert one(spark, lambda t: X.marker_decoded(X.marker_encoded(t)), '%25;=|<>"') == '%25;=|<>"'
    assert one(spark, lambda t: X.padded_grams(t, (3, 4)), "Ab c") == [" ab", "ab ", " ab ", " c "]
    assert one(spark, X.is_fragment, "Die Formel lautet:") and not one(spark, X.is_fragment, "Kurz.")
    assert one(spark, X.token_estimate, "abcdef北") == 2 + 1 + 1


def test_unseen_sentences_equal_a_plain_loop(spark):
    from tessella.operators import selection

    rows = [("t", "c0", 0, True, ["a", "b", "a", "c"], ["a", "b", "a", "c"]), ("t", "c1", 1, False, ["b", "d", "e", "f", "g"], ["b", "d", "e", "f", "g"]), ("t", "c2", 2, False, ["g", "d"], ["g", "d"]), ("u", "c0", 0, False, [], [])]
    df = spark.createDataFrame(rows, "topic string, chunk_id string, order int, is_lead boolean, sentences array<string>, fingerprints array<string>")
    got = {}
    for r in selection.unseen_sentences(df).orderBy("topic", "chunk_id", "position").collect():
        got.setdefault((r.topic, r.chunk_id), []).append(r.sentence)
    assert got == {("t", "c0"): ["a", "b", "c"], ("t", "c1"): ["d", "e", "f"], ("t", "c2"): ["g"]}


def test_turns(spark):
    from tessella.operators import selection

    rows = [("t", "x", 0, "o1", "Q1"), ("t", "x", 1, "o1", "Q2"), ("t", "x", 2, "o2", "q1"), ("t", "x", 3, "o3", "Q3"), ("t", "y", 0, "o4", "Q4"), ("t", "y", 1, "o1", "Q5")]
    df = spark.createDataFrame(rows, "topic string, kind string, order int, origin string, question string")
    assert [r.question for r in selection.take_turns(df, 9, ["x", "y"]).orderBy("place").collect()] == ["Q1", "Q4", "Q3"]
    assert [r.question for r in selection.take_turns(df, 2, ["y", "x"]).orderBy("place").collect()] == ["Q4", "Q1"]


def test_topics(spark):
    from tessella.operators import topics

    assert one(spark, topics.without_prefix, " Thema:  Optik ") == "Optik" and one(spark, topics.without_prefix, "Physik: Optik") == "Physik: Optik"
    assert "Lineare Funktion" in one(spark, topics.variants, "Lineare Funktionen")
    assert one(spark, lambda t: topics.stems(F.split(t, " ")), "mathematik mathematisch feld ab") == ["feld", "mathemati"] or one(spark, lambda t: topics.stems(F.split(t, " ")), "mathematik mathematisch feld ab") == ["mathemati", "feld"]
    assert one(spark, lambda t: topics.is_iri(t), "https://d-nb.info/gnd/1") and not one(spark, lambda t: topics.is_iri(t), "https://a b")
    assert one(spark, N.sentences, "Eine Linse (lat. lens) ist ein Körper.") == ["Eine Linse (lat. lens) ist ein Körper."]
    assert one(spark, lambda t: N.definition(N.sentences(t)), "Kurz. Eine Linse (lat. lens) ist ein durchsichtiger Körper aus Glas.") == "Eine Linse ist ein durchsichtiger Körper aus Glas."


def test_first_sentences_end_at_the_limit(spark):
    from tessella.functions import markup

    assert one(spark, markup.first_sentence, "a" * 239 + ". Mehr.") == "a" * 239 + "."
    assert one(spark, markup.first_sentence, "a" * 240 + ". Mehr.") == "a" * 239 + "…"
    assert one(spark, markup.first_sentence, "eins zwei? drei") == "eins zwei?"


def test_best_and_totals_of_bm25_are_those_of_its_rows(spark):
    """What tasks keep for themselves is what a ranking of all rows gives, also with ties, many parts and repeated ids."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["licht", "linse", "prisma", "farbe", "auge", "glas"]) for _ in range(n))
    rows = [(t, f"c{i:03d}", prose(rng.randint(0, 6))) for t in "tu" for i in range(60)] + [("t", "c001", "Licht"), (None, "x", "Licht"), ("t", "y", None)]
    chunks = spark.createDataFrame(rows, "topic string, chunk_id string, text string")
    slots = spark.createDataFrame([(1, "Licht Farbe"), (2, "Glas Glas"), (3, "der die"), (4, None)], "slot_id long, text string")
    every = ranking.bm25(slots, chunks).collect()
    assert {(r.slot_id, r.topic) for r in every} == {(s, t) for s in (1, 2) for t in "tu"}
    for part_rows in (9, 1000):
        whole = {tuple(r) for r in ranking.bm25(slots, chunks, part_rows=part_rows).collect()}
        assert whole == {tuple(r) for r in every}
        totals = {(r.topic, r.slot_id): (r.n, r.total, r.best) for r in ranking.bm25(slots, chunks, "totals", part_rows=part_rows).collect()}
        best = {(r.slot_id, r.topic, r.chunk_id, r.share) for r in ranking.top_candidates(ranking.bm25(slots, chunks, "best", 3, part_rows), 3).collect()}
        assert len(totals) == 4 and len(best) == 12
        for (t, s), found in totals.items():
            mine = sorted((-r.score, r.chunk_id) for r in every if (r.slot_id, r.topic) == (s, t))
            assert found == (len(mine), -sum(a for a, _ in mine), -mine[0][0])
            assert {c for a, b, c, _ in best if (a, b) == (s, t)} == {c for _, c in mine[:3]}


def test_the_best_slot_of_a_chunk_is_that_of_all_scores(spark, monkeypatch):
    """Also of chunks that are far down in every slot's list, and with shares that are equal where scores are not."""
    rng = random.Random(6)
    words = [f"wort{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    chunks = spark.createDataFrame([(t, f"c{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for t in "tu" for i in range(90)] + [(None, "x", "worta"), ("t", "y", None)], "topic string, chunk_id string, text string")
    slots = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(1, 9)] + [(20, "worta wortb"), (21, "wortb worta")], "slot_id long, text string")
    every = ranking.bm25(slots, chunks).collect()
    largest = {t: max(r.score for r in every if r.topic == t) for t in "tu"}
    for part_rows, shares in ((9, 1_000_000), (1000, 1_000_000), (1000, 7)):
        monkeypatch.setattr(ranking, "SHARES", shares)
        want = {}
        for r in every:
            share = int((r.score * shares + largest[r.topic] / 2) // largest[r.topic])
            want[r.topic, r.chunk_id] = max(want.get((r.topic, r.chunk_id), (-1, 0)), (share, -r.slot_id))
        got = {(r.topic, r.chunk_id): (r.score, -r.slot_id) for r in ranking.best_of_all(ranking.bm25(slots, chunks, "chunks", part_rows=part_rows)).collect()}
        assert got == want and len(got) > 2 * ranking.CANDIDATES
    monkeypatch.undo()
    assert ranking.best_of_all(ranking.bm25(slots.where("false"), chunks, "chunks")).count() == 0


def test_the_default_slot_takes_all_chunks_with_a_word_of_a_slot(spark):
    import __spark_entry__ as entry

    every = entry.queries()["k1_bm25"](spark, "/root/testdata/sf0.001").groupBy("topic").agg(F.max("n").alias("n")).collect()
    rows = entry.queries()["k7_default_slot"](spark, "/root/testdata/sf0.001").groupBy("topic").count().collect()
    assert all(r["count"] >= max(e.n for e in every if e.topic == r.topic) for r in rows) and max(e.n for e in every) > ranking.CANDIDATES


@pytest.mark.parametrize("what", ["pages", "marks"])
def test_python_holds_some_texts_of_a_batch(what):
    import tracemalloc

    import pyarrow as pa

    from tessella.functions import markup

    texts = [f"<h1>T{i}</h1><p>{'Wu\u0308rde ' * 500}</p><h2>x</h2><p>y</p>" for i in range(4_000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["page_id", "html"])
    del texts
    tracemalloc.start()
    if what == "pages":
        parts = list(articles._parsed(iter([batch])))
        ids = [i for p in parts for i in p.column(0).to_pylist()]
        titles = [t for p in parts for t in p.column(1).to_pylist()]
        assert ids == list(range(4_002)) and titles[:4_000] == [f"T{i}" for i in range(4_000)] and titles[4_000:] == ["", ""]
    else:
        got = markup._composed(batch.column(1))
        assert len(got) == 4_002 and got[3].as_py().startswith("<h1>T3</h1><p>W\u00fcrde ") and got[4_000].as_py() is None and got[4_001].as_py() == ""
    # the texts are 18 MB in all, and two bytes a sign in Python
    assert tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()


def test_pieces_hold_all_rows():
    import pyarrow as pa

    for rows in ([], [None], ["", None, "a" * 30, "b", "c" * 9, None, "d"], ["x"] * 50):
        column = pa.array(rows, pa.string())
        assert [v for p in X.pieces(column, 10) for v in p.to_pylist()] == rows
        assert [v for p in X.pieces(column.slice(1), 10) for v in p.to_pylist()] == rows[1:]


def test_a_corpus_is_dealt_before_it_is_sorted(spark):
    from tessella.operators import resolution

    rows = lambda *r: spark.createDataFrame(r, "topic int, project string, title string, order long")
    first = rows((1, "p", "A", 0), (2, "p", "B", 0))
    links = rows((1, "p", "a", 1), (1, "p", "C", 2), (1, "p", "D", 3), (1, "p", "E", 4))
    found = resolution.corpus([("primary", first, None), ("linked", links, 2), ("hit", rows((1, "p", "e", 1), (1, "q", "c", 2), (2, "p", "X", 1)), None)], "topic", 4)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "p", "A", "primary", 1), (1, "p", "C", "linked", 2), (1, "p", "D", "linked", 3), (1, "q", "c", "hit", 4), (2, "p", "B", "primary", 1), (2, "p", "X", "hit", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "WindowGroupLimit" in plan
