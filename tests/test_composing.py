"""Edge cases of archives, markup, requests, answers and composed texts that the query tables do not hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import markup as M
from tessella.functions import sentences as N
from tessella.operators import answers as W
from tessella.operators import archive as A
from tessella.operators import compose as C
from tessella.operators import ngrams as G
from tessella.operators import ranking as R
from tessella.operators import requests as Q
from tessella.operators import resolution as L
from tessella.operators import subjects as S
from tessella.sources import configs


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_texts_of_any_signs_read_back(spark):
    rng = random.Random(3)
    texts = [None, "", *["".join(rng.choice("ab1 \t\n.)#*_[]`\\<>&;!|-+=~:/x") for _ in range(rng.randint(1, 40))) for _ in range(300)]]
    assert column(spark, texts, lambda t: M.unescaped(M.escaped(t))) == texts
    for text, shown in zip(texts, column(spark, texts, M.escaped), strict=True):
        if text:
            assert not re.search(r"(?<!\\)(?:\\\\)*[\[\]*`]", re.sub(r"\\[\[\]*`\\]", "", shown))


def test_short_texts(spark):
    assert column(spark, [None, "", "(a(b)c)d", "x (y", "((z))"], M.without_brackets) == [None, "", "d", "x (y", ""]
    assert column(spark, ["a" * 401, "b " * 300, "c"], M.lead) == ["a" * 399 + "…", ("b " * 300).strip()[:399].rstrip() + "…", "c"]
    assert column(spark, ["&#0;&#1114112;&#x1F600;&amp;lt;&unknown;", None], M.tidy) == ["&#0;&#1114112;\U0001f600&lt;&unknown;", None]
    assert column(spark, ["59s", "60s", "1M", "2 h", "-1d", "1w", None], M.interval_seconds) == [None, 60, 60, 7200, None, None, None]
    assert column(spark, [[], ["A"], ["A", "B"], ["A", "B", "C"]], M.listed, "array<string>") == ["", "A", "A und B", "A, B und C"]
    assert column(spark, ["HTTP://x", "ftp://x", None, "http://a b"], M.web_target) == ["HTTP://x", None, None, "<http://a b>"]
    assert column(spark, ["a", "``", "b`"], M.code_span) == ["`a`", "``` `` ```", "`` b` ``"]


def test_pieces_end_at_sentences(spark):
    split = lambda t: F.filter(F.split(t, r"(?<=\.) "), lambda s: s != "")
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abc ") for _ in range(rng.randint(5, 90))).strip() + "." for _ in range(200))
    (pieces,) = column(spark, [text], lambda t: Q.packed(split(t), 120))
    assert all(len(p) <= 120 for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)
    assert column(spark, ["x" * 250, ""], lambda t: Q.packed(split(t), 100)) == [["x" * 100, "x" * 100, "x" * 50], []]


def test_notices_and_texts_about_cookies(spark):
    texts = ["Wir nutzen Cookies.", "Cookies sind Dateien.", "Hier nutzen wir die Entwicklertools des Browsers, um die Cookies anzusehen.", "Unsere Cookies werden genutzt. Diese Seite hat cookies, die verwendet werden.", "", None]
    assert column(spark, texts, lambda t: F.coalesce(S.is_notice(t, N.sentences(t)), F.lit(False))) == [True, False, False, True, False, False]


@pytest.mark.parametrize(("pattern", "safe"), [("^(a|b)+$", True), ("(a+)+", False), (r"(\d+)*x", False), ("(a+){2,}", False), ("(a+){2}", True), ("[(+)]+", True), (r"\(+\)+", True), ("(a?b){1,3}", True), ("((ab)*c)+", False), ("(a|b+)*", False), ("a{2,5}b*", True)])
def test_patterns_that_could_run_forever(pattern, safe):
    assert configs.is_safe_pattern(pattern) is safe


def brute_placed(text, words):
    taken, out = [], {}
    free = lambda a, b: not any(a < y and x < b for x, y in taken)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        tries = [rf"(?<!\w){re.escape(w)}(?!\w)", rf"(?i)(?<!\w){re.escape(w)}(?!\w)", re.escape(w), rf"(?i){re.escape(w)}"]
        hidden = "".join("\0" if any(x <= i < y for x, y in taken) else c for i, c in enumerate(text))
        at = next((m.start() for p in tries if (m := re.search(p, hidden))), -1)
        out[w] = at
        if at >= 0:
            assert free(at, at + len(w))
            taken.append((at, at + len(w)))
    return out


def test_words_are_placed_like_a_plain_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abAB.") for _ in range(rng.randint(1, 4)))
    cases = [(" ".join(word() for _ in range(rng.randint(0, 12))), [word() for _ in range(rng.randint(1, 5))]) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(cases)], "i int, t string, w array<string>")
    for r in rows.select("i", L.placed(F.col("t"), F.col("w")).alias("p")).collect():
        assert {x.word: x.start for x in r.p} == brute_placed(*cases[r.i])


def test_runs_have_the_places_of_their_words(spark):
    text = "Über das Deutsche Museum, in München-Ost (Bayern)"
    (found,) = column(spark, [text], L.runs)
    assert all(text[r.start : r.end] == r.text for r in found)
    assert {"Deutsche Museum", "Museum", "München-Ost", "Über das Deutsche Museum"} <= {r.text for r in found} and not any(r.text.startswith("das") for r in found)
    assert column(spark, ["", "klein"], L.runs) == [[], []]


def test_answers_that_are_none(spark):
    texts = [None, "", "{}", '{"saetze": []}', '{"a": {"b": [1]}}', "{" * 50, '{"saetze": ["a]b", "c"]}']
    assert column(spark, texts, W.selected_numbers) == [None, None, None, [], ["1"], None, ["a]b", "c"]]
    assert column(spark, ["A. B", "", "nur", "1. Satz.\n- Punkt", "Ende."], W.without_unfinished) == ["A.", "", "", "1. Satz.", "Ende."]


def test_empty_tables_give_empty_results(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    slots, chunks = none("slot_id long, text string"), none("topic string, chunk_id string, text string")
    assert R.bm25(slots, chunks).count() == 0 and G.char_tfidf(slots, chunks).count() == 0
    assert A.suggestions(none("prefix string"), none("title string")).count() == 0
    assert A.concepts(none("json string")).count() == 0
    assert L.resolve(none("id long, topic string"), "id", none("title string, is_disambiguation boolean")).count() == 0
    assert C.extractive(none("d long, order int, chunk_id string, kind string, text string, is_lead boolean, sentences array<string>"), ["d"])[0].count() == 0
    assert Q.bounded_paths(none("child long, parent long"), none("start long"), 3).count() == 0


def test_char_tfidf_of_odd_chunks(spark):
    slots = spark.createDataFrame([(1, "Licht und Schatten"), (2, None), (3, "")], "slot_id long, text string")
    chunks = spark.createDataFrame([("t", "a", "licht und schatten"), ("t", "b", None), ("t", "c", " \n "), ("u", "d", "x"), ("t", "e", "Lichtschatten " * 5_000)], "topic string, chunk_id string, text string")
    found = {(r.topic, r.chunk_id, r.slot_id): r.score for r in G.char_tfidf(slots, chunks).collect()}
    assert found[("t", "a", 1)] == 1_000_000 and 0 < found[("t", "e", 1)] < 1_000_000 and len(found) == 2
    small = {(r.topic, r.chunk_id, r.slot_id): r.score for r in G.char_tfidf(slots, chunks, part_rows=1).collect()}
    assert small == found


def test_composed_documents_read_back(spark):
    rows = [("d", 1, "a", "kept", "Eins *", "Text [1]."), ("d", 2, "b", "empty", "Zwei", ""), ("e", 1, "a", "generated", "Eins", "x\n\n## nicht\n\ny")]
    sections = spark.createDataFrame(rows, "d string, order int, slot string, status string, title string, text string")
    docs = C.assembled(sections, "d", {"topic": F.col("d")})
    back = {(r.d, r.slot): r for r in C.parsed_sections(docs, "d").collect()}
    assert set(back) == {("d", "a"), ("d", "b"), ("e", "a")} and all(r.untouched for r in back.values())
    assert back[("e", "a")].body == "x\n\n## nicht\n\ny" and back[("d", "b")].body == ""


def test_skipped_parts_of_articles(spark):
    from tessella.operators.articles import parsed

    html = '<body class="metadata"><h1>T</h1><p>one</p><div class="infobox_x">no</div><div id="siteNotice"><p>no</p></div><span class="mw-jump-link">no</span><p>two<span class="noexcerpt">no</span></p><p><a href="Media:x">m</a></p></body>'
    (row,) = parsed(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [p.text for s in row.sections for p in s.paragraphs] == ["one", "two", "m"] and not any(s.links for s in row.sections)


def test_best_and_totals_of_grams_are_those_of_their_rows(spark):
    texts = ["licht linse", "licht", "schatten", "linse licht prisma", "auge", "licht"]
    chunks = spark.createDataFrame([(t, f"c{i}", x, [float(i), 1.0]) for t in "tu" for i, x in enumerate(texts)], "topic string, chunk_id string, text string, vector array<double>")
    slots = spark.createDataFrame([(1, "Licht", [1.0, 0.5]), (2, "Prisma Auge", [0.0, 1.0])], "slot_id long, text string, vector array<double>")
    for run in (lambda **k: G.char_tfidf(slots, chunks, part_rows=4, **k),):
        every = run().collect()
        totals = {(r.slot_id, r.topic): (r.n, r.total, r.best) for r in run(what="totals").collect()}
        best = {(r.slot_id, r.topic, r.chunk_id) for r in R.top_candidates(run(what="best", n=2), 2).collect()}
        assert totals and set(totals) == {(r.slot_id, r.topic) for r in every}
        for key, found in totals.items():
            mine = sorted((-r.score, r.chunk_id) for r in every if (r.slot_id, r.topic) == key)
            assert found == (len(mine), -sum(a for a, _ in mine), -mine[0][0])
            assert {c for *k, c in best if tuple(k) == key} == {c for _, c in mine[:2]}
