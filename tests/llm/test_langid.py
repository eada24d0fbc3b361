import random

import numpy as np
import pytest

from tessella.llm import langid

WORDS = {"en": "the of and to in that it was for with thing other when", "de": "der die und das nicht sich mit auf eine für über schön", "fr": "le la les des est une dans qui pour pas sur être très"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(360):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 60))), lang, lang))
    rows += [(1000, "the of", None, None), (1001, None, "en", None), (1002, "12 34 !?", "de", None), (1003, "", "fr", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_undetermined(docs):
    rows = {r.doc_id: r for r in langid.languages(docs, langid.train(docs)).collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id < 1000]
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    for i in (1001, 1002, 1003):
        assert rows[i].lang_pred == "und" and rows[i].score == 0
    assert rows[1000].lang_pred == "en"


def test_odd_documents_and_nothing_to_learn(odd, empty):
    model = langid.train(odd)
    rows = langid.languages(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "und"}
    assert langid.languages(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.languages(odd, langid.train(empty)).collect()} == {"und"}


def test_grams_of_a_word():
    letters = langid.letter_classes()
    assert len(langid.grams("ab".encode(), letters)) == 2 + 3 + 2 + 1
    assert len(langid.grams(b"12", letters)) == 0
    assert (np.sort(langid.grams(b"AB", letters)) == np.sort(langid.grams(b"ab", letters))).all()


def plain_grams(text):
    """Buckets of all subwords, sign by sign."""
    signs = [c if c.isalpha() else "\0" for c in text.lower()]
    signs = ["\0", *signs, "\0"]
    out = []
    for n in langid.ORDERS:
        for i in range(len(signs) - n + 1):
            part = signs[i : i + n]
            if all(c == "\0" for c in part):
                continue
            h = 0
            for k, c in enumerate(part):
                h = (h * 0x01000193 + ord(c) + k + 1) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> 17)
    return sorted(out)


def test_subwords_and_predictions_equal_plain_loops(docs):
    letters, model = langid.letter_classes(), langid.train(docs)
    for text in ("Über die Brücke", "a1 b", "the of \U0001f600 and", "x"):
        found = langid.grams(text.encode(), letters)
        assert sorted(found.tolist()) == plain_grams(text)
        raw = [sum(float(model.weights[g, k]) for g in plain_grams(text)) / len(found) + float(model.bias[k]) for k in range(len(model.names))]
        e = [np.exp((v - max(raw)) / model.temperature) for v in raw]
        (name,), (score,) = model.predict([text.encode()], letters)
        assert name == model.names[int(np.argmax(raw))] and abs(score - max(e) / sum(e)) < 1e-5


def test_samples_are_the_least_of_each_language(docs, spark):
    for limit in (1, 7):
        model = langid.train(docs, per_language=limit, max_rows=3 * limit)
        assert len(model.names) <= 3
    rows = docs.where("lang IS NOT NULL AND doc_id % 3 = 0").selectExpr("doc_id", "text", "'x' AS lang")
    assert langid.train(rows, per_language=5).names == ["x"]
