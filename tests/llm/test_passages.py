import random
from collections import Counter

import corpus_pipeline


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustn") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    letters = " ".join(rng.choice("abcdefgh") for _ in range(51))
    gone = [prose(n) for n in range(51, 61)] + [letters]
    stay = [prose(n) for n in (20, 40, 48)]
    own, texts = [], []
    for p in gone + stay:
        assert len(p) < 400
        for _ in range(2 + rng.randint(0, 3)):
            own.append((prose(30) + ' zebra' + str(len(own)), 'yak' + str(len(own)) + ' ' + prose(30)))
            texts.append(f"{own[-1][0]} {p} {own[-1][1]}")
    # after a full stop and before another sign, a passage that overlaps another one, and copies of a whole text
    texts += [prose(30) + "." + gone[0] + ".(" + prose(30), "x " + gone[1] + " " + gone[2], texts[3], None, "", prose(60)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in corpus_pipeline.repeats_stage(spark, docs, "").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        kept = rows[i].text
        assert (kept is None) == (t is None) and rows[i].n_chars == (None if t is None else len(kept))
        assert not any(p in (kept or "") for p in gone)
        if i < len(own) and Counter(texts)[t] == 1:
            a, b = own[i]
            assert kept.startswith(a) and kept.endswith(b)
            assert kept == t if any(p in t for p in stay) else len(kept.split()) <= 62
    assert rows[len(texts) - 1].text == texts[-1]
