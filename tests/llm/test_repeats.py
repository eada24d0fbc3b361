import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import repeats
from tessella.llm.common import SpanHash
from tessella.llm.suffixes import repeated, suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(60):
        text = rng.integers(0, rng.choice([2, 3, 256]), rng.integers(0, 150)).astype(np.uint8)
        if trial % 5 == 0 and len(text):
            text = np.tile(text[: max(1, len(text) // 7)], 7)
        raw, n = text.tobytes(), len(text)
        order = suffix_array(text, 400, SpanHash())
        assert order.tolist() == sorted(range(n + 1), key=lambda i: raw[i:])
        for depth in (3, 7, 10):
            valid = (rng.random(n) < 0.9) & (np.arange(n) + depth <= n)
            weight = rng.integers(1, 3, n)
            count = Counter()
            for i in np.flatnonzero(valid):
                count[raw[i : i + depth]] += weight[i]
            assert repeated(text, valid, weight, depth, SpanHash()).tolist() == [bool(v and count[raw[i : i + depth]] > 1) for i, v in enumerate(valid)]


def planted(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [text(60), text(35), text(120), "ab" * 50, "z" * 90]
    texts = [None, "", *[text(rng.randint(0, 80)) + rng.choice(shared)[rng.randint(0, 20) :] + text(rng.randint(0, 80)) for _ in range(120)]]
    return texts + texts[:15]


@pytest.mark.parametrize("hot", [2000, 1])
def test_removed_bytes_equal_brute_force(spark, hot):
    texts = planted(hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    rows = {r.doc_id: tuple(r)[1:] for r in repeats.removed(docs, length=40, gram=8, hot=hot).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, 40)


def test_odd_documents_at_full_length(odd, empty):
    rows = repeats.removed(odd).collect()
    texts = [r.text for r in odd.collect()]
    assert Counter(tuple(r)[1:] for r in rows) == Counter(brute(texts, 400))
    assert repeats.removed(empty).count() == 0


def test_remaining_text_keeps_whole_signs(spark):
    shared = "ü" * 30
    docs = spark.createDataFrame([(1, "a" + shared + "ö", 1), (2, "b" + shared + "ü", 2), (3, None, 3)], "doc_id long, text string, _kept long")
    rows = {r.doc_id: r for r in repeats.without_repeats(docs, length=20, gram=8).collect()}
    assert rows[3].text is None and rows[1]._kept == 1
    assert rows[1].text[0] == "a" and rows[1].text[-1] == "ö" and "ü" not in rows[1].text[1:-1]


def test_query_gives_the_text_without_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("aeioustn") for _ in range(rng.randint(1, 8))) for _ in range(n))
    short, long, line = prose(55), prose(120), prose(40)
    assert len(short) < 400 < len(long)
    texts = [f"{prose(30)} zebra{i} {p} {i}yak {prose(30)}" for i, p in enumerate((short, short, long, long, line, line))] + [prose(90), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    result = repeats.op4_suffix_dedup(spark, str(tmp_path))
    assert result.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    rows = {r.doc_id: r for r in result.collect()}
    # numbers and digest are those of 400 bytes, which a passage of 55 short words does not have
    assert [tuple(rows[i])[1:5] for i in range(len(texts))] == brute(texts, 400)
    assert [rows[i].n_removed > 0 for i in range(len(texts))] == [i in (2, 3) for i in range(len(texts))]
    for i, t in enumerate(texts):
        if i < 4:
            a, b = t.split(" zebra")[0] + f" zebra{i}", f"{i}yak" + t.split("yak")[1]
            assert rows[i].text.startswith(a) and rows[i].text.endswith(b) and short not in rows[i].text and long not in rows[i].text
            assert len(rows[i].text.split()) <= 62
        else:
            assert rows[i].text == t
