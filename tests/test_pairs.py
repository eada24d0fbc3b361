import re

from tessella.plans.registry import QUERIES


def test_whole_texts_equal_a_plain_loop(spark, tmp_path):
    texts = ["1. What?; That; 3\nno pair\n- Why ?;Because ;", "a;b;c;d\n;x\ny;", "2) q", "* one\ntwo; " + "z" * 500, "", None, "\n\n3. x;y"]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for _, turn, role, text in rows:
        for at, line in enumerate([] if text is None else f"{text};{role};".split("\n")):
            parts = [p.strip(" ") for p in line.split(";")]
            if len(parts) >= 2 and parts[0] and parts[1]:
                want.append((1, turn, at, re.sub(r"^\s*(?:\d+[.)]|[-*•])\s*", "", parts[0]), parts[1][:400], (parts[2] if len(parts) > 2 else "") or None))
    got = sorted(tuple(r) for r in QUERIES["h29_pairs_whole"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and len({r[2] for r in got}) > 1
