from tessella.operators import selection
from tessella.plans.registry import QUERIES


def plain(rows, count, kinds, fillers, again):
    used, asked, out = set(), set(), []
    for turns, repeat in ((kinds, False), (fillers, False), (kinds if again else [], True)):
        pools = {k: [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == k] for k in turns}
        progress = True
        while progress and len(out) < count:
            progress = False
            for k in turns:
                while pools[k] and len(out) < count:
                    _, _, origin, question = pools[k].pop(0)
                    if (repeat or origin not in used) and question.casefold() not in asked:
                        used.add(origin)
                        asked.add(question.casefold())
                        out.append((origin, question))
                        progress = True
                        break
    return out


def test_fillers_and_second_questions(spark):
    rows = [("x", 0, "a", "Q1"), ("x", 1, "a", "Q2"), ("y", 2, "a", "Q3"), ("f", 3, "b", "q1"), ("f", 4, "b", "Q4"), ("y", 5, "c", "Q5"), ("x", 6, "c", "q5"), ("x", 7, "a", "Q6")]
    df = spark.createDataFrame([("t", *r) for r in rows], "topic string, kind string, order int, origin string, question string")
    for count in range(1, 9):
        for fillers, again in (((), False), (("f",), False), (("f",), True), ((), True)):
            got = selection.take_turns(df, count, ["x", "y"], fillers, again).orderBy("place").collect()
            assert [(r.origin, r.question) for r in got] == plain(rows, count, ["x", "y"], fillers, again)


def test_turns_that_begin_alike_stay_apart(spark, tmp_path):
    text = "the same sixty signs at the begin of each of these long questions, "
    rows = [(1, t, "user", text + str(t)) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["e5_turns"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r.question for r in found] == [text + str(t) for t in (0, 2, 1, 3)]
