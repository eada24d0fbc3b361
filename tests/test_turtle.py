"""Turtle files that are cut anywhere give the same triples."""

import random

import pytest

from tessella.sources import dumps

TEXT = '''@prefix ex: <http://x/> .
<http://a/1> ex:name "one" ; ex:note """A literal with a stop .
and " .
<http://no> ex:no "no" .
# no comment
its end""" . # a comment . with "quotes
<http://a/2>
   ex:list <http://b/1> ,
      <http://b/2> ,
      "three . four" ;
   ex:size 1.5 ;
   ex:odd "a \\\\" , "b\\" ." .
<http://a/3> ex:name "x"@de. <http://a/4> ex:name "y".
ex:five ex:name """q""\\"""" .
'''


def triples(text):
    """All statements of a text read in one go."""
    out, state, held = set(), dumps.OUTSIDE, ""
    for line in text.split("\n"):
        parts, state = dumps.cut_line(line, state)
        for part in parts[:-1]:
            if not (held + part).lstrip().startswith("@"):
                out |= set(dumps.turtle_triples(held + part + " ."))
            held = ""
        held += parts[-1] + "\n"
    return out


@pytest.mark.parametrize("size", [1 << 20, 40, 150])
def test_any_cut_gives_the_same(spark, tmp_path, size):
    rng = random.Random(size)
    filler = "".join(f'<http://c/{i}> ex:v "{"z" * rng.randint(0, 30)}" .\n' for i in range(30))
    (tmp_path / "a.ttl").write_text(TEXT + filler)
    (tmp_path / "b.ttl").write_text(filler.replace("http://c", "http://d") + TEXT.replace("http://a", "http://e"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = [tuple(r) for r in dumps.turtle(spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert size > 1000 or parts > 5
    want = triples((tmp_path / "a.ttl").read_text()) | triples((tmp_path / "b.ttl").read_text())
    assert set(got) == want and ("http://a/1", "ex:note", 'A literal with a stop .\nand " .\n<http://no> ex:no "no" .\n# no comment\nits end') in want
    assert ("http://a/2", "ex:list", "three . four") in want and ("http://a/2", "ex:size", "1.5") in want and ("http://a/4", "ex:name", "y") in want
    assert {o for s, _, o in want if s == "http://a/2"} == {"http://b/1", "http://b/2", "three . four", "1.5", "a \\", 'b" .'}


def test_states_compose():
    for state in range(3):
        for a, b in (('x """ y', 'z """ . w'), ("a . b", "''' . '''"), ('"""', "'''")):
            parts, end = dumps.cut_line(a, state)
            assert dumps.cut_line(b, end)[1] in range(3) and len(parts) >= 1
    assert dumps.cut_line('a "b . c" <http://x.y/#z> . d', 0) == (['a "b . c" <http://x.y/#z> ', " d"], 0)
    assert dumps.cut_line("ex:a.b 1.5 . # rest .", 0) == (["ex:a.b 1.5 ", " "], 0)
