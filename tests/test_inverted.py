"""The index finds what a scan finds, and works out less."""

import random

import pytest

from tessella.operators import archive, inverted


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    vocabulary = [f"wort{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    rows = [(f"c{i:05d}", text(rng.randint(0, 40))) for i in range(3_000)] + [("none", None), ("empty", ""), ("rare", "einmalig wort1 wort1")]
    queries = [(1, "wort1 wort1 wort2"), (2, "einmalig wort1"), (3, "nirgends"), (4, ""), (5, "wort59 wort58 wort0"), (6, "wort0")]
    return spark.createDataFrame(rows, "chunk_id string, text string"), spark.createDataFrame(queries, "slot_id long, text string")


@pytest.mark.parametrize("block", [128, 16, 100_000])
def test_search_equals_a_scan(spark, corpus, tmp_path, block):
    articles, queries = corpus
    inverted.build(articles, str(tmp_path), block)
    want = {tuple(r) for r in archive.search(queries, articles, 7).select("slot_id", "chunk_id", "place", "score").collect()}
    for skipping in (True, False):
        assert {tuple(r) for r in inverted.search(spark, queries, str(tmp_path), 7, skipping).collect()} == want
    assert {k for k, *_ in want} == {1, 2, 5, 6}


def test_blocks_are_skipped_and_bounded(spark, corpus, tmp_path):
    articles, queries = corpus
    inverted.build(articles, str(tmp_path), 16)
    # a rare word decides; where frequent words do, bounds of blocks lie close together and less is skipped
    needed, all_ = inverted.skipped(spark, queries.where("slot_id = 2"), str(tmp_path), 1)
    assert needed < all_ / 4
    needed, all_ = inverted.skipped(spark, queries.where("slot_id IN (1, 5)"), str(tmp_path), 5)
    assert needed < all_
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/postings").selectExpr("size(chunks) AS n").collect()]
    assert max(sizes) < 16 * 3


def test_an_empty_corpus(spark, corpus, tmp_path):
    articles, queries = corpus
    inverted.build(articles.where("false"), str(tmp_path / "a"))
    inverted.build(articles.where("chunk_id = 'empty'"), str(tmp_path / "b"))
    assert inverted.search(spark, queries, str(tmp_path / "b")).count() == 0


def test_parts_of_chunks_and_little_shuffled(spark, corpus, tmp_path):
    articles, queries = corpus
    doubled = articles.unionByName(spark.createDataFrame([("c00007", "wort1 wort1 wort59")], articles.schema))
    want = {tuple(r) for r in archive.search(queries, articles, 7).select("slot_id", "chunk_id", "place", "score").collect()}
    inverted.build(articles, str(tmp_path / "a"), 16, part_rows=200)
    assert spark.read.parquet(f"{tmp_path}/a/postings").select("part").distinct().count() == 16
    for skipping in (True, False):
        found = inverted.search(spark, queries, str(tmp_path / "a"), 7, skipping)
        assert {tuple(r) for r in found.collect()} == want
    # postings meet by part once; nothing is joined by term or chunk
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    inverted.build(doubled, str(tmp_path / "b"), 16, part_rows=200)
    held = spark.read.parquet(f"{tmp_path}/b/postings").where("term IS NULL").selectExpr("explode(ids) AS id")
    assert held.count() == held.distinct().count() == 3_002
