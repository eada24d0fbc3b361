import random

import corpus_pipeline
from tessella.llm import repeats, shingles, simhash
from tessella.llm.common import write_and_read


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, item = prose(120), prose(30)
    clean = [prose(80) for _ in range(200)]
    junk = [" ".join(f"{word().upper()}!!" for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean + junk)]
    rows += [(1000, clean[0]), (1001, clean[1]), (1002, prose(40) + passage + prose(40)), (1003, prose(40) + passage + prose(40)), (1004, prose(40) + item + prose(40))]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i < 260], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = write_and_read(stage(spark, frame, str(tmp_path)))
        seen.append({r.doc_id: r for r in frame.collect()})
        if i < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen[0]) == set(range(200)) | set(range(1000, 1005))
    assert set(seen[1]) == set(seen[0]) - {1000, 1001}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][1002].text and len(seen[2][1002].text) == seen[2][1002].n_chars
    assert all(seen[2][i].text == clean[i] for i in range(200))
    assert set(seen[3]) == set(seen[2]) - {1004}
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_take_odd_and_empty_documents(spark, odd, empty, tmp_path):
    """Nulls in any column, repeated rows and ids, clashing names, very long texts, and tables without rows."""
    spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "same text twice here"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:4]:
            rows = stage(spark, docs, str(tmp_path))
            assert rows.columns == docs.columns and rows.count() <= docs.count()
        encoded = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
        assert encoded.count() == docs.count()
    clean = corpus_pipeline.decontamination_stage(spark, odd, str(tmp_path)).collect()
    assert len(clean) == odd.count() - 2 and all(r.doc_id != 5 or not (r.text or "").startswith("Same") for r in clean)


def test_what_is_not_computed_yet_keeps_its_tables(spark, tmp_path):
    """A result held while stages begin, and two pipelines in turns."""
    rng = random.Random(2)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(90))
    docs = spark.createDataFrame([(i, f"{passage} {i}" if i % 2 else f"{i} {passage} {passage[:i]}") for i in range(40)], "doc_id long, text string")
    held = repeats.removed(docs)
    near, repeated = corpus_pipeline.near_duplicate_stage, corpus_pipeline.repeats_stage
    one, two = repeated(spark, docs, ""), repeated(spark, docs.where("doc_id < 20"), "")
    first = write_and_read(one)
    further = near(spark, first, "")
    second = write_and_read(two)
    after = near(spark, second, "")
    assert held.count() == 40 and first.count() == 40 and second.count() == 20
    assert further.count() <= 40 and after.count() <= 20
    # two was computed, so its tables went with the last stage that began; a stage over a frame that is not written keeps what it needs
    chained = near(spark, repeated(spark, docs, ""), "")
    assert near(spark, docs, "").count() <= 40 and chained.count() <= 40


def test_near_duplicates_are_those_of_fingerprints_and_of_shingles(spark):
    """A chorus with other last lines has one fingerprint but few common shingles; a text with three other words has another fingerprint."""
    chorus, rng = " ".join(f"row{i}" for i in range(13)), random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    other = [f"x{w}" if i in (20, 21, 22) else w for i, w in enumerate(words)]
    rows = [(1, " ".join([chorus] * 60)), (2, " ".join([chorus] * 60) + " and then came one more line here that no other text has"), (3, " ".join(words)), (4, " ".join(other)), (5, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id for r in shingles.one_of_each(docs).collect()}
    alike = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert (near, alike) == ({1, 2, 3, 5}, {1, 3, 4, 5})
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3, 5}
