"""Executors need no copy of the repository: a driver that finds it by its own path only, with workers that do not."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def known(_):
    import importlib.util
    yield importlib.util.find_spec("tessella") is not None
assert not any(spark.sparkContext.range(2, numSlices=2).mapPartitions(known).collect())

sys.path.insert(0, sys.argv[1])
from tessella.llm import bpe, decontam, htmltext, jaccard, langid, quality, repeats, simhash, spelling, tiff, whitening
from tessella.operators import articles, ngrams
docs = spark.createDataFrame([(i, "the cat sat on the mat number %d" % i, "en") for i in range(30)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
items = spark.createDataFrame([(1, "cat sat on the mat")], "item_id long, text string")
found = [
    bpe.encode_documents(docs), decontam.decontaminate(docs, items), langid.languages(docs, langid.train(docs)), quality.quality_scores(docs, labels),
    repeats.removed(docs, length=12, gram=4), simhash.near_duplicates(docs), docs.select(tiff.store_text(docs.text)),
]
assert [f.count() for f in found] == [30] * 7 and all(f.collect() for f in found)
assert len(jaccard.jaccard_classes(docs).collect()) == 30 and spelling.variants(spelling.occurrences(docs, length=3)).collect()
assert len(whitening.whiten(docs.selectExpr("doc_id AS vec_id", "array(doc_id * 0.5D, doc_id * doc_id * 0.1D) AS embedding")).collect()) == 60
pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "concat('<article><h1>t</h1><p>', text) AS html")
assert len(htmltext.extract(pages).collect()) == len(articles.parsed(pages).collect()) == 30
slots = spark.createDataFrame([(1, "the mat")], "slot_id long, text string")
assert ngrams.char_tfidf(slots, docs.selectExpr("lang AS topic", "cast(doc_id AS string) AS chunk_id", "text")).collect()
print("WORKED")
"""


def test_workers_without_the_repository(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "run.py").write_text(SCRIPT)
    run = subprocess.run([sys.executable, "run.py", repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "WORKED" in run.stdout, run.stderr[-3000:]
