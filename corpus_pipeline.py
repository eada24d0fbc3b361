"""A training-data pipeline over documents: five stages, each one of the operators in tessella.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; between stages the rows are written as Parquet
and read again, so an executor's loss repeats one stage at most and no lineage grows over the pipeline. A stage
owns the tables that it writes for itself. They go when a later stage begins and the rows of the stage have been
computed: its frame is to be written once and read again from there. What another pipeline in the same driver has
not computed yet stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, quality, repeats, shingles, simhash
from tessella.llm.common import cut, delete, done, owning, table, tables, write_and_read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: For each stage that may still be computed: what tells that its rows have been, and the tables that it owns.
_HELD: list[tuple[Observation, list[str]]] = []


def _release(spark: SparkSession, docs: DataFrame) -> list[str]:
    """Delete the tables that only stages own whose rows are computed; those that docs is read from stay, and are returned."""
    needed = tables(docs)
    read = {p for _, paths in _HELD for p in paths if p.rsplit("/", 1)[1] in needed}
    over = [held for held in _HELD if held[0]._jo.future().isCompleted()]
    stay = read.union(*(paths for seen, paths in _HELD if (seen, paths) not in over))
    for seen, paths in over:
        delete(spark, [p for p in paths if p not in stay])
        paths[:] = [p for p in paths if p in stay]
        if not paths:
            _HELD.remove((seen, paths))
    return sorted(read)


def stage(run: Stage) -> Stage:
    """The stage as an owner of its tables."""

    @wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        kept = _release(spark, docs)
        with owning() as paths:
            rows = run(spark, docs, sf_dir)
        if kept + paths:
            seen = Observation()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
            _HELD.append((seen, kept + paths))
        return rows

    return begun


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of its own input."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of those that SimHash fingerprints link (op6: two or fewer differing bits),
    and of what is left by five-word shingles (similarity of 0.8 or more), which find copies of more differing bits. It is the
    one of least id (of repeated ids one row)."""
    return shingles.one_of_each(cut(simhash.one_of_each(docs)))


@stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without byte strings that repeat: of op4's length, or of over 50 words."""
    kept = repeats.without_repeats(docs, words=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document, with the digests of a decoding."""
    return bpe.encode_documents(docs, keep=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: The trees, the components and the encoding are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, run_stage) in enumerate(STAGES):
        if i:
            rows = write_and_read(docs)
            if i > 1:
                done(before)
            docs = before = rows
        docs = run_stage(spark, docs, sf_dir)
    return docs
