"""Named ways to rank chunks against slots, and one run of several of them over the same chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import ngrams as G
from tessella.operators import ranking as R
from tessella.operators.scoring import Sink, merged, schema

MIN_SIMILARITY = 0.1
LEXICON_SHARE = 900_000
#: Chunks whose vectors are multiplied at once, and topics whose scores a task holds.
VECTORS_TOGETHER, TOPICS_HELD = 1_000, 200


def embedding(slots: DataFrame, chunks: DataFrame, least: float = MIN_SIMILARITY, what: str = "rows", n: int = R.CANDIDATES) -> DataFrame:
    """(slot_id, topic, chunk_id, score): cosine of vectors over least, in millionths.

    slots (slot_id, vector) is a template's, of bounded size, and goes with the function as one matrix; chunks
    (topic, chunk_id, vector) meet it a few at a time, so nothing is shuffled. what is `rows`, `best` (the n best chunks of each
    slot and some more, for a ranking that follows) or `totals` (slot_id, topic, n, total, best).
    """
    asked = slots.orderBy("slot_id").collect()
    slot_ids, slot_type, chunk_type = [r.slot_id for r in asked], slots.schema["slot_id"].dataType, chunks.schema["chunk_id"].dataType
    matrix = np.array([r.vector for r in asked], np.float64).reshape(len(asked), -1)
    matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-9)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sinks: dict[str | None, Sink] = {}
        for whole in batches:
            for a in range(0, len(whole) if slot_ids else 0, VECTORS_TOGETHER):
                batch = whole.slice(a, VECTORS_TOGETHER)
                batch = batch.filter(batch.column(2).is_valid())
                if not len(batch):
                    continue
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                vectors = flat.reshape(len(batch), -1)
                vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-9)[:, None]
                value = vectors @ matrix.T
                hit = value > least
                score = np.floor(np.where(hit, value, 0) * 1e6 + 0.5).astype(np.int64)
                topics = batch.column(0).dictionary_encode()
                of = topics.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for t in np.unique(of).tolist():
                    name, at = topics.dictionary[t].as_py() if t >= 0 else None, np.flatnonzero(of == t)
                    sinks.setdefault(name, Sink(what, slot_ids, slot_type, chunk_type, n)).add(batch.column(1).take(pa.array(at)), score[at], hit[at])
                if what == "rows" or len(sinks) > TOPICS_HELD:
                    for name, sink in sinks.items():
                        yield from sink.table(name).to_batches()
                    sinks = {}
        for name, sink in sinks.items():
            yield from sink.table(name).to_batches()

    found = chunks.select(F.col("topic").cast("string").alias("topic"), "chunk_id", "vector").mapInArrow(run, schema(what, slots, chunks))
    return merged(found, what)


def by_lexicon(named: DataFrame) -> DataFrame:
    """Candidates of the heading lexicon alone: (topic, slot_id, chunk_id, share) of rows (topic, chunk_id, slot_id)."""
    return named.where("slot_id IS NOT NULL").select("topic", "slot_id", "chunk_id", F.lit(LEXICON_SHARE).cast("long").alias("share"))


@dataclass
class Inputs:
    """What strategies rank: slots (slot_id, text), chunks (topic, chunk_id, text) and, where they have them, vectors of
    both and the slots that headings name."""

    slots: DataFrame
    chunks: DataFrame
    slot_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    named: DataFrame | None = None


def _bm25(i: Inputs) -> DataFrame:
    return R.top_candidates(R.bm25(i.slots, i.chunks, "best"))


def _chars(i: Inputs) -> DataFrame:
    return R.top_candidates(G.char_tfidf(i.slots, i.chunks, what="best"))


def _hybrid(i: Inputs) -> DataFrame:
    votes = {"bm25": _bm25(i), "char": _chars(i)}
    if i.slot_vectors is not None and i.chunk_vectors is not None:
        votes["embedding"] = R.top_candidates(embedding(i.slot_vectors, i.chunk_vectors, what="best"))
    return R.fuse(votes).withColumnRenamed("score", "share")


def _lexicon(i: Inputs) -> DataFrame:
    return by_lexicon(i.named)


#: Each strategy gives (topic, slot_id, chunk_id, share) of its candidates.
STRATEGIES: dict[str, Callable[[Inputs], DataFrame]] = {"lexicon_only": _lexicon, "bm25": _bm25, "char_tfidf": _chars, "hybrid_light": _hybrid}


def ranked(name: str, inputs: Inputs) -> DataFrame:
    """The candidates of a strategy; an unknown name is an error."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy is named {name}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name](inputs).select("topic", "slot_id", "chunk_id", "share")


def predictions(candidates: DataFrame) -> DataFrame:
    """(topic, chunk_id, slot_id): the best slot of each chunk that is a candidate at all."""
    return R.best_slot(candidates.withColumnRenamed("share", "score")).select("topic", "chunk_id", "slot_id")


def compared(names: list[str], inputs: Inputs) -> DataFrame:
    """(strategy, topic, chunk_id, slot_id): the predictions of several strategies over one set of chunks."""
    return reduce(DataFrame.unionByName, [predictions(ranked(n, inputs)).withColumn("strategy", F.lit(n)) for n in names])
