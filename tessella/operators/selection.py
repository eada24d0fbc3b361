"""Selections that depend on what was taken before: sentences once per text, questions in turns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import cut, table


#: What is known of a sentence; one that was printed is old when all that wait have been told.
UNKNOWN, PRINTED, LEFT, OLD = 0, 1, 2, 3


def _settled(state: DataFrame) -> DataFrame:
    """One round over chunks (at, most, marks, status): what is known of each sentence after it. A mark is null if no other sentence has it.

    A sentence is left if its mark is printed before it or its chunk is full, and printed if no earlier one of its mark can
    be printed any more and all sentences before it in its chunk are settled.
    """
    each = state.select("at", F.posexplode(F.arrays_zip("marks", "status")).alias("i", "s")).select(F.struct("at", "i").alias("place"), "s.marks", "s.status").where(F.col("marks").isNotNull() & F.col("status").isin(UNKNOWN, PRINTED))
    earliest = lambda kind: F.min(F.when(F.col("status") == kind, F.col("place")))
    firsts = each.groupBy("marks").agg(earliest(PRINTED).alias("printed"), earliest(UNKNOWN).alias("unknown")).where("unknown IS NOT NULL")
    met = each.where(F.col("status") == UNKNOWN).join(firsts, "marks")
    seen = F.coalesce(F.col("printed") < F.col("place"), F.lit(False))
    told = met.select("place.at", F.struct(F.col("place.i").alias("i"), F.struct(seen.alias("seen"), (F.col("unknown") == F.col("place")).alias("first")).alias("told")).alias("entry"))
    told = told.groupBy("at").agg(F.map_from_entries(F.collect_list("entry")).alias("told"))

    def step(acc: Column, i: Column) -> Column:
        before, of = F.get(F.col("status"), i), F.col("told")[i]
        known = F.when(before == PRINTED, OLD).when(before != UNKNOWN, before)
        # nothing is told of a sentence without another of its mark
        seen, first = F.coalesce(of["seen"], F.lit(False)), F.coalesce(of["first"], F.lit(True))
        now = F.coalesce(known, F.when(seen | (acc["taken"] >= F.col("most")), LEFT).when(acc["sure"] & first, PRINTED).otherwise(UNKNOWN))
        return F.get(F.transform(F.array(now), lambda n: F.struct((acc["taken"] + n.isin(PRINTED, OLD).cast("int")).alias("taken"), (acc["sure"] & (n != UNKNOWN)).alias("sure"), F.concat(acc["status"], F.array(n)).alias("status"))), 0)

    start = F.struct(F.lit(0).alias("taken"), F.lit(True).alias("sure"), F.array().cast("array<int>").alias("status"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size("marks") - 1), start, step, lambda acc: acc["status"])
    return state.join(told, "at", "left").select("at", "most", "marks", folded.alias("status"))


def unseen_sentences(chunks: DataFrame, limit: int = 3, lead_limit: int = 5) -> DataFrame:
    """(topic, chunk_id, position, sentence): per chunk the first sentences that no earlier chunk printed.

    chunks has (topic, chunk_id, order, is_lead, sentences, fingerprints). A chunk stops at its limit, and what it
    does not reach stays unseen for later chunks. Where no sentence of a chunk has its mark in common with another sentence of
    the topic, its first ones are printed, and nobody waits for it. All other chunks of all topics are settled at once, round by
    round, until nothing is unknown: the earliest chunk that still waits is settled in each round, in practice almost all are
    after a few, and a chunk goes no further when those that wait for it have been told. No topic is gathered; a chunk's
    own sentences are one row. Texts are written once, as a compressed table, and shuffled once; marks are 128 bits.
    """
    row = F.monotonically_increasing_id().alias("row")
    mark = lambda f: F.coalesce(f, F.lit("\0"))
    marks = F.transform("fingerprints", lambda f: F.struct(F.xxhash64("topic", mark(f)).alias("h"), F.xxhash64(F.lit(1), mark(f), F.col("topic")).alias("g")))
    rows = chunks.where(F.col("topic").isNotNull()).select("topic", "chunk_id", "order", row, F.when(F.col("is_lead"), lead_limit).otherwise(limit).alias("most"), "sentences", marks.alias("marks"))
    # a filter before the table would cut the texts into sentences once more
    rows = rows.transform(table).where(F.size("marks") > 0)
    each = rows.select("row", F.posexplode("marks").alias("i", "m")).select("row", "i", "m.h", "m.g")
    repeated = each.groupBy("h").count().where("count > 1").select("h")
    shared = each.join(repeated, "h", "left_semi").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("h", "g")))).alias("shared"))
    at = F.struct("order", "chunk_id", "row").alias("at")
    state = rows.select("row", "order", "chunk_id", "most", F.size("marks").alias("n")).join(shared, "row")
    places = F.sequence(F.lit(0), F.col("n") - 1)
    state = state.select(at, "most", F.transform(places, lambda i: F.col("shared")[i]).alias("marks"), F.transform(places, lambda _: F.lit(UNKNOWN)).alias("status"))
    settled = []
    while True:
        state = _settled(state).transform(cut)
        told = F.exists(F.arrays_zip("marks", "status"), lambda s: (s["status"] == PRINTED) & s["marks"].isNotNull())
        waits = F.array_contains("status", UNKNOWN) | told
        if state.where(F.array_contains("status", UNKNOWN)).isEmpty():
            settled.append(state)
            break
        settled.append(state.where(~waits))
        state = state.where(waits)
    known = reduce(DataFrame.unionAll, [s.select("at.row", "status") for s in settled])
    chosen = F.filter("sentences", lambda _, i: F.when(F.col("status").isNull(), i < F.col("most")).otherwise(F.get(F.col("status"), i).isin(PRINTED, OLD)))
    found = rows.select("row", "topic", "chunk_id", "most", "sentences").join(known, "row", "left")
    return found.select("topic", "chunk_id", F.posexplode(chosen).alias("position", "sentence")).withColumn("position", F.col("position").cast("long"))


def take_turns(candidates: DataFrame, count: int, kinds: list[str], fillers: tuple[str, ...] = (), again: bool = False) -> DataFrame:
    """(topic, place, origin, question): kinds take turns, each origin and each question once, until count are chosen.

    If these run out the filler kinds take turns in the same way and then, with again, the kinds once more, now with
    second questions of used origins. candidates has (topic, kind, order, origin, question); what one kind takes is
    gone for the others, so a topic's candidates, tens of rows, are worked off in one loop.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used, asked, out = set(), set(), []
        for turns, repeat in ((kinds, False), (fillers, False), (kinds if again else (), True)):
            pools = {k: rows[rows["kind"] == k].sort_values("order", kind="stable").itertuples() for k in turns}
            live = set(turns)
            while live and len(out) < count:
                for kind in turns:
                    if kind not in live or len(out) >= count:
                        continue
                    for c in pools[kind]:
                        if (repeat or c.origin not in used) and c.question.casefold() not in asked:
                            used.add(c.origin)
                            asked.add(c.question.casefold())
                            out.append((c.topic, len(out), c.origin, c.question))
                            break
                    else:
                        live.discard(kind)
        return pd.DataFrame(out, columns=["topic", "place", "origin", "question"])

    return candidates.groupBy("topic").applyInPandas(choose, "topic string, place long, origin string, question string")


def parsed_pairs(texts: DataFrame, key: str, text: str = "text", longest: int = 400) -> DataFrame:
    """(key, position, question, answer, level): one `question;answer;level` a line; lines without both are dropped."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("position", "line"))
    parts = F.transform(F.split("line", ";"), lambda p: F.trim(p))
    rows = lines.withColumn("p", parts).where((F.size("p") >= 2) & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(1)) != ""))
    question = F.regexp_replace(F.get("p", F.lit(0)), r"^\s*(?:\d+[.)]|[-*•])\s*", "")
    return rows.select(key, "position", question.alias("question"), F.substring(F.get("p", F.lit(1)), 1, longest).alias("answer"), F.nullif(F.get("p", F.lit(2)), F.lit("")).alias("level"))
