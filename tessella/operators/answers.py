"""Answers of models, read and applied: selections, notes, assignments, verdicts. The calls themselves are not here."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.markup import one_line


def answer_object(answer: Column) -> Column:
    """The JSON object from the first opening to the last closing brace; null if that is none."""
    text = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), text)


def selected_numbers(answer: Column, field: str = "saetze") -> Column:
    """The entries of a list in the answer's object, as typed (2.10 is not 2.1): of the named one, else of the first;
    null without a list."""
    obj = answer_object(answer)
    any_list = r'\[((?:"(?:[^"\\]|\\.)*"|[^\[\]"])*)\]'
    named, first = F.regexp_extract(obj, rf'"{field}"\s*:\s*{any_list}', 0), F.regexp_extract(obj, rf":\s*{any_list}", 0)
    found = F.when(named != "", named).when(first != "", first)
    inner = F.regexp_extract(found, any_list, 1)
    items = F.regexp_extract_all(inner, F.lit(r'"(?:[^"\\]|\\.)*"|[^,\s"]+'), F.lit(0))
    return F.when(found.isNotNull(), F.transform(items, lambda i: F.regexp_replace(i, r'^[\s"\[\]]+|[\s"\[\]]+$', "")))


def number(value: Column) -> Column:
    """A whole number of up to three digits that a value of an answer, as text, holds; else null."""
    return F.when(F.rlike(F.trim(value), F.lit("^[0-9]{1,3}$")), F.trim(value).cast("int"))


def assignments(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, paragraph, block, confidence in hundredths) of answers, one `p12 block 8` a line or between signs.

    A confidence is a digit of 0 to 9, a share with a point or comma, 10 for the top, or a percentage. Of two entries for a
    paragraph the later one counts.
    """
    entry = r"(?i)(?:^|[;|\n])[\s>*•\-]*(?:[0-9]{1,3}[.)]\s+)?\**p([0-9]{1,4})\**[\s:;,=|]+\**([^\s:;,=*|]+)\**[\s:;,=|]+([0-9]{1,3}(?:[.,][0-9]+)?)(?![0-9])"
    found = answers.select(key, F.posexplode(F.regexp_extract_all(answer, F.lit(entry), F.lit(0))).alias("pos", "e"))
    part = lambda i: F.regexp_extract("e", entry, i)
    written = F.replace(part(3), F.lit(","), F.lit("."))
    value = written.cast("double")
    share = F.when(F.contains(written, F.lit(".")), F.least(value, F.lit(1.0))).when(value <= 9, value / 9).when(value == 10, 1.0).otherwise(F.least(value / 100, F.lit(1.0)))
    rows = found.select(key, part(1).cast("int").alias("paragraph"), "pos", F.lower(part(2)).alias("block"), F.floor(share * 100 + 0.5).cast("int").alias("confidence"))
    return rows.groupBy(key, "paragraph").agg(F.max(F.struct("pos", "block", "confidence")).alias("m")).select(key, "paragraph", "m.block", "m.confidence")


def with_notes(rows: DataFrame, notes: DataFrame, on: list[str], may_go: Column | None = None) -> DataFrame:
    """rows with their note (0, 1, 2 or null); those with note 0 go, where may_go says so if it is given."""
    valid = notes.select(*on, F.when(F.col("note").between(0, 2), F.col("note")).alias("note"))
    gone = F.coalesce(F.col("note") == 0, F.lit(False))
    return rows.join(valid, on, "left").where(~(gone & may_go) if may_go is not None else ~gone)


def likeness(a: Column, b: Column) -> Column:
    """Twice the signs of the longest matching blocks of two texts, found one after another, over the signs of both; no built-in has it.

    The order of a and b matters where blocks of one length compete. Null where one of them is.
    """

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out, matcher = [], SequenceMatcher(None)
        for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True):
            if s is None or t is None:
                out.append(None)
                continue
            matcher.set_seqs(s, t)
            out.append(matcher.ratio())
        return pa.array(out, pa.float64())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def verdict(sentence: Column, said: Column, alike: float = 0.5, longer: float = 1.5) -> Column:
    """(outcome, text) of a check: kept, struck, corrected or unchecked.

    `ok` and the sentence itself keep it, a verdict that begins with a word of striking strikes it; a correction ends as a
    sentence, is no question, not over 1.5 times as long and like the sentence by half of its signs.
    """
    text = one_line(said)
    fits = F.rlike(text, F.lit(r"[.!]$")) & (F.length(text) <= F.length(sentence) * longer) & (likeness(sentence, text) >= alike)
    outcome = F.when(text.isNull() | (text == ""), "unchecked").when(F.rlike(text, F.lit("(?i)^(streichen|strike|löschen)")), "struck").when((F.lower(text) == "ok") | (text == sentence), "kept").when(fits, "corrected").otherwise("unchecked")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "corrected", text).when(outcome != "struck", sentence).alias("text"))


def without_unfinished(text: Column) -> Column:
    """The text without the sentence that its last line breaks off in; a last line without a finished one goes whole."""
    trimmed = lambda t: F.regexp_replace(t, r"\s+$", "")
    body = trimmed(text)
    last = F.regexp_extract(body, r"[^\n]*$", 0)
    head = F.substring(body, F.lit(1), F.length(body) - F.length(last))
    finished = r'[.!?…]["“”)\]]*(?:\s?\[\d+\])*\s*$'
    kept = F.regexp_extract(last, r'(?s)^.*[.!?…]["“”)\]]*(?:\s?\[\d+\])*(?=\s)', 0)
    return F.when(F.rlike(last, F.lit(finished)), text).otherwise(trimmed(F.concat(head, kept)))


def offers(chunks: DataFrame, by: str) -> DataFrame:
    """(by, number, sentence): sentences of each chunk numbered `chunk.sentence`, both from 1 on."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("order"))
    numbered = chunks.withColumn("chunk", place).select(by, "chunk", F.posexplode("sentences").alias("at", "sentence"))
    return numbered.select(by, F.concat_ws(".", F.col("chunk").cast("string"), (F.col("at") + 1).cast("string")).alias("number"), "sentence")


def excerpts(offered: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """(by, place, sentence, known): the chosen numbers in order, each once, with whether they were offered."""
    rows = chosen.select(by, F.posexplode(F.array_distinct("numbers")).alias("place", "number"))
    return rows.join(offered, [by, "number"], "left").select(by, "place", "number", "sentence", F.col("sentence").isNotNull().alias("known"))
