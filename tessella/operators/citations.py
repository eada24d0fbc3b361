"""Evidence: which words and numbers of a sentence stand in the paragraphs that it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import words

# Stems have six signs, words under four are none; three stems are enough to judge, a fifth must be met.
STEM_SIGNS, LEAST_WORD, LEAST_STEMS, LEAST_SUPPORT = 6, 4, 3, 0.2
# Words of scale behind a number.
SCALES = {"tausend": 3, "mio": 6, "million": 6, "millionen": 6, "mrd": 9, "milliarde": 9, "milliarden": 9}
# Fixed value: how a number is written in groups of three, or without groups.
_GROUPED = r"\d{1,3}(?:[. \u00a0\u2009\u202f]\d{3})+(?:,\d+)?(?!\d)|\d+(?:,\d+)?"
NUMBER = rf"(?:{_GROUPED})(?:\s*(?i:tausend|millionen|million|mio|milliarden|milliarde|mrd)\b)?"


def stems(text: Column) -> Column:
    """The distinct content stems of a text, in order of first appearance."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) >= LEAST_WORD), lambda w: F.substring(w, 1, STEM_SIGNS)))


def _digits(number: Column) -> Column:
    """One spelling per value: digits with the decimal point moved by the word of scale, without idle zeros."""
    scale = F.lower(F.regexp_extract(number, r"([A-Za-z]+)$", 1))
    plain = F.regexp_replace(F.regexp_replace(number, r"\s*[A-Za-z]+$", ""), r"[. \u00a0\u2009\u202f](?=\d{3})", "")
    whole, part = F.substring_index(plain, ",", 1), F.when(F.instr(plain, ",") > 0, F.substring_index(plain, ",", -1)).otherwise("")
    shift = F.coalesce(*[F.when(scale == word, F.lit(n)) for word, n in SCALES.items()], F.lit(0))
    padded = F.rpad(part, F.greatest(F.length(part), shift), "0")
    left = F.regexp_replace(F.concat(whole, F.substring(padded, F.lit(1), shift)), r"^0+(?=\d)", "")
    right = F.regexp_replace(F.substring(padded, shift + 1, F.length(padded)), r"0+$", "")
    return F.when(right == "", left).otherwise(F.concat(left, F.lit("."), right))


def numbers(text: Column) -> Column:
    """The distinct values that a text writes in digits, each in one spelling; of any length, never as floats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), _digits))


def markers(text: Column) -> Column:
    """The evidence numbers [n] of a text in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int")))


def expand_markers(text: Column, longest: int = 20) -> Column:
    """[1, 2] and [1-3] as single markers; a group with a backward or overlong range stays as it is.

    The text is split around the groups; each group becomes its numbers by array functions.
    """
    group = r"\[\d{1,3}(?:\s*(?:[,;]|und|-|–)\s*\d{1,3})+\]"
    between = F.split(text, group)
    groups = F.regexp_extract_all(text, F.lit(group), F.lit(0))

    def expanded(g: Column) -> Column:
        parts = F.split(F.regexp_replace(g, r"[\[\]\s]", ""), r"[,;]|und")
        ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("b")))
        odd = F.exists(ends, lambda e: (e["b"] < e["a"]) | (e["b"] - e["a"] > longest)) | F.exists(parts, lambda p: F.size(F.split(p, "[-–]")) > 2)
        listed = F.flatten(F.transform(ends, lambda e: F.when(e["b"] >= e["a"], F.sequence(e["a"], e["b"])).otherwise(F.array(e["a"]))))
        return F.when(odd, g).otherwise(F.array_join(F.transform(listed, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))

    pieces = F.zip_with(between, F.transform(groups, expanded), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def neutralise(text: Column) -> Column:
    """Text without comments, images, link targets, tags and bare addresses, on one line."""
    target = r"\((?:[^()\s]|\([^()\s]*\))*\)?"
    steps = [(r"(?s)<!--.*?-->|<!--|-->", " "), (r"!\[[^\[\]\n]*\]" + target, " "), (r"\[([^\[\]\n]*)\]" + target, "$1"), (r"\]" + target, "]"), (r"(?s)<[A-Za-z/!?].*?>", " "), (r"(?i)(?:https?://|www\.)\S+", " "), (r"\s+", " ")]
    text = F.regexp_replace(text, r"\s+", " ")
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, own, met, numbers_missing, supported): claims (claim_id, text, cited) against (number, text).

    cited is an array of evidence numbers; the stems and numbers of all cited paragraphs count together.
    """
    own = claims.select("claim_id", "cited", stems(F.regexp_replace("text", r"\[\d{1,3}\]", "")).alias("own"), numbers(F.regexp_replace("text", r"\\?\[\d+\\?\]", "")).alias("values"))
    proof = evidence.select("number", stems(F.col("text")).alias("s"), numbers(F.col("text")).alias("v"))
    joined = own.select("claim_id", F.explode("cited").alias("number")).join(proof, "number")
    seen = joined.groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("v"))).alias("v"))
    none = F.array().cast("array<string>")
    rows = own.join(seen, "claim_id", "left").select("claim_id", "cited", F.size("own").alias("own"), F.size(F.array_intersect("own", F.coalesce("s", none))).alias("met"), F.size(F.array_except("values", F.coalesce("v", none))).alias("numbers_missing"))
    return rows.select("claim_id", "own", "met", "numbers_missing", supported(F.col("cited"), F.col("own"), F.col("met"), F.col("numbers_missing")).alias("supported"))


def supported(cited: Column, own: Column, met: Column, missing: Column) -> Column:
    """Whether a claim holds by how many stems it has and meets, and how many numbers it misses in what it cites."""
    return ~(((own >= LEAST_STEMS) & (met < own * LEAST_SUPPORT)) | ((F.size(cited) > 0) & (missing > 0)))
