"""Answers of models with evidence numbers, checked claim by claim: what is not shown by what it cites goes, or is marked.

An answer is cut into paragraphs, units (lines of a list, prose in one) and claims (sentences). A group of numbers behind a
sentence's end covers the unmarked sentences before it. A claim stays if it cites evidence that there is, and if what it cites has
enough of its words and all of its numbers. The numbers that are left are counted anew from 1 in the order of the text.
Answers and their evidence, at most 999 texts that a number can name, meet in one row and are worked off there: texts are shuffled
once, and claims, their words and what they cite not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import sentences as N
from tessella.functions import text as X
from tessella.operators import citations as C

MARK = r"\[\d{1,3}\]"
_BULLET = r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+"


def units(paragraph: Column) -> Column:
    """The units of a paragraph: each line of a list, and the other lines between them joined; headings and empty lines go."""
    lines = F.filter(F.split(paragraph, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit(r"^\s*#{1,6}\s")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("prose"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["prose"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["prose"])))

    def step(acc: Column, line: Column) -> Column:
        item = F.struct(F.concat(flushed(acc), F.array(F.trim(F.regexp_replace(line, r"^\s*[-*•–]\s+", "")))).alias("done"), F.lit("").alias("prose"))
        prose = F.struct(acc["done"].alias("done"), F.trim(F.concat_ws(" ", acc["prose"], F.trim(line))).alias("prose"))
        return F.when(F.rlike(line, F.lit(_BULLET)), item).otherwise(prose)

    return F.aggregate(lines, empty, step, flushed)


def claims(unit: Column) -> Column:
    """The sentences of a unit, those without a number of their own with the numbers behind the sentence end that they run up to."""
    runs = F.regexp_extract_all(unit, F.lit(rf"(?s).+?[.!?…][)\"“”»]*\s*(?:{MARK}\s*)+(?=\s|$)|.+$"), F.lit(0))
    ended = rf"(?s)^(.*[.!?…][)\"“”»]*)\s*((?:{MARK}\s*)+)$"

    def of_run(run: Column) -> Column:
        return X.bound(F.regexp_replace(F.regexp_extract(run, ended, 2), r"\s", ""), lambda behind: X.bound(listed(run, behind), lambda found: with_numbers(found, behind)))

    def listed(run: Column, behind: Column) -> Column:
        return F.filter(N.sentences(F.trim(F.when(behind != "", F.regexp_extract(run, ended, 1)).otherwise(run))), lambda s: F.trim(s) != "")

    def with_numbers(found: Column, behind: Column) -> Column:
        marked = lambda s: F.rlike(s, F.lit(MARK))
        of = lambda s, i: F.regexp_extract(s, r"(?s)^(.*?)\s*([.!?…]?)\s*$", i)
        with_them = lambda s: F.concat(of(s, 1), F.lit(" "), behind, of(s, 2))
        last = F.coalesce(F.array_max(F.transform(found, lambda s, i: F.when(marked(s), i))), F.lit(-1))
        return F.when(behind == "", found).otherwise(X.bound(last, lambda n: F.transform(found, lambda s, i: F.when(i > n, with_them(s)).otherwise(s))))

    return F.flatten(F.transform(runs, of_run))


def verified(answers: DataFrame, evidence: DataFrame, by: str, mark: str | None = None) -> DataFrame:
    """Rows (by, text, kept, dropped, sources) of answers (by, text), against evidence (by, number, text).

    Claims that fail are dropped; with mark, those that are no questions stay without their numbers in a comment that names the
    mark. sources are the old numbers in the order of the new ones. An answer of which nothing is left has an empty text.
    """
    proofs = evidence.groupBy(by).agg(F.collect_list(F.struct(F.col("number").cast("int").alias("number"), F.coalesce("text", F.lit("")).alias("text"))).alias("proofs"))
    rows = answers.select(by, "text").join(proofs, by, "left")
    none = F.array().cast("array<struct<number: int, text: string>>")
    found = rows.select(by, checked(F.col("text"), F.coalesce("proofs", none), mark).alias("found"))
    return found.select(by, "found.text", "found.kept", "found.dropped", "found.sources")


def checked(text: Column, proofs: Column, mark: str | None = None) -> Column:
    """(text, kept, dropped, sources) of an answer against proofs (number, text), worked off inside its row: its claims are an array for each paragraph."""
    whole = C.expand_markers(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->|<!--|-->", " "))
    # numbers of lists and groups without a sentence claim nothing
    claiming = lambda c: F.rlike(F.regexp_replace(c, MARK, ""), F.lit(r"[^\s.;:,!?…()0-9]"))
    of_paragraph = lambda p: F.filter(F.flatten(F.transform(units(p), lambda u: claims(C.neutralise(u)))), claiming)
    known = F.transform(proofs, lambda p: F.struct(p["number"].alias("number"), C.stems(p["text"]).alias("stems"), C.numbers(p["text"]).alias("values")))
    each = lambda paragraphs, use: F.transform(paragraphs, lambda p: F.transform(p, use))

    def judged(claim: Column, proved: Column, numbers: Column) -> Column:
        def holds(valid: Column) -> Column:
            plain = F.regexp_replace(claim, MARK, "")
            cited = F.filter(proved, lambda p: F.array_contains(valid, p["number"]))
            met = lambda own, c: F.size(F.array_intersect(own, F.flatten(F.transform(c, lambda p: p["stems"]))))
            missing = lambda c: F.size(F.array_except(C.numbers(F.regexp_replace(plain, r"\\?\[\d+\\?\]", "")), F.flatten(F.transform(c, lambda p: p["values"]))))
            shown = X.bound(cited, lambda c: X.bound(C.stems(plain), lambda own: C.supported(valid, F.size(own), met(own, c), missing(c))))
            return (F.size(valid) > 0) & ~F.rlike(claim, F.lit(r"^\s*\[\d{1,4}\]\s*:")) & shown

        return X.bound(F.array_intersect(C.markers(claim), numbers), lambda valid: F.struct(claim.alias("claim"), valid.alias("valid"), holds(valid).alias("holds")))

    def written(paragraphs: Column) -> Column:
        rows = F.flatten(paragraphs)
        held = F.filter(rows, lambda c: c["holds"])
        # new numbers by first use
        sources = F.array_distinct(F.flatten(F.transform(held, lambda c: c["valid"])))
        shown = lambda old: F.filter(F.transform(paragraphs, lambda p: F.filter(F.transform(p, lambda c: _shown(c, old, mark)), lambda s: s.isNotNull())), lambda p: F.size(p) > 0)
        joined = lambda old: F.array_join(F.transform(shown(old), lambda p: F.array_join(p, " ")), "\n\n")
        kept = F.size(held).cast("long")
        return X.bound(sources, lambda old: F.struct(joined(old).alias("text"), kept.alias("kept"), (F.size(rows) - kept).alias("dropped"), old.alias("sources")))

    numbered = lambda proved, use: X.bound(F.transform(proved, lambda p: p["number"]), use)
    paragraphs = F.transform(F.split(whole, r"\n\s*\n"), of_paragraph)
    return X.bound(known, lambda proved: numbered(proved, lambda numbers: X.bound(each(paragraphs, lambda c: judged(c, proved, numbers)), written)))


def _shown(claim: Column, old: Column, mark: str | None) -> Column:
    """What is left of a claim (claim, valid, holds): with the new numbers of the old ones, marked, or null."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r" +([.!?,;:…])", "$1"))
    text = claim["claim"]
    place = lambda m: F.array_position(old, F.regexp_extract(m, r"(\d+)", 1).cast("int"))
    again = F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), lambda m: X.bound(place(m), lambda n: F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise("")))
    joined = F.array_join(F.zip_with(F.split(text, MARK), again, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    shown = F.when(claim["holds"], tidy(joined))
    if mark is None:
        return shown
    plain = F.regexp_replace(text, MARK, "")
    question = F.rlike(F.rtrim(plain), F.lit(r"\?[ )]*$"))
    return shown.when(~question, F.concat(F.lit(f"<!-- f: Evidenzgrad={mark} -->"), tidy(plain), F.lit("<!-- /f -->")))
