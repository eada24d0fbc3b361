"""Lookups and keys: first matching candidate, unambiguous keys, bounded redirects, keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(wanted: DataFrame, candidates: Column, titles: DataFrame, key: str, title: str, value: str) -> DataFrame:
    """For each wanted row the value of its first candidate spelling that is a title: (key, pos, chosen).

    titles has one row per title. Candidates are exploded with their place and meet the titles in one equi-join.
    """
    rows = wanted.select(key, F.posexplode(candidates).alias("pos", "_title"))
    found = rows.join(titles.select(F.col(title).alias("_title"), F.col(value).alias("_value")), "_title")
    return found.groupBy(key).agg(F.min(F.struct("pos", "_value")).alias("m")).select(key, "m.pos", F.col("m._value").alias("chosen"))


def spellings(title: Column) -> Column:
    """As typed, with blanks and underscores exchanged, and with an upper-case first letter."""
    upper = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    plain = [title, F.translate(title, "_", " "), F.translate(title, " ", "_")]
    return F.array_distinct(F.array(*plain, *[upper(t) for t in plain]))


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one distinct value, and that value."""
    found = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most"))
    return found.where(F.col(value) == F.col("_most")).drop("_most")


def follow(redirects: DataFrame, names: DataFrame, hops: int = 3) -> DataFrame:
    """(name, target): where each name leads over at most that many redirects; null if a longer chain remains."""
    out = names.select("name", F.col("name").alias("target"))
    step = redirects.select(F.col("name").alias("target"), F.col("to"))
    for _ in range(hops):
        out = out.join(step, "target", "left").select("name", F.coalesce("to", "target").alias("target"))
    longer = out.join(step, "target", "left")
    return longer.select("name", F.when(F.col("to").isNull(), F.col("target")).alias("target"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; the other columns travel in one struct, no window sort."""
    rest = [c for c in rows.columns if c not in keys]
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.min(F.struct(*[r.alias(f"_o{i}") for i, r in enumerate(ranks)], *rest)).alias("_m")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[f"_m.{c}" for c in rest])


def round_robin(rows: DataFrame, group: str, order: list[Column | str], item: str) -> DataFrame:
    """Rows taken in turns from the groups: turn 1 of each group, then turn 2; an item that came before is dropped."""
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return keep_first(turns, [item], ["turn", group])
