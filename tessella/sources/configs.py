"""Rules and results that come as JSON texts: rule tables, SPARQL results, manifests of files; patterns that are safe to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_table(configs: DataFrame, text: str = "json", field: str = "slots") -> DataFrame:
    """(slot, slot_order, pattern) of rule texts {"slots": {slot: [pattern, ...]}}, in the order of the text."""
    slots = F.from_json(F.get_json_object(text, f"$.{field}"), "map<string, array<string>>")
    rows = configs.select(F.posexplode(F.map_entries(slots)).alias("slot_order", "e"))
    return rows.select(F.col("e.key").alias("slot"), "slot_order", F.explode("e.value").alias("pattern"))


def sparql_rows(results: DataFrame, names: list[str], text: str = "json") -> DataFrame:
    """The bindings of SPARQL results in JSON as rows, one column for each name; an unbound name is null."""
    shape = "struct<results: struct<bindings: array<map<string, struct<type: string, value: string>>>>>"
    rows = results.select(F.explode(F.from_json(text, shape)["results"]["bindings"]).alias("b"))
    return rows.select(*[F.col("b")[n]["value"].alias(n) for n in names])


def verified(files: DataFrame, manifest: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, ok): whether each file of a manifest (name, size, sha256) is there with that size and digest."""
    found = files.select(name, F.octet_length(content).cast("long").alias("_size"), F.sha2(content, 256).alias("_sha"))
    both = manifest.join(found, name, "left")
    return both.select(name, F.coalesce((F.col("_size") == F.col("size")) & (F.col("_sha") == F.lower("sha256")), F.lit(False)).alias("ok"))


def is_safe_pattern(pattern: str) -> bool:
    """Whether no repeat without an upper bound holds another repeat, which could take time without bound on a text.

    Groups are followed with a stack; escapes and classes are stepped over. Of a pattern that a user brings, before it
    reaches rlike().
    """
    holds, i, last = [False], 0, False  # whether each open group holds a repeat; whether the item before is a group with one
    while i < len(pattern):
        sign = pattern[i]
        if sign == "\\":
            i, last = i + 2, False
            continue
        if sign == "[":
            end = i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            i, last = end + 1, False
            continue
        if sign == "(":
            holds.append(False)
        elif sign == ")" and len(holds) > 1:
            last = holds.pop()
            holds[-1] = holds[-1] or last
            i += 1
            continue
        elif sign in "*+?{":
            bounds = pattern[i + 1 : pattern.find("}", i)].split(",") if sign == "{" and "}" in pattern[i:] else None
            more = sign in "*+" or bounds is not None and bounds[-1].strip() != "1"
            unbounded = sign in "*+" or bounds is not None and len(bounds) == 2 and not bounds[1].strip()
            if unbounded and last:
                return False
            holds[-1] = holds[-1] or more
            i += len(",".join(bounds)) + 2 if bounds is not None else 1
            continue
        i, last = i + 1, False
    return True
