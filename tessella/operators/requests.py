"""What a request brings and what becomes of it: texts, levels, archives, generations, bounded paths, collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.markup import one_line
from tessella.operators.subjects import mentions

LEAST_PARAGRAPH, MOST_PARAGRAPH = 40, 2_000


def packed(sentences: Column, limit: int) -> Column:
    """Sentences joined into pieces of at most limit signs, cut at their ends; a longer one is cut at limit signs."""
    parts = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / limit) - 1, F.lit(0))), lambda i: F.trim(F.substring(s, (i * limit + 1).cast("int"), F.lit(limit))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, part: Column) -> Column:
        longer = F.when(state["now"] == "", part).otherwise(F.concat_ws(" ", state["now"], part))
        full = (state["now"] != "") & (F.length(longer) > limit)
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"), F.when(full, part).otherwise(longer).alias("now"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def text_paragraphs(texts: DataFrame, key: str, split, notice, most: int, text: str = "text") -> DataFrame:
    """(key, place, paragraph): lines of 40 signs and more that are no notice, long ones in pieces at sentence ends, as
    many as fit into most signs; the first that does not fit ends a text.

    split gives the sentences of a column and notice whether a column is one.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n|\r")).alias("line_no", "raw")).withColumn("line", one_line(F.col("raw")))
    lines = lines.where((F.length("line") >= LEAST_PARAGRAPH) & ~((F.length("line") <= MOST_PARAGRAPH) & notice(F.col("line"))))
    long = F.filter(split(F.col("line")), lambda s: ~notice(s))
    pieces = F.when(F.length("line") <= MOST_PARAGRAPH, F.array("line")).otherwise(packed(long, MOST_PARAGRAPH))
    rows = lines.select(key, "line_no", F.posexplode(pieces).alias("piece_no", "paragraph")).where(F.length("paragraph") >= LEAST_PARAGRAPH)
    order = Window.partitionBy(key).orderBy("line_no", "piece_no")
    total = F.sum(F.length("paragraph")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"total": total, "place": F.row_number().over(order) - 1}).where(F.col("total") <= most).select(key, "place", "paragraph")


def text_sources(paragraphs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, source_id, n_paragraphs): texts by number, `text:n`; texts without a paragraph have no source_id."""
    counted = paragraphs.groupBy(key).agg(F.count("*").alias("n_paragraphs"))
    rows = texts.select(key).join(counted, key, "left")
    return rows.select(key, F.when(F.col("n_paragraphs") > 0, F.concat(F.lit("text:"), F.col(key).cast("string"))).alias("source_id"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))


def mapped_levels(levels: DataFrame, declared: DataFrame, name, level: str = "level") -> DataFrame:
    """levels with `value`, the declared one that name() gives for a level, or null for an unknown level."""
    known = F.broadcast(declared.select(F.col("value")).distinct())
    return levels.withColumn("_v", name(F.col(level))).join(known, F.col("_v") == F.col("value"), "left").drop("_v")


def part_statuses(wanted: Column, part: Column, filled: Column, available: Column, incomplete: Column) -> Column:
    """What became of a part: ok or empty of the first, ok, unavailable or incomplete of the others; null if unwanted."""
    own = F.when(filled > 0, "ok").otherwise("empty")
    other = F.when(~F.coalesce(available, F.lit(False)), "unavailable").when((part == "collection") & F.coalesce(incomplete, F.lit(False)), "incomplete").otherwise("ok")
    return F.when(wanted, F.when(part == "world", own).otherwise(other))


def subscriptions(manifest: DataFrame, profile: str) -> DataFrame:
    """The rows of a manifest (id, name, flavour, required, profiles) that are of a profile."""
    return manifest.where(F.array_contains("profiles", profile))


def manifest_findings(manifest: DataFrame, profiles: list[str]) -> DataFrame:
    """(id, finding): ids that are there twice, that are not name_flavour, or that name an unknown profile."""
    expected = F.when(F.coalesce("flavour", F.lit("")) != "", F.concat_ws("_", "name", "flavour")).otherwise(F.col("name"))
    twice = manifest.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("finding"))
    wrong = manifest.where(F.col("id") != expected).select("id", F.lit("name").alias("finding"))
    unknown = manifest.where(F.exists("profiles", lambda p: ~p.isin(profiles))).select("id", F.lit("profile").alias("finding"))
    return twice.unionByName(wrong).unionByName(unknown)


def changes(remote: DataFrame, local: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, remote, local): counts that differ or that one side lacks; a harvest is due if there is any."""
    both = remote.select(key, F.col(count).alias("remote")).join(local.select(key, F.col(count).alias("local")), key, "full_outer")
    return both.where(~F.col("remote").eqNullSafe(F.col("local")))


def generations(files: DataFrame, key: str, stamp: str, now: Column, grace_hours: int = 24) -> DataFrame:
    """files with `state`: `current` is the newest of each key; an older one is `retired` until grace_hours after the
    next newer one came, then `expired`."""
    newer = F.lag(stamp).over(Window.partitionBy(key).orderBy(F.desc(stamp)))
    until = F.col("_newer") + F.make_interval(hours=F.lit(grace_hours))
    return files.withColumn("_newer", newer).withColumn("state", F.when(F.col("_newer").isNull(), "current").when(until > now, "retired").otherwise("expired")).drop("_newer")


def bounded_paths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, steps): nodes that at most that many edges (child, parent) lead to, by the shortest way."""
    at = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    levels = [at]
    for k in range(1, most + 1):
        at = at.join(edges, at.node == edges.child).select("start", F.col("parent").alias("node"), F.lit(k).alias("steps")).distinct()
        levels.append(at)
    return reduce(DataFrame.unionByName, levels).groupBy("start", "node").agg(F.min("steps").alias("steps"))


def subtopics(sources: DataFrame, by: str, origins: list[str]) -> DataFrame:
    """(by, title): titles of the neighbours, of the given origins, that mention the topic of the primary source."""
    primary = sources.where("is_primary").groupBy(by).agg(F.min("title").alias("_topic"))
    rows = sources.where(~F.col("is_primary") & F.col("origin").isin(origins)).join(primary, by)
    return rows.where(mentions(F.col("title"), F.col("_topic"))).select(by, "title")


def candidate_links(links: DataFrame, by: str, preferred: list[str]) -> DataFrame:
    """(by, title, place): links of preferred headings first, then in reading order, each once."""
    first = F.min(F.struct((~F.col("heading").isin(preferred)).alias("o"), F.col("order").alias("n"))).alias("m")
    rows = links.groupBy(by, "title").agg(first)
    return rows.select(by, "title", F.row_number().over(Window.partitionBy(by).orderBy("m.o", "m.n", "title")).alias("place"))


def place_in_tree(path: Column, subject: Column, children: Column, materials: Column, neighbours: Column, most: int = 120) -> Column:
    """The place of a collection in words: the path above it, what is in it, and what it is not."""
    short = lambda names: F.transform(names, lambda n: F.substring(one_line(n), 1, most))
    some = lambda names, words: F.when(F.size(names) > 0, F.concat(F.lit(words), F.array_join(short(names), ", ")))
    above = F.when(F.size(path) > 0, F.concat(F.lit("Sammlung im Themenbaum unter: "), F.array_join(short(path), " › "))).when(subject.isNotNull(), F.concat(F.lit("Sammlung im Fachportal "), subject)).otherwise("Sammlung")
    return F.concat_ws("; ", above, some(children, "ihre Untersammlungen: "), some(materials, "Materialien darin: "), some(neighbours, "nicht gemeint sind die Nachbarsammlungen: "))


def first_of_each(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their place from 1 on."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def usage_totals(calls: DataFrame, by: list[str], tokens_in: str, tokens_out: str, cost: str) -> DataFrame:
    """Calls, tokens and costs of each key."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.sum(cost).alias("cost"))


def lead_flags(chunks: DataFrame) -> DataFrame:
    """chunks with is_section_lead, for the first one of a section of the second level, and is_lead, for the first one of a primary source."""
    order = Window.partitionBy("source", "section").orderBy("position")
    first = Window.partitionBy("source").orderBy("section", "position")
    return chunks.withColumns({"is_section_lead": (F.col("level") == 2) & (F.row_number().over(order) == 1), "is_lead": F.col("is_primary") & (F.row_number().over(first) == 1)})


def ranked_hits(hits: DataFrame, by: str) -> DataFrame:
    """hits with their place: by score from the top, then state, curriculum and label."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "state", "curriculum", "label", "id")))
