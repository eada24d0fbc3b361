"""Queries of answers, requests and composed texts; texts of groups are compared as wholes or by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import answers as W
from tessella.operators import compose as C
from tessella.operators import requests as Q
from tessella.operators import subjects as S
from tessella.plans.archives import _pick
from tessella.plans.ranking import PARAGRAPHS_SQL, paragraphs
from tessella.plans.registry import query, table
from tessella.plans.rules import level_name


@query("i3_selected_numbers", "SELECT p_partkey, ([ '1.1,2.10,' || p_size, '3,x', NULL, NULL, '2.1', NULL])[p_partkey % 6 + 1] AS numbers FROM part")
def i3_selected_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with numbers as strings and as numbers, in another field, without a list, and broken ones."""
    size = F.col("p_size").cast("string")
    answer = _pick(F.col("p_partkey"), 'Gern: {"a": [9], "saetze": ["1.1", 2.10, "[#]"]} fertig', '{"andere": [3, " x "], "b": [1]}', '{"saetze": 3}', "keine", '{"saetze": [2.1]}', '{"saetze": [2.1}')
    found = W.selected_numbers(F.replace(answer, F.lit("#"), size))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("numbers"))


@query("i4_answer_objects", "SELECT p_partkey, p_partkey % 4 = 0 AS is_object, CASE WHEN p_partkey % 4 = 0 AND p_size < 1000 THEN p_size END AS number FROM part")
def i4_answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(_pick(F.col("p_partkey"), 'Hier {"e1": ', '["e1": ', 'e1: ', '{"e1" '), F.col("p_size").cast("string"), _pick(F.col("p_partkey"), "} Ende", "]", "", "}"))
    found = W.answer_object(answer)
    return table(spark, sf_dir, "part").select("p_partkey", found.isNotNull().alias("is_object"), W.number(F.get_json_object(found, "$.e1")).alias("number"))


@query("i1_json_lists", "SELECT p_partkey, p_brand AS first, 2::INTEGER AS n, p_partkey % 2 = 0 AS is_area, upper(p_type) AS upper FROM part")
def i1_json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists kept as JSON text, roles kept as text with commas, and a map of lists, all read as what they are."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.array("p_brand", "p_type")).alias("json"), F.when(F.col("p_partkey") % 2 == 0, "subject,area").otherwise("subarea,goal").alias("roles"), F.create_map(F.lit("kind"), F.array("p_type"), F.lit("none"), F.array().cast("array<string>")).alias("facets"))
    rows = part.withColumns({"list": F.from_json("json", "array<string>"), "filled": F.map_filter("facets", lambda k, v: F.size(v) > 0)})
    upper = F.transform_values("filled", lambda k, v: F.transform(v, F.upper))
    return rows.select("p_partkey", F.col("list")[0].alias("first"), (F.size("list") + F.size("filled") - 1).alias("n"), F.array_contains(F.split("roles", ","), "area").alias("is_area"), upper["kind"][0].alias("upper"))


@query(
    "p1_assignments",
    """SELECT l_orderkey, l_linenumber AS paragraph, arg_max(CASE l_returnflag WHEN 'A' THEN 'fach' WHEN 'N' THEN 'praxis' ELSE 'system' END, l_partkey * 100 + l_suppkey % 100) AS block FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c = 1 GROUP BY ALL""",
)
def p1_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as an answer in several spellings; lines whose number is there twice are left out of it."""
    rows = table(spark, sf_dir, "lineitem")
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"), F.min("l_returnflag").alias("flag")).where("c = 1")
    block = F.when(F.col("flag") == "A", "Fach").when(F.col("flag") == "N", "PRAXIS").otherwise("system")
    shape = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("* **p%d** | %s | 8", "l_linenumber", block)).otherwise(F.format_string("%d. p%d: %s, 0,7", "l_linenumber", "l_linenumber", block))
    answers = once.groupBy("l_orderkey").agg(F.concat(F.lit("Gern.\n"), F.array_join(F.collect_list(shape), "\n")).alias("answer"))
    return W.assignments(answers, "l_orderkey").select("l_orderkey", "paragraph", "block")


@query("p1_confidences", "SELECT event_id, ([89, 80, 100, 45, 7, 100])[event_id % 6 + 1]::INTEGER AS confidence FROM events")
def p1_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("p3 fach "), _pick(F.col("event_id"), "8", "0.8", "10", "45", "0,07", "250"))
    return W.assignments(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), "event_id").select("event_id", "confidence")


@query("p2_excerpts", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY k) - 1 AS place, CASE WHEN k < 3 THEN n_name || ' ' || k || '.' END AS sentence FROM nation, (VALUES (1), (2), (3)) v(k)")
def p2_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks a nation, one sentence each; the answer names both and one that was never offered."""
    nation = table(spark, sf_dir, "nation")
    chunks = nation.select("n_nationkey", F.posexplode(F.array(*[F.array(F.concat("n_name", F.lit(f" {k}."))) for k in (1, 2)])).alias("order", "sentences"))
    chosen = nation.select("n_nationkey", F.array(F.lit("1.1"), F.lit("2.1"), F.lit("1.1"), F.lit("7.7")).alias("numbers"))
    found = W.excerpts(W.offers(chunks, "n_nationkey"), chosen, "n_nationkey")
    return found.select("n_nationkey", F.col("place").cast("long").alias("place"), "sentence")


@query("p5_checked_hits", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity::BIGINT % 5 < 3 THEN l_quantity::BIGINT % 5 END AS note FROM lineitem WHERE l_quantity::BIGINT % 5 <> 0")
def p5_checked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes 0 to 2 by quantity; 3 and 4 are no notes and keep their row without one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    notes = rows.select("q", (F.col("q") % 5).alias("note")).distinct()
    return W.with_notes(rows, notes, ["q"]).select("l_orderkey", "l_linenumber", "l_partkey", "note")


@query("v11_rated_articles", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 4 END AS note FROM supplier WHERE NOT (s_suppkey % 4 = 0 AND s_nationkey % 2 = 0)")
def v11_rated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that do not fit go only if a search or a link brought them."""
    rows = table(spark, sf_dir, "supplier").withColumn("origin", F.when(F.col("s_nationkey") % 2 == 0, "search").otherwise("same_topic"))
    return W.with_notes(rows, rows.select("s_suppkey", (F.col("s_suppkey") % 4).alias("note")), ["s_suppkey"], F.col("origin").isin("search", "linked")).select("s_suppkey", "note")


@query("v12_verdicts", "SELECT p_partkey, (['kept', 'struck', 'corrected', 'unchecked', 'unchecked', 'kept'])[p_partkey % 6 + 1] AS outcome, CASE p_partkey % 6 WHEN 1 THEN NULL WHEN 2 THEN p_name || ' ist ein Teil.' ELSE p_name || ' ist kein Teil.' END AS text FROM part")
def v12_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, n = F.col("p_name"), F.col("p_partkey") % 6
    sentence = F.concat(name, F.lit(" ist kein Teil."))
    said = F.when(n == 0, " OK ").when(n == 1, "Streichen: falsch").when(n == 2, F.concat(name, F.lit(" ist ein Teil."))).when(n == 3, F.concat(name, F.lit(" ist ein Teil?"))).when(n == 4, F.lit("Ganz anders und viel länger als das, was dort stand, und darum unbrauchbar.")).otherwise(sentence)
    found = table(spark, sf_dir, "part").select("p_partkey", W.verdict(sentence, said).alias("v"))
    return found.select("p_partkey", "v.outcome", "v.text")


@query("v13_finished", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || E'.\\n' || p_type || ' [1].' WHEN 1 THEN p_name || '. ' || p_type || '.' WHEN 2 THEN p_name || '.' ELSE p_name || '. A! [2]' END AS text FROM part")
def v13_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name, kind = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    text = F.when(n == 0, F.concat(name, F.lit(".\n"), kind, F.lit(" [1]. Und dann"))).when(n == 1, F.concat(name, F.lit(". "), kind, F.lit("."))).when(n == 2, F.concat(name, F.lit(".\nohne Ende"))).otherwise(F.concat(name, F.lit(". A! [2] b")))
    return table(spark, sf_dir, "part").select("p_partkey", W.without_unfinished(text).alias("text"))


@query("v5_levels", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Primar' WHEN 1 THEN 'Sek I' WHEN 3 THEN 'Hochschule' END AS value FROM part")
def v5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers' names of levels; one that the project does not declare is unknown."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), "Grundschule", "Sekundarstufe I", "Sekundarstufe II", "Hochschule", "Unsinn").alias("level"))
    declared = spark.createDataFrame([("Primar",), ("Sek I",), ("Hochschule",)], "value string")
    return Q.mapped_levels(rows, declared, level_name).select("p_partkey", "value")


@query(
    "v6_part_statuses",
    """SELECT o_orderkey, part, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN part = 'world' THEN CASE WHEN o_custkey % 3 > 0 THEN 'ok' ELSE 'empty' END WHEN o_custkey % 2 = 0 THEN 'unavailable' WHEN part = 'collection' AND o_orderstatus = 'O' THEN 'incomplete' ELSE 'ok' END AS status FROM orders, (VALUES ('world'), ('curricula'), ('collection')) v(part)""",
)
def v6_part_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("*", F.explode(F.array(F.lit("world"), F.lit("curricula"), F.lit("collection"))).alias("part"))
    status = Q.part_statuses(F.col("o_orderkey") % 7 != 0, F.col("part"), F.col("o_custkey") % 3, F.col("o_custkey") % 2 != 0, F.col("o_orderstatus") == "O")
    return rows.select("o_orderkey", "part", status.alias("status"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 7)
    flavour = F.when(F.col("k") != 1, F.concat(F.lit("f"), F.col("k").cast("string")))
    name = F.col("s_name")
    made = F.when(F.col("k") == 1, name).when(F.col("k") == 2, F.lit("same_id")).otherwise(F.concat_ws("_", name, flavour))
    return rows.select(made.alias("id"), name.alias("name"), flavour.alias("flavour"), (F.col("k") == 3).alias("required"), F.when(F.col("k") == 4, F.array(F.lit("small"), F.lit("huge"))).when(F.col("k") == 5, F.array(F.lit("full"))).otherwise(F.array(F.lit("small"), F.lit("full"))).alias("profiles"), "s_suppkey")


@query("v8_subscriptions", "SELECT s_suppkey, s_suppkey % 7 = 3 AS required FROM supplier WHERE s_suppkey % 7 <> 5")
def v8_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.subscriptions(_manifest(spark, sf_dir), "small").select("s_suppkey", "required")


@query("v8_findings", "SELECT CASE WHEN k = 2 THEN 'same_id' ELSE s_name || '_f4' END AS id, CASE k WHEN 2 THEN 'name' ELSE 'profile' END AS finding FROM (SELECT *, s_suppkey % 7 AS k FROM supplier) WHERE k IN (2, 4) UNION ALL SELECT 'same_id', 'duplicate' FROM supplier WHERE s_suppkey % 7 = 2 HAVING count(*) > 1")
def v8_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.manifest_findings(_manifest(spark, sf_dir), ["small", "full"])


@query("m3_changes", "SELECT c_nationkey AS nation, a AS remote, b AS local FROM (SELECT c_nationkey, count(*) AS a, nullif(count(*) FILTER (c_acctbal > 0), 0) AS b FROM customer GROUP BY 1) WHERE a IS DISTINCT FROM b")
def m3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    counted = lambda rows: rows.groupBy("nation").agg(F.count("*").alias("n"))
    return Q.changes(counted(customer), counted(customer.where("c_acctbal > 0")), "nation")


@query(
    "m6_generations",
    """WITH f AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day DESC) AS newer, (SELECT max(day) FROM f) AS now FROM f)
SELECT user_id, day, CASE WHEN newer IS NULL THEN 'current' WHEN newer + INTERVAL 24 HOUR > now THEN 'retired' ELSE 'expired' END AS state FROM g""",
)
def m6_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).count().drop("count")
    last = files.agg(F.max("day").alias("now"))
    return Q.generations(files.crossJoin(F.broadcast(last)), "user_id", "day", F.col("now")).select("user_id", "day", "state")


@query(
    "l7_bounded_paths",
    """WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0), p AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS steps FROM customer UNION ALL SELECT start, parent, steps + 1 FROM p JOIN e ON child = node WHERE steps < 4)
SELECT start, node, min(steps)::INTEGER AS steps FROM p GROUP BY ALL""",
)
def l7_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under customers of a third of their number, at most four steps up."""
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    return Q.bounded_paths(customer.where(key > 0).select(key.alias("child"), F.floor(key / 3).alias("parent")), customer.select(key.alias("start")), 4)


@query("v15_subtopics", "SELECT p_size AS topic, p_name AS title FROM part WHERE p_partkey % 4 <> 1 AND position('widget' IN p_name) > 0")
def v15_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of `Widgets`, by size; those of one origin are none."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("topic"), F.col("p_name").alias("title"), F.lit(False).alias("is_primary"), F.when(F.col("p_partkey") % 4 == 1, "search").otherwise("linked").alias("origin"))
    primary = part.select("topic").distinct().select("topic", F.lit("Die Widgets (Optik)").alias("title"), F.lit(True).alias("is_primary"), F.lit("main").alias("origin"))
    return Q.subtopics(part.unionByName(primary), "topic", ["linked", "same_topic"])


@query(
    "v16_candidate_links",
    """SELECT l_suppkey, l_partkey AS title, row_number() OVER (PARTITION BY l_suppkey ORDER BY r)::INTEGER AS place FROM (SELECT l_suppkey, l_partkey, min((CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_orderkey * 100 + l_linenumber, l_partkey)) AS r FROM lineitem GROUP BY ALL)""",
)
def v16_candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("title"), F.col("l_returnflag").alias("heading"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("order"))
    return Q.candidate_links(links, "l_suppkey", ["R"])


@query(
    "v17_places",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Sammlung im Themenbaum unter: ' || r_name || ' › ' || n_name WHEN n_nationkey % 3 = 1 THEN 'Sammlung im Fachportal ' || r_name ELSE 'Sammlung' END || coalesce('; ihre Untersammlungen: ' || c, '') AS place
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""",
)
def v17_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("c"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(below, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    none = F.array().cast("array<string>")
    n = F.col("n_nationkey") % 3
    return rows.select("n_nationkey", Q.place_in_tree(F.when(n == 0, F.array("r_name", "n_name")).otherwise(none), F.when(n == 1, F.col("r_name")), F.coalesce("c", none), none, none).alias("place"))


@query("f1_ranked_hits", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 5 DESC, c_mktsegment, c_custkey % 3, c_name, c_custkey)::INTEGER AS place FROM customer")
def f1_ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("score"), F.col("c_mktsegment").alias("state"), (F.col("c_custkey") % 3).alias("curriculum"), F.col("c_name").alias("label"), F.col("c_custkey").alias("id"))
    return Q.ranked_hits(hits, "c_nationkey").select("c_custkey", "place")


@query("f10_limits", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS place FROM orders) WHERE place <= 15")
def f10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 15).select("o_custkey", "o_orderkey", "place")


@query("d20_usage", "SELECT user_id, event_type, count(*) AS calls, sum(event_id % 1000)::BIGINT AS tokens_in, sum(event_id % 77)::BIGINT AS tokens_out, sum(round(value * 100)::BIGINT)::BIGINT AS cost FROM events GROUP BY ALL")
def d20_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 1000).alias("i"), (F.col("event_id") % 77).alias("o"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return Q.usage_totals(calls, ["user_id", "event_type"], "i", "o", "c")


@query(
    "e7_lead_flags",
    f"""WITH {PARAGRAPHS_SQL} SELECT doc_id, pos, doc_id % 3 = 0 AND row_number() OVER (PARTITION BY doc_id ORDER BY pos // 3, pos) = 1 AS is_lead, pos // 3 % 2 = 1 AND row_number() OVER (PARTITION BY doc_id, pos // 3 ORDER BY pos) = 1 AS is_section_lead FROM paragraphs""",
)
def e7_lead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines a section; every second section is of the second level."""
    section = F.floor(F.col("pos") / 3)
    rows = paragraphs(spark, sf_dir).select(F.col("doc_id").alias("source"), section.alias("section"), F.col("pos").alias("position"), (section % 2 + 1).alias("level"), (F.col("doc_id") % 3 == 0).alias("is_primary"))
    return Q.lead_flags(rows).select(F.col("source").alias("doc_id"), F.col("position").cast("long").alias("pos"), "is_lead", "is_section_lead")


def _parts_of(text):
    """Sentences, as far as SQL can follow: parts between a full stop and a blank."""
    return F.filter(F.split(text, r"(?<=\.) "), lambda s: s != "")


def _text_paragraphs_sql(notice: str) -> str:
    parts = f"list_filter(string_split(replace(line, '. ', '.' || chr(1)), chr(1)), lambda x: x <> '' AND NOT {notice.format('x')})"
    cut = f"flatten(list_transform({parts}, lambda x: list_transform(range(0, greatest((length(x) + 1999) // 2000, 1)), lambda i: trim(substring(x, i * 2000 + 1, 2000)))))"
    step = "CASE WHEN s.now <> '' AND length(s.now) + 1 + length(p.now) > 2000 THEN {'done': list_append(s.done, s.now), 'now': p.now} ELSE {'done': s.done, 'now': CASE WHEN s.now = '' THEN p.now ELSE s.now || ' ' || p.now END} END"
    return f"""
l AS (SELECT doc_id, i, trim(regexp_replace(p[i], '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)),
k AS (SELECT doc_id, i, line, CASE WHEN length(line) > 2000 THEN list_reduce(list_transform({cut}, lambda x: {{'done': []::VARCHAR[], 'now': x}}), lambda s, p: {step}, {{'done': []::VARCHAR[], 'now': ''}}) END AS packed FROM l WHERE length(line) >= 40 AND (length(line) > 2000 OR NOT {notice.format('line')})),
q AS (SELECT doc_id, i, CASE WHEN length(line) <= 2000 THEN [line] WHEN packed.now = '' THEN packed.done ELSE list_append(packed.done, packed.now) END AS pieces FROM k),
paras AS (SELECT doc_id, i, j, pieces[j] AS paragraph FROM q, unnest(range(1, len(pieces) + 1)) AS r(j) WHERE length(pieces[j]) >= 40)"""


@query(
    "h24_text_paragraphs",
    f"""WITH {_text_paragraphs_sql("contains({}, '!!')")}, t AS (SELECT *, row_number() OVER w - 1 AS place, sum(length(paragraph)) OVER w AS total FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY i, j))
SELECT doc_id, place::INTEGER AS place, md5(paragraph) AS digest FROM t WHERE total <= 15000""",
)
def h24_text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and, of long lines, pieces, as many as fit into 15,000 signs; loud ones count as notices."""
    found = Q.text_paragraphs(table(spark, sf_dir, "documents"), "doc_id", _parts_of, lambda t: F.contains(t, F.lit("!!")), 15_000)
    return found.select("doc_id", "place", F.md5("paragraph").alias("digest"))


@query("v1_text_sources", f"WITH {_text_paragraphs_sql('({} IS NULL)')}, n AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1) SELECT doc_id, CASE WHEN n > 0 THEN 'text:' || doc_id END AS source_id, coalesce(n, 0) AS n_paragraphs FROM documents LEFT JOIN n USING (doc_id)")
def v1_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Q.text_sources(Q.text_paragraphs(docs, "doc_id", _parts_of, lambda t: F.lit(False), 1 << 30), docs, "doc_id")


@query(
    "o1_extractive",
    f"""WITH {PARAGRAPHS_SQL}, c AS (SELECT doc_id, pos, pos % 3 AS kind, replace(regexp_replace(text, '[^A-Za-zäöü .]', '', 'g'), '  ', ' ') AS t FROM paragraphs),
s AS (SELECT *, list_filter(string_split(replace(t, '. ', '.' || chr(1)), chr(1)), lambda x: x <> '') AS parts FROM c),
b AS (SELECT doc_id, pos, kind, CASE kind WHEN 1 THEN array_to_string(list_transform(list_filter(string_split(replace(t, '.', chr(10)), chr(10)), lambda i: trim(i) <> '')[1:8], lambda i: '- ' || trim(i)), chr(10))
  ELSE array_to_string(parts[1:CASE WHEN pos = 0 THEN 5 ELSE 3 END], ' ') END AS body FROM s),
f AS (SELECT doc_id, body, min(pos) AS pos FROM b WHERE body <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM f)
SELECT doc_id, md5(string_agg(body || ' [' || number || ']', chr(10) || chr(10) ORDER BY number)) AS text FROM n GROUP BY doc_id""",
)
def o1_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document as one section; every third one as a list of its sentences."""
    clean = F.replace(F.regexp_replace("text", "[^A-Za-zäöü .]", ""), F.lit("  "), F.lit(" "))
    rows = paragraphs(spark, sf_dir).select("doc_id", F.col("pos").alias("order"), F.format_string("c%05d", "pos").alias("chunk_id"), F.when(F.col("pos") % 3 == 1, "list").otherwise("text").alias("kind"), clean.alias("t"), (F.col("pos") == 0).alias("is_lead"))
    rows = rows.withColumns({"text": F.when(F.col("kind") == "list", F.replace("t", F.lit("."), F.lit("\n"))).otherwise(F.col("t")), "sentences": _parts_of(F.col("t"))})
    texts, _ = C.extractive(rows, ["doc_id"])
    return texts.select("doc_id", F.md5("text").alias("text"))


@query("o2_section_texts", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'generated' WHEN 2 THEN 'extracted' ELSE 'empty' END AS status, CASE WHEN o_orderkey % 4 < 3 THEN o_orderpriority ELSE '' END AS section_text FROM orders")
def o2_section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(n == 0, p).alias("kept"), F.when(n == 1, p).when(n == 0, "x").otherwise(" ").alias("generated"), F.when(n == 2, p).when(n < 2, "y").alias("extracted"))
    return C.section_texts(rows).select("o_orderkey", "status", "section_text")


@query(
    "o3_sources_blocks",
    """WITH a AS (SELECT s_nationkey AS n, string_agg('- **[' || s_name || '](http://x/' || s_suppkey || ')** · Lizenz ' || l, chr(10) ORDER BY s_suppkey) AS one, list_sort(list(DISTINCT l)) AS ls FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'CC0' WHEN 1 THEN 'CC BY 4.0' ELSE 'GPL' END AS l FROM supplier) GROUP BY 1),
b AS (SELECT c_nationkey AS n, string_agg('| [' || c_custkey || '] | ' || c_name || ' | ' || CASE WHEN length(s) > 140 THEN left(s, 137) || '…' ELSE s END || ' |', chr(10) ORDER BY c_custkey) AS two FROM (SELECT *, repeat(c_mktsegment || ' ', (c_custkey % 30)::INT) || 'e' AS s FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1),
c AS (SELECT n, string_agg('- ' || r, chr(10) ORDER BY o, r) AS three FROM (SELECT c_nationkey AS n, c_mktsegment || c_custkey % 9 AS r, min(c_custkey) AS o, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey), c_mktsegment || c_custkey % 9) AS k FROM customer GROUP BY 1, 2) WHERE k <= 15 GROUP BY 1)
SELECT a.n AS nation, md5(concat_ws(chr(10) || chr(10), one, '### Belegstellen' || chr(10) || chr(10) || '| Beleg | Quelle | Textauszug |' || chr(10) || '| :---: | :--- | :--- |' || chr(10) || two, '### Weiterführende Quellen' || chr(10) || chr(10) || three,
  '> Lizenzen: ' || CASE WHEN len(ls) = 1 THEN ls[1] ELSE array_to_string(ls[1:len(ls) - 1], ', ') || ' und ' || ls[len(ls)] END)) AS text FROM a LEFT JOIN b USING (n) LEFT JOIN c USING (n)""",
)
def o3_sources_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as sources, some customers as citations, all as further references."""
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    key = F.col("c_custkey")
    sources = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("order"), F.col("s_name").alias("title"), F.concat(F.lit("http://x/"), F.col("s_suppkey").cast("string")).alias("url"), _pick(F.col("s_suppkey"), "CC0", "CC BY 4.0", "GPL").alias("licence"))
    citations = customer.where(key % 10 == 0).select("nation", key.alias("number"), F.col("c_name").alias("title"), F.concat(F.repeat(F.concat("c_mktsegment", F.lit(" ")), (key % 30).cast("int")), F.lit("e")).alias("snippet"))
    references = customer.select("nation", key.alias("order"), F.concat("c_mktsegment", (key % 9).cast("string")).alias("reference"))
    return C.sources_block(sources, citations, references, "nation").select("nation", F.md5("text").alias("text"))


@query(
    "o4_glossaries",
    """WITH e AS (SELECT p_size, p_name AS term, p_brand || ' ' || p_type AS d, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 2 END AS rank FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT DISTINCT p_size, 'Widget', 'the topic', 0, 0 FROM part),
o AS (SELECT p_size, lower(term) AS t, min((rank, p_partkey, term, d)) AS m FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY m[1], m[2], t) AS n FROM o),
r AS (SELECT p_size, t, m[1] AS rank, m[3] AS term, m[4] AS d, m[2] AS id FROM k WHERE n <= 20)
SELECT p_size, md5('| Begriff | Definition | Relation | Beleg |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10) || string_agg('| **' || replace(term, '#', '\\#') || '** | ' || d || ' | `' || CASE WHEN rank = 0 THEN 'skos:prefLabel' WHEN rank = 1 THEN 'skos:altLabel' WHEN contains(t, 'widge') THEN 'skos:narrower' ELSE 'skos:related' END || '` | [' || term || '](http://x/' || id || ') |', chr(10) ORDER BY rank <> 0, t)) AS text FROM r GROUP BY p_size""",
)
def o4_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0").select("p_size", F.col("p_name").alias("term"), F.concat_ws(" ", "p_brand", "p_type").alias("definition"), F.col("p_partkey").alias("order"), F.lit(False).alias("is_primary"), (F.col("p_partkey") % 10 == 0).alias("is_alias"))
    none = table(spark, sf_dir, "part").where("p_partkey % 13 = 0").select("p_size", F.col("p_name").alias("term"), F.lit(None).cast("string").alias("definition"), F.col("p_partkey").alias("order"), F.lit(False).alias("is_primary"), F.lit(False).alias("is_alias"))
    own = table(spark, sf_dir, "part").select("p_size", F.lit("Widget").alias("term"), F.lit("the topic").alias("definition"), F.lit(0).cast("long").alias("order"), F.lit(True).alias("is_primary"), F.lit(False).alias("is_alias")).distinct()
    entries = part.unionByName(none).unionByName(own).withColumns({"topic": F.lit("Der Widget"), "url": F.concat(F.lit("http://x/"), F.col("order").cast("string"))})
    return C.glossary(entries, "p_size").select("p_size", F.md5("text").alias("text"))


@query(
    "o5_actor_lists",
    """WITH s AS (SELECT c_nationkey AS n, c_name, c_custkey % 4 AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name) AS r FROM customer),
a AS (SELECT n, c_name, CASE k WHEN 0 THEN 'Person' WHEN 1 THEN 'Organisation' WHEN 2 THEN 'Netzwerk' END AS kind, CASE k WHEN 0 THEN 'Wissenschaft & Entwicklung' WHEN 1 THEN 'Bildung' ELSE 'Vernetzung & Fachgebietsentwicklung' END AS f FROM s WHERE r <= 40 AND k < 3),
g AS (SELECT n, kind, CASE kind WHEN 'Person' THEN 1 WHEN 'Organisation' THEN 2 ELSE 4 END AS p, string_agg('- **' || c_name || '** — ' || f, chr(10) ORDER BY lower(c_name)) AS l FROM a GROUP BY ALL)
SELECT n AS nation, md5(string_agg('#### ' || kind || chr(10) || chr(10) || l, chr(10) || chr(10) ORDER BY p)) AS text FROM g GROUP BY n""",
)
def o5_actor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as linked articles: persons, organisations, networks and subjects by their leads."""
    lead = F.concat("c_name", _pick(F.col("c_custkey"), " (* 1900 in Rom) ist bekannt.", " ist ein Verein für Schule.", " ist ein Bündnis.", " ist ein Begriff."))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("title"), F.col("c_custkey").alias("order"), lead.alias("lead"))
    found = C.actors(rows, "nation", S.entity_kind(F.col("title"), F.col("lead")))
    first = F.when(F.col("kind") == "Organisation", F.lit("Bildung")).otherwise(F.col("functions")[0])
    return C.actor_list(found, "nation", first).select("nation", F.md5("text").alias("text"))


@query("k10_actor_functions", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Wissenschaft & Entwicklung' WHEN 1 THEN 'Bildung|Vernetzung & Fachgebietsentwicklung' ELSE 'Vernetzung & Fachgebietsentwicklung' END AS functions FROM customer")
def k10_actor_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 4 == 0, "Person").otherwise("Organisation")
    lead = F.concat("c_name", _pick(F.col("c_custkey"), " (* 1900 in Rom) ist bekannt.", " ist ein Verein für Schule.", " ist ein Bündnis.", " ist ein Begriff."))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(C.functions_of(lead, kind), "|").alias("functions"))


@query(
    "v14_evidence",
    f"""WITH {PARAGRAPHS_SQL}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM paragraphs)
SELECT doc_id, md5(string_agg('[' || number || '] (d' || doc_id || ' › h) ' || CASE WHEN length(t) > 600 THEN rtrim(left(t, 599)) || '…' ELSE t END, chr(10) ORDER BY number)) AS text FROM n GROUP BY doc_id""",
)
def v14_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("doc_id", F.col("pos").alias("order"), F.col("pos").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.lit("h").alias("heading"), "text")
    return C.evidence(rows, ["doc_id"]).select("doc_id", F.md5("text").alias("text"))


@query(
    "o6_part_two",
    """WITH h AS (SELECT c_custkey % 3 AS req, n_name AS state, 'L' || c_custkey % 2 AS level, 'K ' || r_name AS cur, 'area ' || c_custkey % 4 AS area, CASE WHEN c_custkey % 11 = 0 THEN 'area ' || c_custkey % 4 ELSE c_name END AS label, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS note, c_custkey % 7 AS score FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
i AS (SELECT req, level, state, cur, area, string_agg(CASE WHEN label <> area AND note IS NULL THEN '- „' || label || '“ (Thema)' END, chr(10) ORDER BY score DESC, label) AS items, count(*) FILTER (label <> area AND note = 1) AS rest FROM h GROUP BY ALL)
SELECT req, md5(string_agg(concat_ws(chr(10), '### ' || area || chr(10) || chr(10) || '*' || cur || '* · ' || state || ' · ' || level, items, CASE WHEN rest > 0 THEN '- und ' || rest || ' weitere' END), chr(10) || chr(10) ORDER BY level, state, cur, area)) AS text FROM i GROUP BY req""",
)
def o6_part_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    area = F.concat(F.lit("area "), (key % 4).cast("string"))
    hits = rows.select((key % 3).alias("req"), F.col("n_name").alias("state"), F.concat(F.lit("L"), (key % 2).cast("string")).alias("level"), F.concat(F.lit("K "), "r_name").alias("curriculum"), area.alias("area"), F.when(key % 11 == 0, area).otherwise(F.col("c_name")).alias("label"), F.lit("Thema").alias("roles"), F.when(key % 5 == 0, 1).alias("note"), (key % 7).alias("score"))
    return C.part_two(hits, "req").select("req", F.md5("text").alias("text"))


@query(
    "o7_part_three",
    """WITH i AS (SELECT s_nationkey AS n, count(*) AS materials, count(*) FILTER (s_suppkey % 3 = 0) AS undescribed, string_agg('- [' || s_name || '](http://x/' || s_suppkey || ')' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' — First of ' || s_suppkey || '.' END, chr(10) ORDER BY s_suppkey) AS lines FROM supplier GROUP BY 1)
SELECT n_nationkey AS nation, coalesce(materials, 0) AS materials, coalesce(undescribed, 0) AS undescribed, md5(concat_ws(chr(10) || chr(10), '**Sammlung ' || n_name || '**', coalesce(materials, 0) || ' Materialien, davon ' || coalesce(undescribed, 0) || ' ohne Beschreibung', lines)) AS text FROM nation LEFT JOIN i ON n = n_nationkey""",
)
def o7_part_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), key.alias("order"), F.col("s_name").alias("item"), F.concat(F.lit("http://x/"), key.cast("string")).alias("url"), F.when(key % 3 == 1, F.format_string("First of %d. Second.", key)).when(key % 3 == 2, F.format_string(" First of  %d. ", key)).alias("description"))
    found = C.part_three(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("title")), items, "nation")
    return found.select("nation", "materials", "undescribed", F.md5("text").alias("text"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("order"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slot"), F.when(F.col("o_orderstatus") == "O", "kept").otherwise("extracted").alias("status"), F.col("o_orderpriority").alias("title"), F.concat("o_orderpriority", F.lit(" text [1] of "), F.col("o_orderkey").cast("string"), F.lit(".")).alias("text"))
    return C.assembled(rows, "o_custkey", {"topic": F.concat(F.lit("<"), F.col("o_custkey").cast("string"), F.lit(">"))})


@query(
    "o8_documents",
    """SELECT o_custkey, md5('---' || chr(10) || 'topic: "\\u003C' || o_custkey || '\\u003E"' || chr(10) || '---' || chr(10) || chr(10) || string_agg('<!-- kompendium:section id=s' || o_orderkey || ' status=' || CASE WHEN o_orderstatus = 'O' THEN 'kept' ELSE 'extracted' END || ' hash=' || left(sha256(o_orderpriority || ' text [1] of ' || o_orderkey || '.'), 12) || ' -->' || chr(10) || '## ' || o_orderpriority || chr(10) || chr(10) || o_orderpriority || ' text [1] of ' || o_orderkey || '.', chr(10) || chr(10) ORDER BY o_orderkey)) AS text FROM orders GROUP BY o_custkey""",
)
def o8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select("o_custkey", F.md5("text").alias("text"))


@query("a24_parsed_sections", "SELECT o_custkey, 's' || o_orderkey AS slot, CASE WHEN o_orderstatus = 'O' THEN 'kept' ELSE 'extracted' END AS status, o_orderpriority AS title, o_orderpriority || CASE WHEN o_custkey % 5 = 0 AND contains(o_orderpriority, 'URGENT') THEN ' edited' ELSE '' END || ' text [1] of ' || o_orderkey || '.' AS body, NOT (o_custkey % 5 = 0 AND contains(o_orderpriority, 'URGENT')) AS untouched FROM orders")
def a24_parsed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed documents read back; in every fifth one urgent sections were edited meanwhile."""
    docs = _assembled(spark, sf_dir)
    edited = docs.withColumn("text", F.when(F.col("o_custkey") % 5 == 0, F.replace("text", F.lit("URGENT text"), F.lit("URGENT edited text"))).otherwise(F.col("text")))
    found = C.parsed_sections(edited, "o_custkey")
    return found.select("o_custkey", "slot", "status", "title", "body", "untouched")


@query("v2_prose", "SELECT o_custkey, md5(string_agg(o_orderpriority || ' text of ' || o_orderkey || '.', chr(10) || chr(10) ORDER BY o_orderkey)) AS text FROM orders GROUP BY o_custkey")
def v2_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _assembled(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", ""))
    return docs.select("o_custkey", F.md5(C.prose(F.col("text"))).alias("text"))
