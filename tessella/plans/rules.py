"""Queries of rule tables, the assignment policy, article parsing and smaller text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import sentences as N
from tessella.functions import text as X
from tessella.operators import articles as A
from tessella.operators import keys as K
from tessella.operators import lexicon as L
from tessella.operators import mentions as M
from tessella.operators import policy as P
from tessella.plans.ranking import PARAGRAPHS_SQL, WORDS_SQL, paragraphs
from tessella.operators import dictionary, scans
from tessella.plans.registry import query, table


@query("a8_article_sections")
def a8_article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages: title, sections, paragraphs and links; checked against hand-written articles in the tests."""
    rows = A.parsed(table(spark, sf_dir, "pages"))
    count = lambda field: F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s[field]))
    return rows.select("page_id", "title", "is_disambiguation", F.size("sections").alias("n_sections"), count("paragraphs").alias("n_paragraphs"), count("links").alias("n_links"))


@query("a8_page_titles", "SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '' AS has_title FROM pages")
def a8_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parsed(table(spark, sf_dir, "pages")).select("page_id", (F.col("title") != "").alias("has_title"))


HEADING_RULES = [("overview", 0, "^the( |$)"), ("overview", 0, "^la( |$)"), ("practice", 1, "tion"), ("history", 2, "er( |$)"), ("other", 3, "^[aeiou]")]
_RULES_SQL = ", ".join(f"('{s}', {o}, '{p}')" for s, o, p in HEADING_RULES)


@query(
    "c8_heading_lexicon",
    f"""WITH r(slot, slot_order, pattern) AS (VALUES {_RULES_SQL}), p AS (SELECT doc_id, string_split(text, chr(10))[1:3] AS path FROM documents),
h AS (SELECT doc_id, i, left(trim(path[i], ' :'), 120) AS heading FROM p, unnest(range(1, len(path) + 1)) AS u(i)),
m AS (SELECT doc_id, -i AS d, slot_order, slot FROM h, r WHERE regexp_matches(lower(heading), pattern))
SELECT doc_id, arg_min(slot, (d, slot_order)) AS slot FROM m GROUP BY doc_id""",
)
def c8_heading_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of a document as its heading path."""
    rules = spark.createDataFrame(HEADING_RULES, "slot string, slot_order int, pattern string")
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda h: F.lower(F.trim(h)))
    return L.classify(table(spark, sf_dir, "documents").select("doc_id", lines.alias("path")), rules, "doc_id")


FACET_RULES = [("scope", "wide", 0, "tion"), ("scope", "narrow", 1, "ing"), ("topic", "steel", 0, "st"), ("topic", "ocean", 1, "ea"), ("topic", "night", 2, "ight")]
_FACETS_SQL = ", ".join(f"('{f}', '{v}', {o}, '{p}')" for f, v, o, p in FACET_RULES)


@query(
    "k9_facets",
    f"""WITH r(facet, value, rule_order, pattern) AS (VALUES {_FACETS_SQL})
SELECT doc_id, facet, string_agg(value, '|' ORDER BY rule_order) AS vals FROM documents, r WHERE regexp_matches(lower(text), pattern) GROUP BY doc_id, facet""",
)
def k9_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(FACET_RULES, "facet string, value string, rule_order int, pattern string")
    return L.facets(table(spark, sf_dir, "documents"), rules, "doc_id").select("doc_id", "facet", F.array_join("values", "|").alias("vals"))


@query(
    "j5_time_reference",
    """SELECT doc_id, CASE WHEN a >= 2 AND a >= b THEN 'prospective' WHEN b + o >= 2 THEN 'historical' ELSE 'present' END AS value FROM (
  SELECT doc_id, len(regexp_extract_all(lower(text), 'tion')) AS a, len(regexp_extract_all(lower(text), 'was|were')) AS b, len(list_filter(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])(1[0-9]{3}|20[0-9]{2})(?:[^0-9]|$)', 1), lambda y: y::INT < 1996)) AS o FROM documents)""",
)
def j5_time_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that counts as now is a parameter. SQL, without look-around, doubles what parts two years."""
    return L.time_reference(table(spark, sf_dir, "documents"), "was|were", "tion", 2026, "doc_id")


def _policy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir)
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    chunks = rows.select(
        F.col("source").alias("topic"), F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.col("pos").alias("position"), (F.col("pos") % 4).alias("heading_level"),
        (F.col("pos") % 4 == 2).alias("is_section_lead"), ((F.col("pos") == 0) & (F.col("doc_id") % 50 == 0)).alias("is_lead"), F.when(F.length("text") % 5 == 0, F.lit("ASIA")).when(F.length("text") % 7 == 0, F.lit("EUROPE")).alias("lexicon_slot"),
    ).withColumn("lexicon_defines", F.col("lexicon_slot") == "EUROPE")
    docs = table(spark, sf_dir, "documents")
    sources = docs.select(F.col("source").alias("topic"), F.col("doc_id").alias("source_id"), F.col("lang").alias("project"), (F.col("doc_id") % 3 == 0).alias("is_primary"), F.when(F.col("doc_id") % 5 == 0, "same_topic").otherwise("linked").alias("origin"), F.when(F.col("doc_id") % 7 == 0, "material").otherwise("article").alias("source_role"), (number % 2 == 0).alias("title_has_topic"), (F.col("doc_id") % 2 == 0).alias("topical"))
    slots = table(spark, sf_dir, "region").select(F.col("r_name").alias("slot_id"), F.col("r_regionkey").alias("slot_order"), F.col("r_name").alias("slot_key"), F.when(F.col("r_regionkey") == 0, "definition").when(F.col("r_regionkey") == 1, "systematik").otherwise("").alias("slot_role"), F.when(F.col("r_regionkey") == 2, F.array(F.lit("fr"))).when(F.col("r_regionkey") == 3, F.array(F.lit("en"), F.lit("wlo_material"))).otherwise(F.array().cast("array<string>")).alias("preference"))
    fused = chunks.crossJoin(slots.select("slot_id", "slot_order")).select("topic", "chunk_id", "slot_id", ((F.col("source_id") * 7919 + F.col("position") * 104_729 + F.col("slot_order") * 15_485_863) % 1_000_000).alias("score")).where("score > 300000")
    return P.candidates(chunks, slots, sources, fused)


@query(
    "k7_policy_assignment",
    f"""WITH {PARAGRAPHS_SQL},
c AS (SELECT source AS topic, doc_id || ':' || pos AS chunk_id, doc_id, pos, pos % 4 AS lvl, pos % 4 = 2 AS sec, pos = 0 AND doc_id % 50 = 0 AS is_lead, CASE WHEN length(text) % 5 = 0 THEN 'ASIA' WHEN length(text) % 7 = 0 THEN 'EUROPE' END AS lex FROM paragraphs),
s AS (SELECT doc_id, lang, doc_id % 3 = 0 AS prim, CASE WHEN doc_id % 5 = 0 THEN 'same_topic' ELSE 'linked' END AS origin, doc_id % 7 = 0 AS mat, regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0 AS tht, doc_id % 2 = 0 AS topical FROM documents),
b AS (SELECT *, CASE WHEN f > 300000 THEN f ELSE 0 END AS fused FROM (SELECT c.*, s.* EXCLUDE doc_id, r_name, r_regionkey AS k, (doc_id * 7919 + pos * 104729 + r_regionkey * 15485863) % 1000000 AS f FROM c JOIN s USING (doc_id), region)),
h AS (SELECT *, coalesce(lex = 'EUROPE', false) AS def, CASE WHEN NOT (NOT prim AND coalesce(lex = 'EUROPE', false)) THEN lex END AS named FROM b),
x AS (SELECT *, CASE WHEN named IS NULL THEN fused::DOUBLE WHEN named = r_name THEN greatest(fused, 900000)::DOUBLE ELSE fused * 50 / 100::DOUBLE END AS s1 FROM h),
y AS (SELECT *, CASE WHEN k = 1 AND sec THEN s1 * 130 / 100 ELSE s1 END AS s2 FROM x),
z AS (SELECT *, CASE WHEN k = 2 AND lang = 'fr' OR k = 3 AND lang = 'en' THEN s2 * 115 / 100 ELSE s2 END AS s3 FROM y),
w AS (SELECT *, CASE WHEN k = 3 AND mat THEN 650000 + 350000 * least(s3, 1000000) / 1000000 ELSE s3 END AS s4, origin = 'same_topic' AND lvl = 0 AND pos = 0 AS twin, NOT prim AND origin <> 'same_topic' AND lvl = 0 AND pos = 0 AND tht AS sub FROM z),
sc AS (SELECT *, floor(CASE WHEN is_lead THEN CASE WHEN k = 0 THEN 2000000 ELSE 0 END WHEN k = 0 AND twin THEN 1500000 WHEN k = 0 AND (NOT prim OR NOT def) THEN 0 WHEN k <> 0 AND twin THEN 0 WHEN sub THEN CASE WHEN k = 1 THEN 900000 ELSE 0 END ELSE s4 END + 0.5)::BIGINT AS score FROM w),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, chunk_id ORDER BY score DESC, k) AS r FROM sc) WHERE r = 1),
o AS (SELECT topic, chunk_id, CASE WHEN is_lead OR lex IS NOT NULL AND score >= 900000 OR score >= 650000 THEN r_name WHEN topical THEN 'AFRICA' END AS slot_id, CASE WHEN is_lead OR lex IS NOT NULL AND score >= 900000 OR score >= 650000 THEN score ELSE 250000 END AS score FROM best)
SELECT topic, chunk_id, slot_id, score FROM o WHERE slot_id IS NOT NULL""",
)
def k7_policy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assign(_policy_tables(spark, sf_dir), "AFRICA")


@query(
    "e12_mentions_without_overlaps",
    """WITH RECURSIVE s AS (SELECT l_orderkey, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_quantity::BIGINT % 9 AS z, l_returnflag = 'R' AS known, l_linenumber FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, z DESC, NOT known, l_linenumber) AS n FROM s),
w AS (SELECT l_orderkey, n, z AS until, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN a >= until THEN z ELSE until END, a >= until FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.n = w.n + 1)
SELECT l_orderkey, a AS start, z AS "end", known, l_linenumber FROM o JOIN w USING (l_orderkey, n) WHERE kept""",
)
def e12_mentions_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from order lines; the greedy choice is a recursion over an order's spans."""
    start = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + 1 + F.col("l_quantity").cast("long") % 9).alias("end"), (F.col("l_returnflag") == "R").alias("known"), "l_linenumber")
    return M.without_overlaps(rows, ["l_orderkey"])


@query(
    "f11_pick_meaning",
    """WITH m AS (SELECT l_orderkey AS id, l_linenumber AS index, l_returnflag = 'R' AS side, (l_partkey % 4)::INT AS score, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
d AS (SELECT *, side AND index > coalesce(min(index) FILTER (NOT side) OVER (PARTITION BY id), 2147483647) AS demoted FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY demoted, score DESC, index) AS rn, count(*) OVER (PARTITION BY id, demoted, score) AS n FROM d)
SELECT id, index, n = 1 AND score > 0 AS confident FROM r WHERE rn = 1""",
)
def f11_pick_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index"), (F.col("l_returnflag") == "R").alias("side_topic"), (F.col("l_partkey") % 4).cast("int").alias("score"), "l_partkey", "l_suppkey")
    meanings = K.keep_first(rows, ["id", "index"], ["l_partkey", "l_suppkey"])
    return M.pick_meaning(meanings.select("id", "index", "side_topic", "score"), "id")


@query("h2_sentences")
def h2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and usable sentences of each document; golden sentences are in the tests (RE2 has no look-around)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", N.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.size(N.usable(F.col("s"))).alias("n_usable"))


@query(
    "h4_stems",
    f"SELECT DISTINCT word, CASE WHEN length(word) >= 5 THEN word[1:length(word) - 1] ELSE word END AS stem FROM (SELECT unnest({WORDS_SQL.format('text')}) AS word FROM benchmark)",
)
def h4_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return rows.select("word", X.stem(F.col("word")).alias("stem"))


@query("b11_licences", "SELECT event_id, regexp_matches(l, '^(CC0 1\\.0|Public Domain Mark|CC BY(-SA)?( [0-9](\\.[0-9])?)?)$') AS free FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC BY-SA 3.0' WHEN 2 THEN 'CC BY-NC 4.0' WHEN 3 THEN 'CC0 1.0' ELSE 'Schulfunk' END AS l FROM events)")
def b11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("CC BY 4.0", "CC BY-SA 3.0", "CC BY-NC 4.0", "CC0 1.0", "Schulfunk")])
    licence = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.is_free(licence).alias("free"))


@query(
    "b7_blacklist",
    """SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^s') AND NOT regexp_matches(lower(p_type), '^s') OR regexp_matches(lower(p_name), 'ee') AND NOT regexp_matches(lower(p_type), 'ee')""",
)
def b7_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a pattern refuses; a pattern that the topic itself matches is waived."""
    patterns = spark.createDataFrame([("^s",), ("ee",)], "pattern string")
    part = table(spark, sf_dir, "part")
    refused = part.join(F.broadcast(patterns), F.expr("rlike(lower(p_name), pattern) AND NOT rlike(lower(p_type), pattern)"))
    return refused.select("p_partkey").distinct()


@query(
    "g1_keyword_union",
    """WITH k AS (SELECT p_partkey, 0 AS src, p_name AS w FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part UNION ALL SELECT p_partkey, 2, unnest(string_split(p_type, ' ')) FROM part),
f AS (SELECT p_partkey, lower(w) AS key, min(src) AS src FROM k WHERE length(w) BETWEEN 3 AND 40 GROUP BY ALL)
SELECT p_partkey, string_agg(key, ',' ORDER BY src, key) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY src, key) AS r FROM f) WHERE r <= 12 GROUP BY p_partkey""",
)
def g1_keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords from the title, the aliases and the sub-topics: each once, first source first, twelve at most (the search's limit)."""
    part = table(spark, sf_dir, "part")
    words = F.concat(F.array(F.struct(F.lit(0).alias("src"), F.col("p_name").alias("w")), F.struct(F.lit(1).alias("src"), F.col("p_type").alias("w"))), F.transform(F.split("p_type", " "), lambda w: F.struct(F.lit(2).alias("src"), w.alias("w"))))
    rows = part.select("p_partkey", F.explode(words).alias("k")).where(F.length("k.w").between(3, 40))
    first = rows.groupBy("p_partkey", F.lower("k.w").alias("key")).agg(F.min("k.src").alias("src"))
    listed = F.slice(F.sort_array(F.collect_list(F.struct("src", "key"))), 1, 12)
    return first.groupBy("p_partkey").agg(F.array_join(F.transform(listed, lambda r: r["key"]), ",").alias("keywords"))


@query("d14_heading_frequency", "SELECT h, n, (n * 1000000 // sum(n) OVER ())::BIGINT AS share_e6 FROM (SELECT lower(regexp_extract(html, '<h1>([^ <]*)', 1)) AS h, count(*) AS n FROM pages GROUP BY 1)")
def d14_heading_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("html", "<h1>([^ <]*)", 1)).alias("h")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(total).select("h", "n", F.floor(F.col("n") * 1_000_000 / F.col("total")).cast("long").alias("share_e6"))


@query("d18_text_totals", "SELECT coalesce(source, 'all') AS source, sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def d18_text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").rollup("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    return totals.select(F.coalesce("source", F.lit("all")).alias("source"), "chars", "n")


@query(
    "d17_entity_scores",
    """WITH e AS (SELECT item_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS word FROM benchmark),
d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS title, lower(text) AS body FROM documents)
SELECT item_id, count(*) AS n, sum(CASE WHEN position(word IN title) > 0 THEN 3 ELSE 0 END + 1)::BIGINT AS score, min(position(word IN body))::BIGINT AS first FROM e JOIN d ON word <> '' AND position(word IN body) > 0 GROUP BY item_id""",
)
def d17_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word counts 3 in the title and 1 in the text; the words are a dictionary that titles and texts are read against."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("word"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.split("text", "\n")[0]).alias("title"), F.lower("text").alias("body"))
    in_body = dictionary.found(docs, ["doc_id"], "body", words, "item_id", "word")
    in_title = dictionary.found(docs, ["doc_id"], "title", words, "item_id", "word").select("doc_id", "item_id", F.lit(True).alias("titled"))
    met = in_body.join(in_title, ["doc_id", "item_id"], "left")
    return met.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("titled"), 4).otherwise(1)).cast("long").alias("score"), F.min("first").alias("first"))


@query(
    "r6_titles_in_texts",
    r"""WITH t AS (SELECT item_id, regexp_extract(text, '^\S+ \S+') AS title FROM benchmark), m AS MATERIALIZED (SELECT doc_id, item_id, text, title FROM documents JOIN t ON title <> '' AND contains(text, title))
SELECT doc_id, item_id, position(title IN text)::BIGINT AS first FROM m WHERE regexp_matches(text, '(^|[^\pL\pN_])' || regexp_escape(title) || '([^\pL\pN_]|$)')""",
)
def r6_titles_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of two words that stand as such in documents, with their first place as such or in other words."""
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^\S+ \S+", 0).alias("title"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    as_words = dictionary.found(docs, ["doc_id"], "text", titles, "item_id", "title", words=True).select("doc_id", "item_id")
    return dictionary.found(docs, ["doc_id"], "text", titles, "item_id", "title").join(as_words, ["doc_id", "item_id"]).select("doc_id", "item_id", "first")


@query(
    "m7_regenerated_blocks",
    """WITH k AS (SELECT l_orderkey AS id, max(l_linenumber) AS top FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_orderkey AS id, l_linenumber AS number, 'kept' AS status FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 'new' FROM lineitem LEFT JOIN k ON k.id = l_orderkey WHERE l_returnflag <> 'A'""",
)
def m7_regenerated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed blocks keep their numbers; new ones are numbered on after the highest kept one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    kept = lines.where("l_returnflag = 'A'").select("id", F.col("l_linenumber").cast("long").alias("number"), F.lit("kept").alias("status"))
    top = kept.groupBy("id").agg(F.max("number").alias("top"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    new = lines.where("l_returnflag <> 'A'").join(top, "id", "left").select("id", (F.coalesce("top", F.lit(0)) + place).cast("long").alias("number"), F.lit("new").alias("status"))
    return kept.unionByName(new)


@query("v4_level_names", "SELECT p_partkey, CASE WHEN regexp_matches(l, 'grundschul|primar') THEN 'Primar' WHEN regexp_matches(l, 'sek(undar)?(bereich|stufe)? *(ii|2)($|[^a-z0-9])|oberstufe') THEN 'Sek II' WHEN regexp_matches(l, 'sek(undar)?(bereich|stufe)? *(i|1)($|[^a-z0-9])') THEN 'Sek I' WHEN regexp_matches(l, 'hochschul') THEN 'Hochschule' END AS level FROM (SELECT p_partkey, ['grundschule', 'sekundarstufe 1', 'sekundarstufe ii', 'hochschule', 'kindergarten'][p_partkey % 5 + 1] AS l FROM part)")
def v4_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level labels and URIs under one name each; the second stage comes before the first, whose pattern is shorter."""
    labels = F.array(*[F.lit(x) for x in ("Grundschule", "http://v/educationalContext/sekundarstufe_1", "Sekundarstufe II", "Hochschule", "Kindergarten")])
    return table(spark, sf_dir, "part").select("p_partkey", level_name(F.element_at(labels, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("level"))


# Patterns of level labels in their order.
LEVEL_RULES = [("elementar|kita|vorschul", "Elementar"), ("primar|grundschul", "Primar"), (r"sek(undar)?(bereich|stufe)?\s*(ii|2)\b|oberstufe", "Sek II"), (r"sek(undar)?(bereich|stufe)?\s*(i|1)\b", "Sek I"), ("hochschul|universit", "Hochschule"), ("beruf", "Berufliche Bildung"), ("erwachsen|fortbildung|weiterbildung", "Erwachsenenbildung")]


def level_name(label):
    plain = F.translate(F.element_at(F.split(F.regexp_replace(label, "/+$", ""), "/"), -1), "_", " ")
    found = [F.when(F.rlike(plain, F.lit(f"(?iu){pattern}")), name) for pattern, name in LEVEL_RULES]
    return F.coalesce(*found)


@query("v7_fallback_causes", "SELECT event_type AS stage, (json_extract(props, '$.k')::INT) % 3 AS cause, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL")
def v7_fallback_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.get_json_object("props", "$.k").cast("int") % 3
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), cause.alias("cause")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("long").alias("total"))


@query(
    "e11_citation_numbers",
    f"""WITH {PARAGRAPHS_SQL} SELECT source, doc_id, pos, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM paragraphs""",
)
def e11_citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered in reading order within a topic: ranked once per document, then joined to its paragraphs."""
    rows = paragraphs(spark, sf_dir).select("source", "doc_id", F.col("pos").cast("long").alias("pos"))
    cited = scans.numbered(rows.select("source", "doc_id").distinct(), ["source"], ["doc_id"], "place").select("source", "doc_id", (F.col("place") + 1).alias("number"))
    return rows.join(cited, ["source", "doc_id"]).select("source", "doc_id", "pos", "number")
