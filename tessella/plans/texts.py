"""Queries of text functions, evidence, curriculum search, budgets, links and incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import citations as C
from tessella.operators import curriculum as U
from tessella.operators import sharing as S
from tessella.operators import neighbours as V
from tessella.operators import scans
from tessella.plans.ranking import PARAGRAPHS_SQL, WORDS_SQL, paragraphs
from tessella.plans.registry import query, table


@query(
    "b3_kept_paragraphs",
    f"""WITH {PARAGRAPHS_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(trim(text), '^(↑|\\^|→)')) AS n_boilerplate,
  count(*) FILTER (ends_with(trim(text), ':') OR length(trim(text)) < 100 AND NOT regexp_matches(trim(text), '[.!?“")]$')) AS n_fragments FROM paragraphs GROUP BY doc_id""",
)
def b3_kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(X.is_boilerplate(F.col("text")), 1)).alias("n_boilerplate"), F.count(F.when(X.is_fragment(F.col("text")), 1)).alias("n_fragments"))


@query("g4_paragraph_hashes", f"WITH {PARAGRAPHS_SQL} SELECT left(sha1(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))), 16) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM paragraphs GROUP BY 1 HAVING count(*) > 1")
def g4_paragraph_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select(X.text_hash(F.col("text")).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("g2_ordered_distinct", f"WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT doc_id, word, min(i) AS i FROM e GROUP BY ALL) GROUP BY doc_id")
def g2_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.array_join("w", " ").alias("words"))


@query("h13_section_digest", "SELECT doc_id, left(sha256(text), 12) AS digest, left(sha1(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))), 16) AS fingerprint FROM documents")
def h13_section_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(text, 256), 1, 12).alias("digest"), X.text_hash(text).alias("fingerprint"))


@query("h30_token_estimate", "SELECT doc_id, ((length(text) - wide) // 3 + wide + 1)::BIGINT AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\\x{800}-\\x{10FFFF}]', '', 'g')) AS wide FROM documents)")
def h30_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(
    "h15_citation_support",
    f"""WITH s AS (SELECT item_id, list_distinct(list_transform(list_filter({WORDS_SQL.format("text")}, lambda w: length(w) >= 4), lambda w: w[1:6])) AS own FROM benchmark),
p AS (SELECT doc_id, list_distinct(list_transform(list_filter({WORDS_SQL.format("text")}, lambda w: length(w) >= 4), lambda w: w[1:6])) AS st FROM documents),
o AS (SELECT item_id, unnest(own) AS st, len(own) AS n FROM s), q AS (SELECT doc_id, unnest(st) AS st FROM p)
SELECT item_id, doc_id, any_value(n) AS own, count(*) AS hit FROM o JOIN q USING (st) GROUP BY item_id, doc_id HAVING count(*) * 5 >= any_value(n)""",
)
def h15_citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and item pairs where a fifth of the item's stems are met: an equi-join on stems."""
    own = table(spark, sf_dir, "benchmark").select("item_id", C.stems(F.col("text")).alias("s")).select("item_id", F.size("s").cast("long").alias("own"), F.explode("s").alias("st"))
    theirs = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.stems(F.col("text"))).alias("st"))
    met = theirs.join(own, "st").groupBy("item_id", "doc_id").agg(F.first("own").alias("own"), F.count("*").alias("hit"))
    return met.where("hit * 5 >= own").select("item_id", "doc_id", "own", "hit")


@query("h16_numbers", "SELECT p_partkey, printf('%d.%03d,%02d', (p_retailprice::BIGINT) // 1, p_size, p_partkey % 100) AS written, ((p_retailprice::BIGINT) * 1000 + p_size)::VARCHAR || CASE WHEN p_partkey % 100 = 0 THEN '' ELSE '.' || rtrim(printf('%02d', p_partkey % 100), '0') END AS value FROM (SELECT p_partkey, p_size, (p_partkey % 900 + 1) AS p_retailprice FROM part)")
def h16_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped numbers with decimal commas in one spelling: 12.034,50 is 12034.5."""
    part = table(spark, sf_dir, "part")
    written = F.format_string("%d.%03d,%02d", (F.col("p_partkey") % 900 + 1), "p_size", F.col("p_partkey") % 100)
    return part.select("p_partkey", written.alias("written")).select("p_partkey", "written", C.numbers(F.col("written"))[0].alias("value"))


@query(
    "v3_markers",
    """SELECT l_orderkey, string_agg(n::VARCHAR, ',' ORDER BY i, n) AS numbers FROM (SELECT l_orderkey, l_quantity::INT AS n, min(l_linenumber) AS i FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
)
def v3_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence numbers of a text in order of first appearance; the texts are made from order lines."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.concat(F.lit("["), F.col("l_quantity").cast("int").cast("string"), F.lit("]")).alias("m"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["m"]), " word ").alias("text"))
    return texts.select("l_orderkey", F.array_join(C.markers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query("h12_facet_markers", "SELECT event_id, replace(replace(replace(replace(replace(props, '%', '%25'), ';', '%3B'), '=', '%3D'), '|', '%7C'), '\"', '%22') AS marker, true AS same FROM events")
def h12_facet_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "props", X.marker_encoded(F.col("props")).alias("marker"))
    return rows.select("event_id", "marker", (X.marker_decoded(F.col("marker")) == F.col("props")).alias("same"))


@query(
    "a8_links_and_titles",
    """SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)).len() AS n_distinct FROM pages""",
)
def a8_links_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"), F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"))


@query(
    "e8_links_first_seen",
    """WITH e AS (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS l FROM pages))
SELECT page_id, lower(href) AS key, min(pos) AS pos, arg_min(href, pos) AS href FROM e GROUP BY page_id, lower(href)""",
)
def e8_links_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("pos", "href"))
    first = rows.groupBy("page_id", F.lower("href").alias("key")).agg(F.min(F.struct("pos", "href")).alias("f"))
    return first.select("page_id", "key", F.col("f.pos").cast("long").alias("pos"), "f.href")


@query(
    "f8_link_rank",
    """WITH e AS (SELECT page_id, html, unnest(list_distinct(list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda h: lower(h)))) AS link, lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body FROM pages),
m AS (SELECT page_id, link, title, CASE WHEN link = '' THEN 0 ELSE (length(body) - length(replace(body, link, ''))) // length(link) END AS mentions FROM e WHERE link <> title AND link <> '')
SELECT page_id, link, (CASE WHEN position(link IN title) > 0 THEN 24 ELSE 0 END + CASE WHEN length(link) >= 3 THEN least(mentions, 8) * 3 ELSE 0 END + CASE WHEN length(link) BETWEEN 4 AND 40 THEN 2 ELSE 0 END)::BIGINT AS score FROM m
WHERE CASE WHEN position(link IN title) > 0 THEN 24 ELSE 0 END + CASE WHEN length(link) >= 3 THEN least(mentions, 8) * 3 ELSE 0 END + CASE WHEN length(link) BETWEEN 4 AND 40 THEN 2 ELSE 0 END > 0""",
)
def f8_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by closeness to their page, in half points: 12 in the title, 1.5 for each of up to 8 mentions, 1 for an ordinary length."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), F.lower)
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"), F.lower(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"), F.explode(F.array_distinct(hrefs)).alias("link"))
    rows = rows.where("link <> title AND link <> ''")
    length = F.length("link")
    score = F.when(F.contains("title", "link"), 24).otherwise(0) + F.when(length >= 3, F.least(X.occurrences(F.col("body"), F.col("link")), F.lit(8)) * 3).otherwise(0) + F.when(length.between(4, 40), 2).otherwise(0)
    return rows.select("page_id", "link", score.cast("long").alias("score")).where("score > 0")


KEYWORDS = ["steel", "green", "ring"]
_STANDS_SQL = "regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{N}}_]){w}') OR regexp_matches(lower({c}), '\\p{{L}}\\p{{L}}{w}($|[^\\p{{L}}\\p{{N}}_])')"
_HITS_SQL = " UNION ALL ".join(
    f"SELECT *, {i} AS pos, '{w}' AS keyword, CASE WHEN {_STANDS_SQL.format(c='label', w=w)} THEN 0 WHEN {_STANDS_SQL.format(c='parent_label', w=w)} THEN 1 END AS r FROM n" for i, w in enumerate(KEYWORDS)
)


@query(
    "r4_curriculum_search",
    f"""WITH n AS (SELECT p_partkey, p_name AS label, p_type AS parent_label, p_size % 3 AS role FROM part), h AS ({_HITS_SQL})
SELECT p_partkey, arg_min(keyword, (r, pos)) AS keyword, CASE WHEN min(r) = 0 THEN 'label' ELSE 'parent' END AS matched_in, (any_value(role) * 100 + CASE WHEN min(r) = 0 THEN 10 ELSE 0 END)::BIGINT AS score
FROM h WHERE r IS NOT NULL GROUP BY p_partkey""",
)
def r4_curriculum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_type").alias("parent_label"), (F.col("p_size") % 3).alias("role"))
    keywords = spark.createDataFrame(list(enumerate(KEYWORDS)), "pos int, keyword string")
    hits = U.search(nodes, keywords)
    return hits.select("p_partkey", "keyword", "matched_in", U.score(F.col("role"), F.col("matched_in"), F.lit(False)).cast("long").alias("score"))


@query(
    "r5_level_ladder",
    """SELECT p_partkey, CASE WHEN g <= 4 THEN 'primary' WHEN g <= 10 THEN 'lower secondary' WHEN g IS NOT NULL THEN 'upper secondary' WHEN p_type LIKE '%S%' THEN 'lower secondary' END AS level,
  CASE WHEN g IS NOT NULL THEN 'grade' WHEN p_type LIKE '%S%' THEN 'title' ELSE 'none' END AS source
FROM (SELECT p_partkey, p_type, CASE WHEN p_size BETWEEN 1 AND 13 THEN p_size END AS g FROM part)""",
)
def r5_level_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.array_min(U.grades(F.concat(F.lit("Physik "), F.col("p_size").cast("string"))))
    found = U.ladder((U.level_of(grade), "grade"), (F.when(F.contains("p_type", F.lit("S")), "lower secondary"), "title"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", F.col("f.value").alias("level"), "f.source")


@query("h21_grades", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 13 THEN 1 ELSE 0 END::BIGINT AS n FROM part")
def h21_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("Klasse "), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_size") + 20).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(U.grades(label)).cast("long").alias("n"))


@query(
    "f7_fair_share",
    """WITH RECURSIVE d AS (SELECT lang AS topic, source, sum(len(string_split(text, chr(10))))::BIGINT AS need, regexp_extract(source, '([0-9]+)$', 1)::INT AS p FROM documents GROUP BY lang, source),
o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p % 4, need, p) AS n, count(*) OVER (PARTITION BY topic, p % 4) - row_number() OVER (PARTITION BY topic, p % 4 ORDER BY need, p) + 1 AS waiting FROM d),
w AS (SELECT topic, n, least(need, 300 // waiting) AS allowed, 300 - least(need, 300 // waiting) AS rest FROM o WHERE n = 1
  UNION ALL SELECT o.topic, o.n, least(need, rest // waiting), rest - least(need, rest // waiting) FROM w JOIN o ON o.topic IS NOT DISTINCT FROM w.topic AND o.n = w.n + 1)
SELECT o.topic, source, allowed FROM o JOIN w ON o.topic IS NOT DISTINCT FROM w.topic AND o.n = w.n""",
)
def f7_fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph budgets of each language's sources: sequential by nature, in SQL a recursion."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.size(F.split("text", "\n")).alias("lines"))
    needs = docs.groupBy(F.col("lang").alias("topic"), "source").agg(F.sum("lines").cast("long").alias("need"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return S.fair_share(needs.select("topic", "source", (number % 4).alias("rank"), number.alias("position"), "need"), 300)


@query("f4_scaled_budgets", "SELECT p_size AS slot_id, greatest(300, floor(20000 * count(*) / (SELECT count(*) FROM part)))::BIGINT AS target FROM part GROUP BY p_size")
def f4_scaled_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scaled_targets(table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("slot_id")).agg(F.count("*").alias("weight")), 20_000)


@query(
    "e9_lead_merge",
    f"""WITH {PARAGRAPHS_SQL}, s AS (SELECT doc_id, pos, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM paragraphs)
SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars, sha256(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM s WHERE total <= 1100 GROUP BY doc_id""",
)
def e9_lead_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening paragraphs of each document together, while they stay within 1,100 signs."""
    total = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = paragraphs(spark, sf_dir).select("doc_id", "pos", "text").withColumn("total", total).where("total <= 1100")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sha2(joined, 256).alias("digest"))


@query(
    "e4_reading_positions",
    f"WITH {PARAGRAPHS_SQL} SELECT source, doc_id, pos, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS position, pos = min(pos) OVER (PARTITION BY doc_id) AS is_lead FROM paragraphs",
)
def e4_reading_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("source", "doc_id", F.col("pos").cast("long").alias("pos"))
    rows = scans.numbered(rows, ["source"], ["doc_id", "pos"])
    return rows.select("source", "doc_id", "pos", "position", (F.col("pos") == F.min("pos").over(Window.partitionBy("doc_id"))).alias("is_lead"))


@query(
    "e10_intro_pairs",
    """SELECT conv_id, turn, text || ' ' || nxt AS joined FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations)
WHERE role = 'user' AND nrole = 'assistant'""",
)
def e10_intro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and the answer behind it as one text; pairs never overlap, so lead() is enough."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"nxt": F.lead("text").over(by), "nrole": F.lead("role").over(by)})
    return rows.where("role = 'user' AND nrole = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" "), "nxt").alias("joined"))


@query(
    "c16_cosine_neighbours",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)
SELECT q.vec_id AS query_id, v.vec_id, floor(list_dot_product(q.e, v.e) / (greatest(sqrt(list_dot_product(q.e, q.e)), 1e-9) * greatest(sqrt(list_dot_product(v.e, v.e)), 1e-9)) * 1e4 + 0.5)::BIGINT AS sim_e4
FROM q JOIN v ON q.vec_id <> v.vec_id""",
)
def c16_cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector (ids divisible by 20) against all vectors, in blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    found = V.all_pairs(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.col("like").alias("sim_e4"))


@query(
    "c16_nearest_vectors",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS sim FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INTEGER AS place FROM s) WHERE place <= 10""",
)
def c16_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query vector (ids divisible by 20) among all, by cells, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    found = V.nearest(vectors, vectors.where("vec_id % 20 = 0"), exact=True)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "place")


@query("m4_live_cache", "SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS writes FROM events GROUP BY user_id, event_type HAVING max(ts) + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)")
def m4_live_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose last write is younger than six hours at the end of the log."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), F.count("*").alias("writes"))
    return last.crossJoin(now).where(F.expr("last_ts + INTERVAL 6 HOURS > now")).drop("now")


@query("m_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def m_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events: an extra beside the reference's operators."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "users")


@query("a15_json_records", "SELECT event_type, (json_extract(props, '$.k')::INT) % 10 AS k, count(*) AS n, coalesce(json_extract_string(any_value(props), '$.title'), any_value(event_type)) AS title FROM events GROUP BY event_type, 2")
def a15_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of a JSON column, with a fallback for the title that is missing."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int, title string").alias("p"))
    return rows.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"), F.coalesce(F.first("p.title", ignorenulls=True), F.first("event_type")).alias("title"))
