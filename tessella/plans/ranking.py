"""Queries of the rankers: paragraphs of documents as chunks, sources as topics, benchmark items as slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import STOP_WORDS, words
from tessella.operators import scans
from tessella.operators import ngrams as G
from tessella.operators import ranking as R
from tessella.plans.registry import query, table

LEAST_PARAGRAPH = 40


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that have 40 signs or more, with their place among its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.where(F.length(F.trim("text")) >= LEAST_PARAGRAPH)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as (topic, chunk_id, position, section, text); a document is a section."""
    rows = paragraphs(spark, sf_dir)
    return rows.select(F.col("source").alias("topic"), F.format_string("d%08d:c%05d", "doc_id", "pos").alias("chunk_id"), F.col("pos").alias("position"), F.col("doc_id").alias("section"), "text")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slot_id"), "text")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"
WORDS_SQL = "list_filter(regexp_extract_all(lower({}), '[a-zäöüß0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + STOP_SQL + ", w))"
PARAGRAPHS_SQL = f"""
paragraphs AS (
  SELECT doc_id, source, pos - 1 AS pos, parts[pos] AS text
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(pos)
  WHERE length(trim(parts[pos])) >= {LEAST_PARAGRAPH}),
chunks AS (SELECT source AS topic, printf('d%08d:c%05d', doc_id, pos) AS chunk_id, pos AS position, doc_id AS section, text FROM paragraphs)"""
BM25_SQL = f"""{PARAGRAPHS_SQL},
tokens AS (SELECT topic, chunk_id, {WORDS_SQL.format("text")} AS w FROM chunks),
tf AS (SELECT topic, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT topic, chunk_id, len(w) AS dl, unnest(w) AS term FROM tokens) GROUP BY ALL),
lengths AS (SELECT topic, count(*)::DOUBLE AS n, sum(len(w))::DOUBLE AS total FROM tokens GROUP BY topic),
df AS (SELECT topic, term, count(*)::DOUBLE AS df FROM tf GROUP BY topic, term),
asked AS (SELECT slot_id, term, count(*) AS times FROM (SELECT item_id AS slot_id, unnest({WORDS_SQL.format("text")}) AS term FROM benchmark) GROUP BY ALL),
stats AS (SELECT topic, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, total / n AS avgdl FROM df JOIN lengths USING (topic)),
weighed AS (
  SELECT topic, chunk_id, term, floor(idf * tf::DOUBLE * {R.K1 + 1}::DOUBLE / greatest(tf::DOUBLE + {R.K1}::DOUBLE * (1 - {R.B}::DOUBLE + {R.B}::DOUBLE * dl / greatest(avgdl, 1.0::DOUBLE)), 1e-6) * 1e6 + 0.5)::BIGINT AS part
  FROM tf JOIN stats USING (topic, term)),
bm25 AS (SELECT slot_id, topic, chunk_id, sum(part * times)::BIGINT AS score FROM weighed JOIN asked USING (term) GROUP BY ALL HAVING sum(part * times) > 0)"""


def _top_sql(name: str, scores: str) -> str:
    return f"""
{name} AS (
  SELECT slot_id, topic, chunk_id, rank, floor((score * 1000000 + largest / 2) / largest)::BIGINT AS share
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, slot_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY topic) AS largest FROM {scores})
  WHERE rank <= {R.CANDIDATES})"""


CHAR_SQL = f"""
rows_ AS (
  SELECT topic, NULL::BIGINT AS slot_id, chunk_id, text FROM chunks
  UNION ALL SELECT topic, item_id, NULL, text FROM benchmark, (SELECT DISTINCT topic FROM chunks)),
grams AS (
  SELECT topic, slot_id, chunk_id, unnest(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> ''), lambda w: flatten([
    CASE WHEN length(w) + 2 >= 3 THEN list_transform(range(1, length(w) + 1), lambda s: substring(' ' || w || ' ', s, 3)) ELSE [' ' || w || ' '] END,
    CASE WHEN length(w) + 2 >= 4 THEN list_transform(range(1, length(w)), lambda s: substring(' ' || w || ' ', s, 4)) ELSE [] END,
    CASE WHEN length(w) + 2 >= 5 THEN list_transform(range(1, length(w) - 1), lambda s: substring(' ' || w || ' ', s, 5)) ELSE [] END])))) AS gram
  FROM rows_),
ctf AS (SELECT topic, slot_id, chunk_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
cidf AS (SELECT topic, gram, ln((1.0 + n::DOUBLE) / (1.0 + count(*)::DOUBLE)) + 1.0 AS idf FROM ctf JOIN (SELECT topic, count(*) AS n FROM rows_ GROUP BY topic) USING (topic) GROUP BY topic, gram, n),
cw AS (SELECT topic, slot_id, chunk_id, gram, floor((ln(tf::DOUBLE) + 1.0) * idf * 1e6 + 0.5)::BIGINT AS w FROM ctf JOIN cidf USING (topic, gram)),
norms AS (SELECT topic, slot_id, chunk_id, sum(w * w)::BIGINT AS norm FROM cw GROUP BY ALL),
dots AS (SELECT s.topic, s.slot_id, c.chunk_id, sum(c.w * s.w)::BIGINT AS dot FROM cw c JOIN cw s ON c.topic = s.topic AND c.gram = s.gram WHERE c.slot_id IS NULL AND s.slot_id IS NOT NULL GROUP BY ALL),
chars AS (
  SELECT d.slot_id, d.topic, d.chunk_id, floor(v * 1e6 + 0.5)::BIGINT AS score
  FROM (SELECT d.*, d.dot::DOUBLE / (sqrt(a.norm::DOUBLE) * sqrt(b.norm::DOUBLE)) AS v FROM dots d JOIN norms a ON a.topic = d.topic AND a.slot_id = d.slot_id JOIN norms b ON b.topic = d.topic AND b.chunk_id = d.chunk_id) d
  WHERE v > 0.02)"""
FUSED_SQL = f"""
parts AS (SELECT topic, slot_id, chunk_id, share * {R.WEIGHTS["bm25"]} AS part FROM top_bm25 UNION ALL SELECT topic, slot_id, chunk_id, share * {R.WEIGHTS["char"]} FROM top_char),
raw AS (SELECT topic, slot_id, chunk_id, count(*) AS votes, sum(part) * (10 + {R.VOTE_BONUS} * (count(*) - 1)) AS raw FROM parts GROUP BY ALL),
fused AS (SELECT topic, slot_id, chunk_id, votes, floor(raw * 10000 / max(raw) OVER (PARTITION BY topic) + 0.5)::BIGINT AS score FROM raw)"""
SMOOTH_SQL = """
sizes AS (SELECT topic, section, count(*) AS size FROM chunks GROUP BY ALL),
fs AS (SELECT f.*, section FROM fused f JOIN chunks USING (topic, chunk_id)),
totals AS (SELECT topic, slot_id, section, sum(score) AS total FROM fs GROUP BY ALL),
smoothed AS (
  SELECT topic, slot_id, chunk_id, floor((score * size + total)::DOUBLE / (2 * size) + 0.5)::BIGINT AS score
  FROM fs JOIN totals USING (topic, slot_id, section) JOIN sizes USING (topic, section))"""
BEST_SQL = """
best AS (SELECT topic, chunk_id, slot_id, score FROM (SELECT *, row_number() OVER (PARTITION BY topic, chunk_id ORDER BY score DESC, slot_id) AS r FROM top_bm25_scores) WHERE r = 1)"""
TOP_BM25_SQL = _top_sql("top_bm25", "bm25")
SHARES_SQL = """
shares AS (SELECT topic, slot_id, chunk_id, floor((score * 1000000 + largest / 2) / largest)::BIGINT AS score FROM (SELECT *, max(score) OVER (PARTITION BY topic) AS largest FROM bm25))"""
BEST_BM25_SQL = BEST_SQL.replace("top_bm25_scores", "(SELECT topic, slot_id, chunk_id, share AS score FROM top_bm25)")


@query("b4_paragraphs", f"WITH {PARAGRAPHS_SQL} SELECT doc_id, pos, length(text) AS n_chars FROM paragraphs")
def b4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("text").cast("long").alias("n_chars"))


@query("d3_document_frequency", f"WITH {PARAGRAPHS_SQL}, t AS (SELECT chunk_id, unnest({WORDS_SQL.format('text')}) AS term FROM chunks) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM t GROUP BY term")
def d3_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(chunks(spark, sf_dir))


def _bm25(spark: SparkSession, sf_dir: str, what: str = "best") -> DataFrame:
    return R.bm25(slots(spark, sf_dir), chunks(spark, sf_dir), what)


@query("k1_bm25", f"WITH {BM25_SQL} SELECT topic, slot_id, count(*) AS n, sum(score)::BIGINT AS total, max(score) AS best FROM bm25 GROUP BY ALL")
def k1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "totals").select("topic", "slot_id", "n", "total", "best")


@query("e3_top_candidates", f"WITH {BM25_SQL}, {TOP_BM25_SQL} SELECT topic, slot_id, chunk_id, rank, share FROM top_bm25")
def e3_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.top_candidates(_bm25(spark, sf_dir))
    return top.select("topic", "slot_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "share")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = G.char_tfidf(slots(spark, sf_dir), chunks(spark, sf_dir), what="best")
    return R.fuse({"bm25": R.top_candidates(_bm25(spark, sf_dir)), "char": R.top_candidates(chars)})


@query("k2_char_tfidf", f"WITH {PARAGRAPHS_SQL}, {CHAR_SQL} SELECT topic, slot_id, count(*) AS n, sum(score)::BIGINT AS total, max(score) AS best FROM chars GROUP BY ALL")
def k2_char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.char_tfidf(slots(spark, sf_dir), chunks(spark, sf_dir), what="totals").select("topic", "slot_id", "n", "total", "best")


@query("k4_fused_scores", f"WITH {BM25_SQL}, {TOP_BM25_SQL}, {CHAR_SQL}, {_top_sql('top_char', 'chars')}, {FUSED_SQL} SELECT topic, slot_id, chunk_id, votes, score FROM fused")
def k4_fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query("k5_section_smoothing", f"WITH {BM25_SQL}, {TOP_BM25_SQL}, {CHAR_SQL}, {_top_sql('top_char', 'chars')}, {FUSED_SQL}, {SMOOTH_SQL} SELECT topic, slot_id, chunk_id, score FROM smoothed")
def k5_section_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.smooth(_fused(spark, sf_dir), chunks(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.top_candidates(_bm25(spark, sf_dir)).withColumnRenamed("share", "score")
    return R.best_slot(top)


@query("e2_best_slot", f"WITH {BM25_SQL}, {TOP_BM25_SQL}, {BEST_BM25_SQL} SELECT topic, chunk_id, slot_id, score FROM best")
def e2_best_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


@query(
    "k7_default_slot",
    f"WITH {BM25_SQL}, {SHARES_SQL}, {BEST_SQL.replace('top_bm25_scores', 'shares')} SELECT topic, chunk_id, CASE WHEN score >= {R.CONFIDENT} THEN slot_id ELSE 0 END AS slot_id, CASE WHEN score >= {R.CONFIDENT} THEN score ELSE {R.MIN_SCORE} END AS score, score >= {R.CONFIDENT} AS confident FROM best",
)
def k7_default_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all slots of each chunk that shares a word with one; chunks without a confident signal go to the default slot with the least score."""
    sure = F.col("score") >= R.CONFIDENT
    rows = R.best_of_all(_bm25(spark, sf_dir, "chunks"))
    return rows.select("topic", "chunk_id", F.when(sure, F.col("slot_id")).otherwise(F.lit(0)).alias("slot_id"), F.when(sure, F.col("score")).otherwise(F.lit(R.MIN_SCORE)).alias("score"), sure.alias("confident"))


BUDGET = {"least": 2, "most": 6, "target": 1200}


@query(
    "f3_budget_cut",
    f"""WITH {BM25_SQL}, {TOP_BM25_SQL}, {BEST_BM25_SQL},
ordered AS (
  SELECT b.*, position, length(text) AS chars,
         count(*) OVER w AS kept, coalesce(sum(length(text)) OVER w, 0) AS so_far
  FROM best b JOIN chunks USING (topic, chunk_id)
  WINDOW w AS (PARTITION BY topic, slot_id ORDER BY score DESC, position, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT topic, slot_id, chunk_id, score, chars FROM ordered
WHERE kept < {BUDGET["most"]} AND NOT (kept >= {BUDGET["least"]} AND so_far * 2 >= 3 * {BUDGET["target"]})""",
)
def f3_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rank, keep candidates, choose a slot for each chunk and cut each slot to its budget."""
    size = chunks(spark, sf_dir).select("topic", "chunk_id", "position", F.length("text").cast("long").alias("chars"))
    return R.budget_cut(_assigned(spark, sf_dir).join(size, R.CHUNK), **BUDGET).select("topic", "slot_id", "chunk_id", "score", "chars")


@query(
    "f6_character_cap",
    f"""WITH {PARAGRAPHS_SQL}, s AS (SELECT source, doc_id, pos, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS total FROM paragraphs)
SELECT source, count(*) FILTER (total <= 20000) AS n_kept, coalesce(sum(n) FILTER (total <= 20000), 0)::BIGINT AS chars, max(total) > 20000 AS truncated FROM s GROUP BY source""",
)
def f6_character_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each source in reading order up to a cap of signs: a prefix, as lengths are never negative."""
    rows = paragraphs(spark, sf_dir).select("source", "doc_id", "pos", F.length("text").cast("long").alias("n"))
    fits = F.col("total") <= 20_000
    return scans.before(rows, ["source"], ["doc_id", "pos"], F.col("n")).withColumn("total", F.col("before") + F.col("n")).groupBy("source").agg(F.count(F.when(fits, 1)).alias("n_kept"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("chars"), (F.max("total") > 20_000).alias("truncated"))


@query("h1_words", f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)")
def h1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))
