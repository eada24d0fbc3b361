"""Queries of archives, markup and subjects: inputs are made from the tables by rules that SQL can follow as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import markup as M
from tessella.functions import sentences as N
from tessella.operators import archive as A
from tessella.operators import keys as K
from tessella.operators import subjects as S
from tessella.plans.ranking import BM25_SQL, chunks, slots
from tessella.plans.registry import query, table


def _pick(number, *values):
    """The value whose place is the number's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


@query("a1_projects", "SELECT page_id, (['wikipedia', 'klexikon', 'wikibooks', 'other', 'wikiversity', 'klexikon'])[page_id % 6 + 1] AS project FROM pages")
def a1_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects from file names and creators; a name with two projects goes to the one that is tried first."""
    n = F.col("page_id")
    file, creator = _pick(n, "wikipedia_de_all", "KLEXIKON_de", "de_wikibooks", "archive_de", "Wikiversity-de", "wikipedia_de"), _pick(n, "Wikipedia", "", "Wikibooks", "someone", "", "Klexikon")
    return table(spark, sf_dir, "pages").select("page_id", A.project(file, creator, F.lit("Title")).alias("project"))


@query(
    "a5_section_redirects",
    """WITH RECURSIVE p AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN page_id - 1 END AS next FROM pages),
f AS (SELECT page_id, page_id AS art, 0 AS hops FROM p UNION ALL SELECT f.page_id, p.next, hops + 1 FROM f JOIN p ON p.page_id = f.art WHERE p.next IS NOT NULL AND hops < 3)
SELECT page_id, arg_max(art, hops) AS article FROM f GROUP BY page_id""",
)
def a5_section_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four pages lead to the section of the page before them; the fourth is an article."""
    n = F.col("page_id")
    head = F.concat(F.lit('<html><head><META http-equiv="refresh" content="0; url=./Seite%20'), (n - 1).cast("string"), F.lit('#Teil"></head>'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(n % 4 != 0, F.concat(head, "html")).otherwise(F.col("html")).alias("html"))
    found = pages.select(F.concat(F.lit("Seite "), n.cast("string")).alias("name"), A.section_target(F.col("html")).alias("to"))
    led = K.follow(found.where("to IS NOT NULL"), found.select("name"))
    number = lambda c: F.split_part(c, F.lit(" "), F.lit(2)).cast("long")
    return led.select(number("name").alias("page_id"), number("target").alias("article"))


@query(
    "a6_suggestions",
    """WITH t AS (SELECT DISTINCT p_name AS title FROM part UNION SELECT DISTINCT p_type FROM part), q AS (SELECT DISTINCT lower(left(n, k)) AS prefix FROM (SELECT p_name AS n FROM part UNION SELECT p_type FROM part), (VALUES (1), (3), (6)) v(k))
SELECT prefix, title, place FROM (SELECT prefix, title, row_number() OVER (PARTITION BY prefix ORDER BY length(title), title)::INTEGER AS place FROM q JOIN t ON starts_with(lower(title), prefix)) WHERE place <= 8""",
)
def a6_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    titles = part.select(F.col("p_name").alias("title")).union(part.select("p_type"))
    asked = titles.select(F.explode(F.array(*[F.lower(F.substring("title", 1, k)) for k in (1, 3, 6)])).alias("prefix"))
    return A.suggestions(asked, titles)


@query(
    "a7_search",
    f"WITH {BM25_SQL.replace('source AS topic', chr(39) + 'all' + chr(39) + ' AS topic')} SELECT slot_id, chunk_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, chunk_id)::INTEGER AS place FROM bm25) WHERE place <= 10",
)
def a7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search of all paragraphs for each benchmark text."""
    return A.search(slots(spark, sf_dir), chunks(spark, sf_dir).select("chunk_id", "text"))


@query("a9_authority_blocks", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'Person' WHEN page_id % 3 = 1 THEN 'Werk' END AS kind, CASE WHEN page_id % 5 <> 0 AND page_id % 2 = 0 THEN (1000 + page_id) || '-X' END AS gnd, CASE WHEN page_id % 5 <> 0 AND page_id % 7 < 4 THEN (page_id * 3)::VARCHAR END AS viaf FROM pages")
def a9_authority_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block in four of five pages, and behind it a number that is not the article's."""
    n = F.col("page_id")
    text = lambda c: c.cast("string")
    block = F.concat(
        F.lit('<div id="normdaten">'), F.when(n % 3 == 0, "Normdaten&nbsp;(Person): ").when(n % 3 == 1, "Normdaten ( Werk ): ").otherwise("Normdaten: "),
        F.when(n % 2 == 0, F.concat(F.lit('<a href="https://d-nb.info/gnd/'), text(1000 + n), F.lit('-X">'))).otherwise(""), F.when(n % 7 < 4, F.concat(F.lit('<a href="https://viaf.org/viaf/'), text(n * 3), F.lit('">'))).otherwise(""),
        F.lit('</div><a href="https://d-nb.info/gnd/99"><a href="https://viaf.org/viaf/99">'),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(n % 5 != 0, F.concat("html", block)).otherwise(F.col("html")).alias("html"))
    return pages.select("page_id", A.authority(F.col("html")).alias("a")).select("page_id", "a.kind", "a.gnd", "a.viaf")


@query(
    "a17_vocabulary",
    """SELECT 'r' || r_regionkey AS id, r_name AS label, NULL AS parent, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def a17_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one nested vocabulary, read back level by level."""
    entry = lambda mark, key, name, *more: F.struct(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.struct(F.col(name).alias("de")).alias("prefLabel"), *more)
    below = lambda c: F.coalesce(F.col(c), F.array()).alias("narrower")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(entry("s", "s_suppkey", "s_name")).alias("s"))
    nations = table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = nations.groupBy("n_regionkey").agg(F.collect_list(entry("n", "n_nationkey", "n_name", below("s"))).alias("n"))
    regions = table(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    vocabulary = regions.agg(F.to_json(F.struct(F.collect_list(entry("r", "r_regionkey", "r_name", below("n"))).alias("hasTopConcept"))).alias("json"))
    return A.concepts(vocabulary)


@query(
    "b1_normalised_topics",
    """SELECT p_partkey, p_name AS topic, (['', 'Klasse 7', 'Sek I', 'Grundschule', 'Klassen 5 bis 7', '', 'Fach Physik', 'Gymnasium', 'Fach Bio|Kinder'])[p_partkey % 9 + 1] AS context, CASE p_partkey % 9 WHEN 6 THEN 'Physik' WHEN 8 THEN 'Bio' END AS subject FROM part""",
)
def b1_normalised_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("p_partkey"), F.col("p_name")
    before = _pick(n, "", "", "", "", "", "Thema:  ", "Physik: ", "Gymnasium – ", "Bio: ")
    behind = _pick(n, "", " in  Klasse 7", " (für die Sek I)", " – Grundschule", " Klassen 5 bis 7", "", "", "", " für Kinder ")
    found = table(spark, sf_dir, "part").select("p_partkey", S.normalised(F.concat(before, name, behind), ["Physik", "Bio"]).alias("t"))
    return found.select("p_partkey", "t.topic", F.array_join("t.context", "|").alias("context"), "t.subject")


@query("b5_paths", "SELECT doc_id, len(list_filter(h, lambda x: regexp_matches(x, '^(literatur|.*en\\.?)$'))) > 0 AS excluded, len(list_filter(h, lambda x: regexp_matches(x, '^siehe|^the '))) > 0 AS relation FROM (SELECT doc_id, list_transform(string_split(text, chr(10))[1:3], lambda x: lower(left(regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '^[ :]+|[ :]+$', '', 'g'), 120))) AS h FROM documents)")
def b5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.slice(F.split("text", "\n"), 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", S.on_path(path, [r"^(Literatur|.*en\.?)$"]).alias("excluded"), S.on_path(path, ["^Siehe", "^the "]).alias("relation"))


NOTICES = [
    ("Wir nutzen auf dieser Seite Cookies.", True), ("Cookies sind kleine Textdateien, die der Browser speichert.", False), ("Daher verwendet diese Website Cookies.", True), ("Manage consent", True),
    ("Informationen auf einem Gerät speichern und/oder abrufen", True), ("Öffne die Cookie-Einstellungen deines Browsers.", False), ("Hier finden Sie die Cookie-Einstellungen.", True), ("Klicken Sie auf OK, um Cookies zuzustimmen. Mehr.", True), ("Sie stimmen den Cookies nie zu.", False),
    ("Bitte klicken Sie hier, um den Cookies zuzustimmen.", True), ("Ihre Auswahl zu Cookies wird gespeichert.", True), ("Ihre Schülerinnen untersuchen Cookies.", False),
]


@query("b6_notices", f"SELECT doc_id, ([{', '.join(str(v).lower() for _, v in NOTICES)}])[doc_id % {len(NOTICES)} + 1] AS notice FROM documents")
def b6_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a sentence of a dialog, or about one, before its text."""
    text = F.concat_ws(" ", _pick(F.col("doc_id"), *[t for t, _ in NOTICES]), "text")
    return table(spark, sf_dir, "documents").select("doc_id", S.is_notice(text, N.sentences(text)).alias("notice"))


LEADS = [
    ("Peter Wende", "Peter Wende (* 17. März 1936 in Athen) ist ein Historiker.", "Person", False), ("Marie", "Marie war eine bekannte Physikerin.", "Person", False), ("Museum", "Ein Museum ist eine Einrichtung.", None, False),
    ("Deutsches Museum", "Das Deutsche Museum ist groß. Der Gründer † 1934.", "Organisation", False), ("Zeiss", "Zeiss ist ein weltweit tätiges Unternehmen.", "Organisation", False), ("Optik", "Optik ist ein Gebiet der Physik. Ein Unternehmen baut sie.", None, False),
    ("Apollo", "Apollo war das bemannte Programm der Behörde.", "Organisation", False), ("LEADER", "LEADER ist ein Programm.", "Vorhaben", False), ("Bund", "Bund ist ein Zusammenschluss von Ländern.", "Netzwerk", False),
    ("Metropolis", "Metropolis ist ein deutscher Film von 1927.", None, True), ("Wende", "Wende ist der Familienname: Peter (* 1936).", None, False), ("Leer", "", None, False),
]


@query(
    "b8_entity_kinds",
    f"SELECT c_custkey, ([{', '.join('NULL' if k is None else f'{chr(39)}{k}{chr(39)}' for _, _, k, _ in LEADS)}])[c_custkey % {len(LEADS)} + 1] AS kind, ([{', '.join(str(w).lower() for *_, w in LEADS)}])[c_custkey % {len(LEADS)} + 1] AS work FROM customer",
)
def b8_entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    title, lead = _pick(n, *[t for t, *_ in LEADS]), _pick(n, *[t for _, t, *_ in LEADS])
    return table(spark, sf_dir, "customer").select("c_custkey", S.entity_kind(title, lead).alias("kind"), S.is_work(lead).alias("work"))


@query(
    "b9_mentions",
    """WITH d AS (SELECT doc_id, lower(text) AS text, CASE WHEN doc_id % 2 = 0 THEN lower(regexp_extract(text, '[A-Za-z]{5,}')) ELSE (['the', 'die', 'une', 'ente', 'est'])[doc_id % 5 + 1] END AS w FROM documents)
SELECT doc_id, CASE WHEN w IS NULL OR w = '' THEN false WHEN length(w) >= 5 THEN position(left(w, length(w) - 1) IN text) > 0
  ELSE regexp_matches(text, '(^|[^\\pL\\pN_])' || w || '(e|en|er|ern|es' || CASE WHEN w LIKE '%e' THEN '|n|s' ELSE '|s' END || ')?([^\\pL\\pN_]|$)') END AS found FROM d""",
)
def b9_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long word of each document's own text, or a short one that sits inside many words."""
    n = F.col("doc_id")
    short = _pick(n, "The", "Die Die (Artikel)", "une", "Ente", "der Est")
    title = F.when(n % 2 == 0, F.regexp_extract("text", "[A-Za-z]{5,}", 0)).otherwise(short)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(S.mentions(F.col("text"), title), F.lit(False)).alias("found"))


@query("b12_neutral_titles", "SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) AS neutral FROM part")
def b12_neutral_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _pick(F.col("p_partkey"), "Grundlagen", "und", "Einführung und Überblick (Optik)", "Methoden 2", "Grundlagen der Optik")
    return table(spark, sf_dir, "part").select("p_partkey", S.is_neutral(title).alias("neutral"))


@query(
    "b13_needs_wording",
    """SELECT doc_id, pos, CASE WHEN regexp_matches(t, '[?!]|[a-zäöüß]{2}\\.(\\s+[A-ZÄÖÜ]|\\s*$)') THEN 'sentence' WHEN len(string_split(t, ' ')) > 6 OR length(t) > 60 THEN 'long' END AS reason
FROM (SELECT doc_id, pos, trim(regexp_replace(left(s, 20 * (pos + 1)), '\\s+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(range(0, 4)) AS pos, text AS s FROM documents))""",
)
def b13_needs_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of several lengths as topics."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substring("text", F.lit(1), 20 * k))).alias("pos", "t"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), S.needs_wording(F.col("t")).alias("reason"))


@query("b14_openings", "SELECT p_partkey, p_partkey % 4 < 2 AS person, p_partkey % 3 = 0 AS work FROM part")
def b14_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    text = F.concat("p_name", _pick(n, " (* 1900)", " (geb. 1900)", " (1900)", " * 1900 ("), F.lit(" (franz. La (Sub) Chute. Ein) ist "), _pick(n, "ein Roman. Er", "ein Romanzyklus. Ein Film", "gut. Ein Roman"))
    return table(spark, sf_dir, "part").select("p_partkey", S.looks_like_person(text).alias("person"), S.looks_like_work(text).alias("work"))


@query("b16_readable", "SELECT doc_id, md5(replace(replace(nfc_normalize(replace(replace(text, 'e', 'e' || chr(769)), 'u', 'u' || chr(776))), chr(8203), ''), chr(173), '')) AS digest FROM documents")
def b16_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marks apart from their letters and format signs between words."""
    text = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("e\u0301")), F.lit("u"), F.lit("u\u0308")), F.lit(" "), F.lit(" \u200b\u00ad"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.readable(text)).alias("digest"))


@query(
    "c4_identifiers",
    """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END AS block FROM customer), w AS (SELECT c_custkey AS id, 'Q' || c_custkey AS qid FROM customer WHERE c_custkey % 4 <> 1),
g AS (SELECT 'Q' || s_suppkey AS qid, 'g' || s_suppkey AS number FROM supplier)
SELECT id, coalesce(block, number) AS gnd, CASE WHEN block IS NOT NULL THEN 'block' WHEN number IS NOT NULL THEN 'index' END AS source,
  concat_ws(' ', 'https://d-nb.info/gnd/' || coalesce(block, number), 'http://www.wikidata.org/entity/' || w.qid, 'http://de.dbpedia.org/resource/' || id) AS same FROM b LEFT JOIN w USING (id) LEFT JOIN g ON g.qid = w.qid""",
)
def c4_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of an article's own block, else of the index by its item; then all known addresses."""
    n = F.col("c_custkey")
    text = n.cast("string")
    known = table(spark, sf_dir, "customer").select(n.alias("id"), F.when(n % 3 == 0, F.concat(F.lit("b"), text)).alias("block"), F.when(n % 4 != 1, F.concat(F.lit("Q"), text)).alias("qid"))
    index = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("qid"), F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("number"))
    rows = known.join(index, "qid", "left").withColumn("gnd", F.coalesce("block", "number"))
    source = F.when(F.col("block").isNotNull(), "block").when(F.col("number").isNotNull(), "index")
    return rows.select("id", "gnd", source.alias("source"), F.array_join(A.same_as(F.col("gnd"), F.lit(None).cast("string"), F.col("qid"), F.concat(F.lit("http://de.dbpedia.org/resource/"), F.col("id").cast("string"))), " ").alias("same"))


@query(
    "h8_openings",
    """WITH RECURSIVE t AS (SELECT doc_id, replace(replace(text, 't', '('), 'n', ')')[1:800] AS t, 0 AS k FROM documents UNION ALL SELECT doc_id, regexp_replace(t, '\\([^()]*\\)', '', 'g'), k + 1 FROM t WHERE regexp_matches(t, '\\([^()]*\\)'))
SELECT doc_id, left(trim(regexp_replace(arg_max(t, k), '\\s+', ' ', 'g')), 160) AS opening FROM t GROUP BY doc_id""",
)
def h8_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested brackets, from two letters turned into them."""
    return table(spark, sf_dir, "documents").select("doc_id", M.opening(F.replace(F.replace("text", F.lit("t"), F.lit("(")), F.lit("n"), F.lit(")"))).alias("opening"))


@query(
    "h9_leads",
    """SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(left(t, 399)) || '…' END AS lead, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(left(s, 239)) || '…' END AS first
FROM (SELECT doc_id, t, CASE WHEN regexp_matches(t, '[.!?]( |$)') THEN regexp_extract(t, '^(.*?[.!?])( |$)', 1) ELSE t END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))""",
)
def h9_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.lead(F.col("text")).alias("lead"), F.rtrim(M.first_sentence(F.col("text"))).alias("first"))


@query(
    "h11_escapes",
    r"""WITH t AS (SELECT doc_id, replace(replace(replace(replace(text, '%%%', '*[x]*'), '###', '<b>&amp;'), '***', '`|_y_'), '$$$', '\#') AS s FROM documents),
e AS (SELECT doc_id, s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([\\`\[\]*])', '\\\1', 'g'), '<([A-Za-z/?])', '\\<\1', 'g'), '&(#?[A-Za-z0-9]+;)', '\\&\1', 'g'), '(^|[^\pL\pN_])_([^\s_])', '\1\\_\2', 'g') AS x FROM t),
l AS (SELECT doc_id, s, array_to_string(list_transform(string_split(x, chr(10)), lambda v: regexp_replace(regexp_replace(v, '^([ \t]*)([#>+\-=~|:])', '\1\\\2'), '^([ \t]*[0-9]{1,9})([.)])', '\1\\\2')), chr(10)) AS y FROM e)
SELECT doc_id, md5(y) AS escaped, true AS back FROM l""",
)
def h11_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with signs of markup put in; what is escaped reads back as it was."""
    text = F.col("text")
    for junk, signs in (("%%%", "*[x]*"), ("###", "<b>&amp;"), ("***", "`|_y_"), ("$$$", "\\#")):
        text = F.replace(text, F.lit(junk), F.lit(signs))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).withColumn("e", M.escaped(F.col("t")))
    return rows.select("doc_id", F.md5("e").alias("escaped"), (M.unescaped(F.col("e")) == F.col("t")).alias("back"))


@query(
    "h11_links",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[L](' || url || ')' WHEN 1 THEN '[L](<' || url || '_(Optik)>)' WHEN 2 THEN 'L' ELSE '[L](<' || url || ' %3Cx%3E>)' END AS link, CASE WHEN page_id % 2 = 0 THEN '`' || url || '`' ELSE '```' || url || '``b```' END AS code FROM pages""",
)
def h11_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    address = F.when(n % 4 == 0, url).when(n % 4 == 1, F.concat(url, F.lit("_(Optik)"))).when(n % 4 == 2, F.concat(F.lit("javascript:"), url)).otherwise(F.concat(url, F.lit("  <x> ")))
    return table(spark, sf_dir, "pages").select("page_id", M.link(F.lit("L"), address).alias("link"), M.code_span(F.when(n % 2 == 0, url).otherwise(F.concat(url, F.lit("``b")))).alias("code"))


@query("h14_digests", "SELECT doc_id, left(sha256(text), 12) AS digest FROM documents")
def h14_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.digest(F.col("text")).alias("digest"))


@query("h22_tidy_labels", "SELECT p_partkey, p_name || ' ' || chr(228 + (p_partkey % 3)::INT) || ' ‑ & <b> ' || p_type || ' é' AS label FROM part")
def h22_tidy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (228 + F.col("p_partkey") % 3).cast("string")
    label = F.concat(F.lit("  "), F.col("p_name"), F.lit("&nbsp;&#"), number, F.lit("; \n &#x2011; &amp; &lt;b&gt;&nbsp;"), F.col("p_type"), F.lit(" &#xE9; "))
    return table(spark, sf_dir, "part").select("p_partkey", M.tidy(label).alias("label"))


@query(
    "h23_missing_words",
    """WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\pL\\pN_]+'), lambda x: length(x) > 2 AND x <> 'brass') AS asked, regexp_extract_all(lower(p_type || ' ' || p_brand || ' widgets'), '[\\pL\\pN_]+') AS have FROM part),
p AS (SELECT p_partkey, pos, w, h, least(length(w), length(h)) AS k FROM (SELECT p_partkey, unnest(asked) AS w, generate_subscripts(asked, 1) AS pos, have FROM w), unnest(have) AS u(h)),
s AS (SELECT p_partkey, pos, w, max((w = h OR k >= 4 AND (contains(w, h) OR contains(h, w)) OR (len(list_filter(range(1, k + 1), lambda n: left(w, n) = left(h, n))) >= greatest(4, k - 2)))::INT) AS same FROM p GROUP BY ALL)
SELECT p_partkey, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (same = 0), '') AS missing FROM s GROUP BY p_partkey""",
)
def h23_missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic, title = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand", F.lit("widgets"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.words_missing(topic, title, ["brass"]), " ").alias("missing"))


@query("i8_front_matter", "SELECT p_partkey, 'topic: \"' || p_name || ' \\u003Cb\\u003E \\u0026 \\u005Bx\\u005D \\\"q\\\"\\n\"' AS yaml FROM part")
def i8_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("topic: "), M.inert(F.concat("p_name", F.lit(' <b> & [x] "q"\n')))).alias("yaml"))


@query("j7_intervals", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id + 1) * 86400 WHEN 1 THEN (event_id + 1) * 3600 WHEN 2 THEN (event_id + 1) * 60 WHEN 3 THEN CASE WHEN event_id + 1 >= 60 THEN event_id + 1 END END::BIGINT AS seconds FROM events")
def j7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(F.lit(" "), (n + 1).cast("string"), _pick(n, "d", " H ", "m", "s", "w", " d d"))
    return table(spark, sf_dir, "events").select("event_id", M.interval_seconds(text).alias("seconds"))
