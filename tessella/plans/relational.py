"""Queries of lookups, keys, trees, windows and set operations on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import evaluation as E
from tessella.operators import keys as K
from tessella.operators import trees as T
from tessella.plans.registry import query, table
from tessella.sources.shared import cut


@query(
    "a2_archive_names",
    """SELECT o_orderkey, regexp_extract(f, '^(.*)_[0-9]{4}-[0-9]{2}\\.zim$', 1) AS archive_id, regexp_extract(f, '_([0-9]{4}-[0-9]{2})\\.zim$', 1) AS dump_date
FROM (SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) || '_' || strftime(o_orderdate, '%Y-%m') || '.zim' AS f FROM orders)""",
)
def a2_archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives(spark, sf_dir).select("o_orderkey", "archive_id", "dump_date")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lower(F.translate("o_orderpriority", " ", "_")), F.lit("_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".zim"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("file"))
    return rows.withColumns({"archive_id": F.regexp_extract("file", r"^(.*)_[0-9]{4}-[0-9]{2}\.zim$", 1), "dump_date": F.regexp_extract("file", r"_([0-9]{4}-[0-9]{2})\.zim$", 1)})


@query(
    "a23_newest_archive",
    """SELECT archive_id, max(dump_date) AS dump_date, count(*) AS n FROM (
  SELECT lower(replace(o_orderpriority, ' ', '_')) AS archive_id, strftime(o_orderdate, '%Y-%m') AS dump_date FROM orders) GROUP BY archive_id""",
)
def a23_newest_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives(spark, sf_dir).groupBy("archive_id").agg(F.max("dump_date").alias("dump_date"), F.count("*").alias("n"))


@query(
    "a4_redirects",
    """WITH r AS (SELECT c_custkey AS name, c_custkey - 1 AS target FROM customer WHERE c_custkey % 6 <> 0),
h AS (SELECT c_custkey AS name, c_custkey AS t0 FROM customer),
x AS (SELECT h.name, coalesce(a.target, t0) AS t1 FROM h LEFT JOIN r a ON a.name = t0),
y AS (SELECT x.name, coalesce(a.target, t1) AS t2 FROM x LEFT JOIN r a ON a.name = t1),
z AS (SELECT y.name, coalesce(a.target, t2) AS t3 FROM y LEFT JOIN r a ON a.name = t2)
SELECT z.name, CASE WHEN a.target IS NULL THEN t3 END AS target FROM z LEFT JOIN r a ON a.name = t3""",
)
def a4_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to five redirects; those over three count as missing."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    return K.follow(names.where("name % 6 <> 0").select("name", (F.col("name") - 1).alias("to")), names)


@query(
    "c2_title_candidates",
    """WITH titles AS (SELECT replace(p_name, ' ', '_') AS title, min(p_partkey) AS id FROM part GROUP BY 1),
c AS (SELECT p_partkey AS key, unnest([p_type, p_name, replace(p_name, ' ', '_'), upper(p_name[1]) || p_name[2:]]) AS t, unnest([0, 1, 2, 3]) AS pos FROM part)
SELECT key, min(pos) AS pos, arg_min(id, pos) AS chosen FROM c JOIN titles ON t = title GROUP BY key""",
)
def c2_title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    titles = part.groupBy(F.translate("p_name", " ", "_").alias("title")).agg(F.min("p_partkey").alias("id"))
    name = F.col("p_name")
    forms = F.array("p_type", name, F.translate(name, " ", "_"), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))
    return K.first_match(part.withColumnRenamed("p_partkey", "key"), forms, titles, "key", "title", "id")


@query("d2_unambiguous_keys", "SELECT p_brand || ' ' || p_size AS name, min(p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def d2_unambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unambiguous(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_size").alias("name"), "p_type"), "name", "p_type")


@query(
    "c3_authority_cascade",
    """WITH names AS (SELECT c_mktsegment || c_nationkey AS name, min(c_custkey) AS id FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) <= 12)
SELECT s_suppkey AS id, coalesce(c_custkey, n.id) AS value, CASE WHEN c_custkey IS NOT NULL THEN 'item' WHEN n.id IS NOT NULL THEN 'name' ELSE 'none' END AS source
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20 AND c_acctbal > 0 LEFT JOIN names n ON n.name = 'BUILDING' || s_nationkey""",
)
def c3_authority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's own record first, else the record of a name that few share."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    items = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("item"))
    names = customer.groupBy(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")).agg(F.min("c_custkey").alias("by_name"), F.count_distinct("c_custkey").alias("n")).where("n <= 12")
    rows = supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 20).alias("item_key"), F.concat(F.lit("BUILDING"), F.col("s_nationkey").cast("string")).alias("name"))
    found = rows.join(items, F.col("item_key") == F.col("item"), "left").join(names, "name", "left")
    source = F.when(F.col("item").isNotNull(), "item").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return found.select("id", F.coalesce("item", "by_name").alias("value"), source.alias("source"))


@query(
    "c1_dump_join",
    """SELECT title, qid, en FROM (
  SELECT c_name AS title, o_orderkey AS qid, n_name AS en, row_number() OVER (PARTITION BY c_name ORDER BY o_orderkey) AS r
  FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 3) WHERE r = 1""",
)
def c1_dump_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a property, their English title if there is one; the first row of a title stays."""
    customer, orders, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    props = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("qid"))
    english = nation.where("n_regionkey = 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("en"))
    rows = customer.join(props, customer.c_custkey == props.o_custkey).join(english, "c_nationkey", "left")
    return K.keep_first(rows.select(F.col("c_name").alias("title"), "qid", "en"), ["title"], ["qid"]).select("title", "qid", "en")


@query(
    "c6_matchable_per_state",
    "SELECT n_name, count(*) FILTER (s_acctbal > 0) AS n_matchable, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
)
def c6_matchable_per_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.when(F.col("s_acctbal") > 0, 1)).alias("n_matchable"), F.count("*").alias("n"))


@query(
    "c9_linked_either_way",
    """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 + 1 AS b FROM lineitem), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT b FROM both_ JOIN supplier m ON m.s_suppkey = both_.a WHERE m.s_acctbal > 9000)""",
)
def c9_linked_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that a main one links to or that link to a main one."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b")).distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    supplier = table(spark, sf_dir, "supplier")
    near = both.join(supplier.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("a")), "a").select(F.col("b").alias("s_suppkey"))
    return supplier.select("s_suppkey").join(near, "s_suppkey", "left_semi")


@query(
    "c10_twins",
    "SELECT a.p_partkey, count(*) AS n FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_brand <> b.p_brand GROUP BY a.p_partkey",
)
def c10_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same title in other archives: from counts per title and per (title, archive), without a self-join."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("title"), "p_brand")
    here = part.groupBy("title", "p_brand").agg(F.count("*").alias("here"))
    all_ = here.groupBy("title").agg(F.sum("here").alias("all"))
    rows = part.join(here, ["title", "p_brand"]).join(all_, "title").select("p_partkey", (F.col("all") - F.col("here")).alias("n"))
    return rows.where("n > 0")


@query("d1_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def d1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "d7_state_level_pivot",
    """SELECT r_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
  count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) AS total
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def d7_state_level_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    wide = rows.groupBy("r_name").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).count().na.fill(0)
    total = rows.groupBy("r_name").agg(F.count("*").alias("total"))
    return wide.join(total, "r_name").select("r_name", F.col("AUTOMOBILE").alias("automobile"), F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"), "total")


@query(
    "d8_distinct_counts",
    "SELECT n_regionkey, count(DISTINCT c_nationkey) AS n_states, count(DISTINCT c_custkey) AS n_curricula, count(DISTINCT c_mktsegment) AS n_levels FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey",
)
def d8_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.count_distinct("c_nationkey").alias("n_states"), F.count_distinct("c_custkey").alias("n_curricula"), F.count_distinct("c_mktsegment").alias("n_levels"))


@query(
    "d9_facet_histogram",
    """SELECT label, count(*) AS n, min(p_partkey) AS first_pos, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey), label) AS rank
FROM (SELECT unnest(string_split(p_type, ' ')) AS label, p_partkey FROM part) GROUP BY label""",
)
def d9_facet_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values by frequency; equal ones by where they came first. The final window is over labels only."""
    rows = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("label"), "p_partkey")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_pos"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_pos", "label")).cast("long"))


@query(
    "d10_shared_titles",
    "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' (' || p_partkey || ')' ELSE p_name END AS label FROM part",
)
def d10_shared_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("p_name"))
    label = F.when(n > 1, F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query(
    "d11_class_metrics",
    """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN position('!!' IN text) > 0 OR position(' | ' IN text) > 0 THEN 'bad' ELSE 'good' END AS guess FROM labels JOIN documents USING (doc_id)),
s AS (SELECT unnest(list_distinct([truth, guess])) AS class, truth, guess FROM r),
c AS (SELECT class, count(*) FILTER (truth = class AND guess = class) AS tp, count(*) FILTER (guess = class AND truth <> class) AS fp, count(*) FILTER (truth = class AND guess <> class) AS fn, count(*) FILTER (truth = class) AS support FROM s GROUP BY class)
SELECT *, CASE WHEN tp + fp > 0 THEN floor(tp * 1000000 / (tp + fp)) ELSE 0 END::BIGINT AS precision_e6, CASE WHEN tp + fn > 0 THEN floor(tp * 1000000 / (tp + fn)) ELSE 0 END::BIGINT AS recall_e6,
  CASE WHEN 2 * tp + fp + fn > 0 THEN floor(2 * tp * 1000000 / (2 * tp + fp + fn)) ELSE 0 END::BIGINT AS f1_e6 FROM c""",
)
def d11_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    guess = F.when(F.contains("text", F.lit("!!")) | F.contains("text", F.lit(" | ")), "bad").otherwise("good")
    return E.class_counts(rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), guess.alias("guess")), "truth", "guess")


@query(
    "d12_pooled_metrics",
    """WITH r AS (SELECT source, quality = 1 AS truth, NOT (position('!!' IN text) > 0 OR position(' | ' IN text) > 0) AS guess FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (guess AND NOT truth) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) AS n FROM r GROUP BY source
UNION ALL SELECT 'all', count(*) FILTER (truth AND guess), count(*) FILTER (guess AND NOT truth), count(*) FILTER (truth AND NOT guess), count(*) FROM r""",
)
def d12_pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per topic and, from those, over all topics."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    truth, guess = F.col("quality") == 1, ~(F.contains("text", F.lit("!!")) | F.contains("text", F.lit(" | ")))
    count = lambda c: F.count(F.when(c, 1))
    per = rows.groupBy("source").agg(count(truth & guess).alias("tp"), count(guess & ~truth).alias("fp"), count(truth & ~guess).alias("fn"), F.count("*").alias("n"))
    return per.unionByName(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n")]).withColumn("source", F.lit("all")).select(per.columns))


@query(
    "d13_lost_states",
    """WITH b AS (SELECT o_custkey % 25 AS state, count(*) AS before FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey % 25 AS state, count(*) AS after FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 25 NOT IN (3, 7) GROUP BY 1)
SELECT state, before, coalesce(after, 0) AS after FROM b LEFT JOIN a USING (state) WHERE coalesce(after, 0) * 2 < before""",
)
def d13_lost_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of which a new snapshot would lose over half of the rows: a guard before it is published."""
    rows = table(spark, sf_dir, "orders").withColumn("state", F.col("o_custkey") % 25)
    before = rows.where("o_orderstatus <> 'P'").groupBy("state").agg(F.count("*").alias("before"))
    after = rows.where("o_orderstatus = 'F' AND state NOT IN (3, 7)").groupBy("state").agg(F.count("*").alias("after"))
    return before.join(after, "state", "left").select("state", "before", F.coalesce("after", F.lit(0)).alias("after")).where("after * 2 < before")


@query(
    "d15_joined_values",
    "SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS flags, min(l_suppkey) AS sample FROM lineitem GROUP BY l_orderkey",
)
def d15_joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "|")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flags.alias("flags"), F.min("l_suppkey").alias("sample"))


@query(
    "e1_fair_cut",
    """WITH h AS (SELECT o_custkey AS curriculum, l_linenumber % 3 AS role_rank, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT curriculum, role_rank, l_orderkey, l_linenumber, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY curriculum, role_rank ORDER BY l_orderkey, l_linenumber) AS turn FROM h)
ORDER BY role_rank, turn, l_orderkey, l_linenumber LIMIT 2000""",
)
def e1_fair_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut is the feature: no curriculum crowds the others out of the first 2,000 hits."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    hits = rows.select(F.col("o_custkey").alias("curriculum"), (F.col("l_linenumber") % 3).alias("role_rank"), "l_orderkey", "l_linenumber")
    return T.fair_cut(hits, "curriculum", "role_rank", ["l_orderkey", "l_linenumber"], 2000).withColumn("turn", F.col("turn").cast("long"))


@query(
    "e6_round_robin",
    """SELECT o_custkey, turn, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY turn, o_orderstatus) AS r FROM (
    SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS turn FROM orders)) WHERE r = 1""",
)
def e6_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return K.round_robin(rows, "o_orderstatus", ["o_orderdate", "o_orderkey"], "o_custkey").select("o_custkey", F.col("turn").cast("long").alias("turn"), "o_orderstatus")


@query("g6_first_listing", "SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_partkey")
def g6_first_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return K.keep_first(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_shipdate")


def _closure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """region <- nation <- supplier as a closure with all ancestors, and the nodes with labels."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    r, n, s = F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("s"), F.col("s_suppkey"))
    nodes = region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.col("r_name").alias("label"))
    nodes = nodes.unionByName(nation.select(n.alias("node"), F.col("n_name").alias("label"))).unionByName(supplier.select(s.alias("node"), F.col("s_name").alias("label")))
    down = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    closure = nation.select(n.alias("node"), r.alias("ancestor")).unionByName(down.select(s.alias("node"), n.alias("ancestor"))).unionByName(down.select(s.alias("node"), r.alias("ancestor")))
    return closure, nodes


@query(
    "l1_closure_to_tree",
    """SELECT 'r' || r_regionkey AS node, r_name AS label, NULL AS parent, 0 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, 2 FROM supplier""",
)
def l1_closure_to_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = T.parents(*_closure(spark, sf_dir)).transform(cut)  # the recursion reads it once a level
    return tree.join(T.depths(spark, tree, cycles=True), "node").select("node", "label", "parent", "depth")


@query(
    "l4_reachable",
    """SELECT 'r' || r_regionkey AS node, 0 AS level FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey < 2
UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 2""",
)
def l4_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = T.parents(*_closure(spark, sf_dir))
    roots = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return T.reachable(tree.select("parent", F.col("node").alias("child")), roots, 3)


@query(
    "l5_path_to_root",
    """SELECT 's' || s_suppkey AS node, r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region""",
)
def l5_path_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = T.parents(*_closure(spark, sf_dir)).transform(cut)
    return T.walked(spark, tree, "label", "w.path || '/' || t.label", "path").select("node", "path")


@query(
    "l3_roles",
    """WITH f AS (SELECT l_suppkey AS node, unnest([l_returnflag, l_linestatus]) AS f FROM lineitem),
s AS (SELECT node, list_distinct(list(f)) AS fs FROM f GROUP BY node)
SELECT node, CASE WHEN list_contains(fs, 'R') AND node % 2 = 0 THEN 'topic' WHEN list_contains(fs, 'A') AND node % 3 = 0 THEN 'skill' WHEN list_contains(fs, 'N') AND node % 5 = 0 THEN 'content' ELSE 'unknown' END AS role FROM s""",
)
def l3_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first role, in a fixed order, whose class is among a node's; one set per node."""
    node, both = F.col("l_suppkey"), F.explode(F.array("l_returnflag", "l_linestatus"))
    sets = table(spark, sf_dir, "lineitem").select(node.alias("node"), both.alias("f")).groupBy("node").agg(F.collect_set("f").alias("fs"))
    order = [("topic", "R", 2), ("skill", "A", 3), ("content", "N", 5)]
    role = F.lit("unknown")
    for name, flag, step in reversed(order):
        role = F.when(F.array_contains("fs", flag) & (F.col("node") % step == 0), name).otherwise(role)
    return sets.select("node", role.alias("role"))


@query(
    "c12_gold_alignment",
    """WITH t AS (SELECT doc_id, left(sha1(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))), 16) AS h FROM documents),
l AS (SELECT doc_id AS label_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM t JOIN labels USING (doc_id)),
r AS (SELECT doc_id + 1 AS row_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM t WHERE doc_id % 10 <> 3),
m AS (SELECT label_id, row_id FROM l JOIN r USING (h, nth)),
i AS (SELECT label_id, row_id FROM l JOIN r ON label_id = row_id WHERE label_id NOT IN (SELECT label_id FROM m) AND row_id NOT IN (SELECT row_id FROM m))
SELECT label_id, row_id, 'hash' AS way FROM m UNION ALL SELECT label_id, row_id, 'id' FROM i""",
)
def c12_gold_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels meet rows whose ids have moved on by one: most by hash, some of the rest by id."""
    from tessella.functions.text import text_hash

    hashed = table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    labels = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    rows = hashed.where("doc_id % 10 <> 3").select((F.col("doc_id") + 1).alias("chunk_id"), "text_hash")
    return E.align(labels, rows)
