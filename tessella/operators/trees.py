"""Trees from closures: parents, depths, roles and levels."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.shared import cut

MAX_DEPTH = 30


def parents(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent): of a node's ancestors among the nodes the one that has most ancestors itself.

    closure has (node, ancestor); ties go to the smaller label, then to the smaller id. Direct edges only give
    the same tree, as each node then has one ancestor.
    """
    known = nodes.select(F.col("node").alias("ancestor"), F.col("label").alias("_label"))
    edges = closure.where("node <> ancestor").distinct().join(known, "ancestor")
    sizes = edges.groupBy("node").agg(F.count("*").alias("_n")).withColumnRenamed("node", "ancestor")
    ranked = edges.join(sizes, "ancestor", "left").select("node", F.struct((-F.coalesce("_n", F.lit(0))).alias("a"), F.col("_label").alias("b"), F.col("ancestor").alias("c")).alias("r"))
    best = ranked.groupBy("node").agg(F.min("r").alias("r")).select("node", F.col("r.c").alias("parent"))
    return nodes.join(best, "node", "left").select("node", "label", "parent")


def walked(spark: SparkSession, tree: DataFrame, start: str, step: str, value: str) -> DataFrame:
    """(node, value, depth) by a bounded recursion from the roots; step sees `t`, the node, and `w`, its parent's row."""
    view = f"_tree_{uuid.uuid4().hex}"
    tree.createOrReplaceTempView(view)
    try:
        return spark.sql(
            f"""
            WITH RECURSIVE walk(node, {value}, depth) AS (
              SELECT node, {start}, 0 FROM {view} WHERE parent IS NULL
              UNION ALL
              SELECT t.node, {step}, w.depth + 1 FROM {view} t JOIN walk w ON t.parent = w.node WHERE w.depth < {MAX_DEPTH})
            SELECT node, {value}, depth FROM walk
            """
        )
    finally:
        spark.catalog.dropTempView(view)  # the frame holds the plan, not the name


def depths(spark: SparkSession, tree: DataFrame, cycles: bool = False) -> DataFrame:
    """(node, depth): steps to the root. Nodes that lead to a cycle are left out; with cycles, their depth is the steps until one comes back to a node met before.

    tree is read once a level; if it is not cheap, cut it before.
    """
    down = walked(spark, tree, "true", "true", "reached").groupBy("node").agg(F.min("depth").alias("depth"))
    if not cycles:
        return down
    lost = tree.join(down, "node", "left_anti").select("node", F.array("node").alias("met"), F.col("parent").alias("next"))
    up, found = tree.select(F.col("node").alias("next"), F.col("parent").alias("above")), [down]
    for _ in range(MAX_DEPTH):
        if lost.isEmpty():
            break
        back = F.coalesce(F.array_contains("met", F.col("next")), F.lit(True))
        found.append(lost.where(back).select("node", (F.size("met") - 1).alias("depth")))
        lost = lost.where(~back).join(up, "next").select("node", F.concat("met", F.array("next")).alias("met"), F.col("above").alias("next")).transform(cut)
    return reduce(DataFrame.unionByName, [f.withColumn("depth", F.col("depth").cast("int")) for f in found])


def fair_cut(hits: DataFrame, group: str, rank: str, order: list[str], limit: int) -> DataFrame:
    """At most limit hits: by rank, then the first of each group, then the second, and so on."""
    turn = F.row_number().over(Window.partitionBy(group, rank).orderBy(*order))
    return hits.withColumn("turn", turn).orderBy(rank, "turn", *order).limit(limit)


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level): each node reached from the roots (node) within depth steps, once, at its least level."""
    seen = roots.select("node", F.lit(0).alias("level")).distinct()
    front = seen
    for level in range(1, depth + 1):
        step = front.select(F.col("node").alias("parent")).join(edges.select("parent", "child"), "parent").select(F.col("child").alias("node")).distinct()
        front = step.join(seen.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen
