"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Links that a partition holds at least, on average.
ROWS = 100_000


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's least neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return least.select("a", F.col("m").alias("b")).unionByName(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes that have links (a, b); component is the least node reachable.

    Each round is three to four shuffles over links only; it ends when every node hangs on its least one.
    A hub is never gathered: its links are split by AQE's skew handling and reduced by partial aggregates.
    Rounds keep as many partitions as there are links for (ROWS each): few links in many files cost more than the work.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = -(-links.count() // ROWS) or 1
    while True:
        links = cut(_small_star(_large_star(links.coalesce(parts))).coalesce(parts))
        # done when each node has one link, and no node is both linked and linked to
        roots = links.select(F.col("b").alias("a")).distinct()
        many = links.groupBy("a").count().where("count > 1")
        if links.join(roots, "a", "left_semi").isEmpty() and many.isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
