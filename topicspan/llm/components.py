"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node reachable.

    Every node points to its smallest neighbour, if that is smaller than itself;
    pointers are doubled until they end at a node that points nowhere. Links are
    then moved to these ends, and those inside one tree, and copies, are dropped:
    the next round has what is left of them, so a group of very many links is
    joined once, not in every round. Rounds read tables that were written before;
    a node with very many links is split by Spark's skew join.
    """
    edges = stored(_edges(links, F.col("a"), F.col("b")), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = stored(nodes.select("node", F.col("node").alias("root")), "roots")
    while not edges.isEmpty():
        ends = _ends(edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root"))
        of_a = ends.select(F.col("node").alias("a"), F.col("root").alias("__a"))
        of_b = ends.select(F.col("node").alias("b"), F.col("root").alias("__b"))
        moved = edges.join(of_a, "a", "left").join(of_b, "b")
        edges = stored(_edges(moved, F.coalesce("__a", "a"), F.col("__b")), "links")
        old = ends.select(F.col("node").alias("__old"), F.col("root").alias("__new"))
        roots = stored(
            roots.join(old, F.col("root") == F.col("__old"), "left").select(
                "node", F.coalesce("__new", "root").alias("root")
            ),
            "roots",
        )
    return roots


def _edges(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """Different links (a, b) between different nodes, the smaller one first."""
    apart = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("__apart"))
    return apart.where("__apart").select("a", "b").distinct()


def _ends(pointers: DataFrame) -> DataFrame:
    """``pointers`` (node, root), all to smaller nodes, followed to their ends by doubling."""
    found = stored(pointers, "pointers")
    while True:
        up = found.select(F.col("node").alias("__up"), F.col("root").alias("__root"))
        further = stored(
            found.join(up, F.col("root") == F.col("__up"), "left").select(
                "node", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")
            ),
            "pointers",
        )
        if further.where("moved").isEmpty():
            return found
        found = further.select("node", "root")
