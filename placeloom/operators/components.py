"""Graph operators: connected components and transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a root: then edges are the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the long columns (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds: each is two hash joins of the edges with the
    smallest neighbour of a node, which is a partial aggregate first, so that AQE may split a hub's
    side of the join. A round's edges are written to the shared folder; rounds grow as the
    logarithm of the longest path, and there are none for edges that are stars around their
    smallest node. Null ends and loops are ignored; no edges: no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): every node that a root reaches over (source, target), itself included.

    Breadth first: each round joins only what the last one found new, so cycles end. Nulls are ignored.
    """
    edges = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    new = stored(roots.select(F.col("root"), F.col("root").alias("node")).where("root IS NOT NULL").distinct(), "frontier")
    seen = new
    while not new.isEmpty():
        step = new.join(edges, new.node == edges.source).select("root", F.col("target").alias("node")).distinct()
        new = stored(step.join(seen, ["root", "node"], "left_anti"), "frontier")
        seen = stored(seen.union(new), "seen")
    return seen
