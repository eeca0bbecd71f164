"""Distances and reachability in graphs that are tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.shared import stored


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """(node, distance): how many edges (a, b) each node is from the nearest of ``sources`` (node).
    Breadth first: each round joins the edges with the last round's new nodes only, and what was
    visited before drops out by an anti join; nodes that nothing reaches have no row.

    Defined cases: null ends are no edges; a source that no edge touches is at 0; repeated rows,
    loops and rings change nothing; without sources there are no rows. A node of many neighbours
    meets them by a join whose large partitions Spark splits, and new nodes are made distinct before
    they are shuffled.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).where("a is not null and b is not null")
    if not directed:
        both = both.unionByName(both.select(F.col("to").alias("node"), F.col("node").alias("to")))
    both = stored(both.distinct(), "edges")
    new = stored(sources.select("node").where("node is not null").distinct().withColumn("distance", F.lit(0)), "frontier")
    seen, depth = new, 0
    while not new.isEmpty() and (most is None or depth < most):
        depth += 1
        reached = both.join(new.select("node"), "node").select(F.col("to").alias("node")).distinct()
        new = stored(reached.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(depth)), "frontier")
        seen = seen.unionByName(new)
    return seen


def reachable(edges: DataFrame) -> DataFrame:
    """(node, to): all pairs of different nodes, or a node on a ring and itself, with a path along
    the edges (a, b). Semi-naive: each round goes one edge on from the last round's new pairs."""
    step = stored(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    new = all_ = stored(step.select(F.col("a").alias("node"), F.col("b").alias("to")), "pairs")
    while not new.isEmpty():
        more = new.join(step.select(F.col("a").alias("to"), "b"), "to").select("node", F.col("b").alias("to")).distinct()
        new = stored(more.join(all_, ["node", "to"], "left_anti"), "pairs")
        all_ = all_.unionByName(new)
    return all_
