"""Bounded searches on a graph of edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.sources.corpus import written


def two_hop(edges: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` chains a, b, c (c other than a) of each a, by b and c.

    Of a node's edges only the first ``most`` + 1 can stand at a chain's end, so a hub
    is cut before the join.
    """
    e = edges.select("src", "dst").distinct()
    ends = e.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_r") <= most + 1).select(F.col("src").alias("dst"), F.col("dst").alias("c"))
    chains = e.join(ends, "dst").where("c <> src").select(F.col("src").alias("a"), F.col("dst").alias("b"), "c")
    return chains.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("b", "c"))).where(F.col("_r") <= most).drop("_r")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """(src, dst, path, hops): a shortest path for each pair that has one, of ties the smallest.

    ``pairs`` are stated queries.  Each round joins the frontier with the edges
    and keeps the smallest path to each node that wasn't reached before, so the
    frontier holds a node once for each start.  Frontiers are written, so no round
    computes those before it again.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    starts = pairs.select(F.col("src").alias("start")).distinct()
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    seen, found = front, None
    for _ in range(depth):
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = written(step.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen.select("start", "node"), ["start", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(front)
        hit = front.join(pairs.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), ["start", "node"])
        found = hit if found is None else found.unionByName(hit)
    return found.select(F.col("start").alias("src"), F.col("node").alias("dst"), "path", (F.size("path") - 1).alias("hops"))


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """All paths of up to ``most`` edges without a repeated node between the stated pairs."""
    e = edges.select("src", "dst").distinct()
    walk = pairs.select("src", "dst", F.array("src").alias("path"))
    found = None
    for _ in range(most):
        walk = walk.join(e.select(F.col("src").alias("_a"), F.col("dst").alias("_b")), F.element_at("path", -1) == F.col("_a"))
        walk = walk.where(~F.array_contains("path", F.col("_b"))).select("src", "dst", F.concat("path", F.array("_b")).alias("path"))
        hit = walk.where(F.element_at("path", -1) == F.col("dst"))
        found = hit if found is None else found.unionByName(hit)
        walk = walk.where(F.element_at("path", -1) != F.col("dst"))
    return found
