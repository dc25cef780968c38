"""Connected components of a graph of links, without collecting it.

Alternating large-star and small-star rounds: each joins a node's neighbours to
the smallest of them, until nothing changes.  Every round is written to the
shared folder, so a lost executor costs at most one round; the round before it is
then removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import forget, written


def components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    Links may be given in either direction, repeatedly, and to the node itself
    (such nodes are in the result if they have another link).  No links give no rows.
    """
    links = links.where(f"{u} is not null and {v} is not null and {u} <> {v}").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links, before = written(links, "links"), None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = links
        links = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(done)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Components of nodes 0..n-1 in one task's memory; links come in arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            if not (apart := a != b).any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from each node that has a smaller one in its component to the smallest."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
