"""Nearest neighbours of a query set by a block matrix join.

Candidates and queries are cut in tiles, and each pair of tiles is one task's
work: the product of the tiles' int8 codes gives every cosine with a bound of its
quantisation error, and pairs whose upper bound reaches the k-th best lower bound
of their query are computed again in double precision.  A heap keeps the k best
of a query in a tile; the tiles' lists are merged by rank.  The result is exact.

Results for odd input: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors of different lengths
are not compared; rows that repeat an id are candidates of their own, but a row
with the query's id is never its candidate, and of query rows that repeat an id the
one with the shortest, then smallest vector asks; ties go to the smaller id; fewer
candidates than k give fewer rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.vectors import cosines, directions, matrix, usable


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, and the length of what the codes miss."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    missed = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-6
    return q, scale, missed


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, strip: int = 256) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of the k best candidates of each query within a pair of tiles."""
    a, sa, ea = codes(directions(queries).astype(np.float64))
    b, sb, eb = codes(directions(rows).astype(np.float64))
    b_t = b.T.astype(np.float32)  # whole numbers below 2**24: their products and sums are exact
    out = []
    for low in range(0, len(query_ids), strip):
        q = slice(low, low + strip)
        near = (a[q].astype(np.float32) @ b_t) * (sa[q, None] * sb).astype(np.float32)
        error = (ea[q, None] + (1 + ea[q, None]) * eb).astype(np.float32) + np.float32(1e-5)
        own = query_ids[q, None] == ids
        lower = np.where(own, -np.inf, near - error)
        kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(near), -np.inf)
        i, j = np.nonzero(~own & (near + error >= kth[:, None]))
        score = np.concatenate([cosines(queries[q][i[s : s + 100_000]], rows[j[s : s + 100_000]]) for s in range(0, len(i), 100_000)]) if len(i) else np.zeros(0)
        edges = np.searchsorted(i, np.arange(len(near) + 1)).tolist()
        for r, query in enumerate(query_ids[q].tolist()):
            s = slice(edges[r], edges[r + 1])
            best = heapq.nsmallest(k, zip((-score[s]).tolist(), ids[j[s]].tolist(), strict=True))
            out += [(query, c, -m) for m, c in best]
    return out


def nearest(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", tile_rows: int = 8192, tile_queries: int = 8192) -> DataFrame:
    """query_id, rank (from 1), the candidate's key and score (cosine) for rows where ``is_query`` holds, against all rows."""
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.size(vector).alias("_dim"), is_query.alias("_q"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    across, down = max(1, -(-n["n"] // tile_rows)), max(1, -(-n["q"] // tile_queries))
    deal = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("_id", "_v", "_dim", deal(across, "rows").alias("_x"), every(down).alias("_y"))
    asking = rows.where("_q").groupBy("_id").agg(F.min(F.struct("_dim", "_v")).alias("_least")).select("_id", "_least.*")
    left = asking.select("_id", "_v", "_dim", deal(down, "queries").alias("_y"), every(across).alias("_x"))
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        found = tile_best(q["_id"].to_numpy(), matrix(q["_v"]), c["_id"].to_numpy(), matrix(c["_v"]), k)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else schema.empty_table()

    by = ("_dim", "_x", "_y")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
