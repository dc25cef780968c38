"""Measurement analytics: quantiles in two conventions, paired ratios, fidelity, delivery scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, q: float) -> Column:
    """The value at 1-based rank ceil(q n) of the non-null ones."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def summarize(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, p50, p95, max and mean; the median of an even number is the mean of the middle two."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("p50"), nearest_rank(value, 0.95).alias("p95"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))


def floor_index(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The second convention: the value at 0-based index min(n - 1, floor(q n))."""
    w = Window.partitionBy(*by)
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)) + 1
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    return ranked.where(F.col("_r") == at).select(*by, F.col(value).alias("value"))


def paired_ratio(runs: DataFrame, pair: list[str], arm: str, arms: tuple[str, str], value: str) -> DataFrame:
    """Per pair the median of each arm and their ratio; pairs with both arms and a non-zero divisor."""
    m = runs.where(F.col(arm).isin(*arms)).groupBy(*pair).pivot(arm, list(arms)).agg(F.median(value))
    a, b = (F.col(f"`{x}`") for x in arms)
    return m.where(a.isNotNull() & (b != 0)).select(*pair, a.alias("a"), b.alias("b"), F.round(a / b, 6).alias("ratio"))


def score_delivery(delivered: DataFrame, truth: DataFrame, key: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """hit, recall and precision of each query; null where the denominator is unknown, never 0."""
    d, t = delivered.select(key, doc).distinct(), truth.select(key, doc).distinct()
    both = d.withColumn("_d", F.lit(1)).join(t.withColumn("_t", F.lit(1)), [key, doc], "full_outer")
    n = both.groupBy(key).agg(F.count("_d").alias("n_delivered"), F.count("_t").alias("n_expected"), F.count(F.col("_d") * F.col("_t")).alias("n_common"))
    ratio = lambda x, y: F.round(F.col(x) / F.nullif(F.col(y), F.lit(0)), 6)
    return n.withColumn("hit", F.when(F.col("n_expected") > 0, F.col("n_common") > 0)).withColumn("recall", ratio("n_common", "n_expected")).withColumn("precision", ratio("n_common", "n_delivered"))


def score_additional(delivered: DataFrame, expected: DataFrame, given: DataFrame, key: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """Scores of what goes beyond the documents given; for a query that expects nothing recall is null and silence counts."""
    novel = delivered.select(key, doc).distinct().join(given.select(key, doc), [key, doc], "left_anti")
    n = novel.groupBy(key).agg(F.count("*").alias("novel"))
    e = expected.select(key, doc).distinct()
    want = e.groupBy(key).agg(F.count("*").alias("expected"))
    got = novel.join(e, [key, doc]).groupBy(key).agg(F.count("*").alias("found"))
    keys = delivered.select(key).union(expected.select(key)).union(given.select(key)).distinct()
    out = keys.join(n, key, "left").join(want, key, "left").join(got, key, "left").fillna(0, ["novel", "expected", "found"])
    return out.withColumn("recall", F.round(F.col("found") / F.nullif(F.col("expected"), F.lit(0)), 6)).withColumn("abstained", F.when(F.col("expected") == 0, F.col("novel") == 0))


def replayed(first: DataFrame, again: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: items, and how many have a score that isn't the same in both, or are missing in one."""
    cols = [c for c in first.columns if c != key]
    j = first.select(key, F.struct(*cols).alias("_a")).join(again.select(key, F.struct(*cols).alias("_b")), key, "full_outer")
    return j.agg(F.count("*").alias("items"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differences"))


def hit_rules(delivered: DataFrame, expected: DataFrame, key: str = "item_id", file: str = "file") -> DataFrame:
    """Three readings of whether an answer is hit: ``loose``, ``sweep`` and ``canonical``.

    ``expected`` has (key, field, value), field one of files, edge, path, package, file.
    Any of ``files`` is a hit for all.  With edges, ``loose`` asks for one of their files,
    ``sweep`` also for one of the path's if there is a path, ``canonical`` for one of the
    path's first and then for an edge's if there are edges.  A package is hit by its
    file or by any file below it.
    """
    got = delivered.select(key, F.col(file).alias("value")).distinct()
    j = expected.where("field <> 'package'").join(got.withColumn("_d", F.lit(True)), [key, "value"], "left")
    has = lambda f: F.coalesce(F.bool_or(F.col("field") == f), F.lit(False)).alias(f"has_{f}")
    hit = lambda f: F.coalesce(F.bool_or((F.col("field") == f) & F.col("_d").isNotNull()), F.lit(False)).alias(f"hit_{f}")
    named = ("files", "edge", "path", "file")
    flags = j.groupBy(key).agg(*[has(f) for f in named], *[hit(f) for f in named])
    package = expected.where("field = 'package'").select(key, F.col("value").alias("_p"))
    below = package.join(got, key, "left").groupBy(key).agg(F.coalesce(F.bool_or(F.startswith(F.col("value"), F.col("_p"))), F.lit(False)).alias("hit_package"))
    f = expected.select(key).distinct().join(flags, key, "left").join(below, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rest = F.when(F.col("hit_package").isNotNull(), yes("hit_file") | yes("hit_package")).otherwise(yes("has_file") & yes("hit_file"))
    loose = F.when(yes("has_files"), yes("hit_files")).when(yes("has_edge"), yes("hit_edge")).otherwise(rest)
    sweep = F.when(yes("has_files"), yes("hit_files")).when(yes("has_edge"), yes("hit_edge") & (~yes("has_path") | yes("hit_path"))).otherwise(rest)
    canonical = F.when(yes("has_files"), yes("hit_files")).when(yes("has_path"), yes("hit_path") & (~yes("has_edge") | yes("hit_edge"))).when(yes("has_edge"), yes("hit_edge")).otherwise(rest)
    return f.select(key, loose.alias("loose"), sweep.alias("sweep"), canonical.alias("canonical"))
