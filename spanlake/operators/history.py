"""Policies for message histories.  A unit is a user's message with the answers up to the next one; system messages stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T


def messages(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, tokens, unit (null for system) and the unit's size."""
    talk = F.col("role") != "system"
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = df.select("conv_id", "turn", "role", "text", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return m.withColumn("unit", F.when(talk, F.sum((F.col("role") == "user").cast("int")).over(w)))


def tail(m: DataFrame, n: int) -> DataFrame:
    """System messages and whole units from the end until there are n messages or more."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("unit"))
    size = m.where("unit is not null").groupBy("conv_id", "unit").agg(F.count("*").alias("_s"))
    size = size.withColumn("_after", F.sum("_s").over(after) - F.col("_s")).where(F.col("_after") < n).select("conv_id", "unit")
    return m.where("unit is null").unionByName(m.join(size, ["conv_id", "unit"], "left_semi").select(m.columns))


def head(m: DataFrame, n: int) -> DataFrame:
    """Whole units from the start until there are n messages or more."""
    before = Window.partitionBy("conv_id").orderBy("unit")
    size = m.where("unit is not null").groupBy("conv_id", "unit").agg(F.count("*").alias("_s"))
    size = size.withColumn("_before", F.sum("_s").over(before) - F.col("_s")).where(F.col("_before") < n).select("conv_id", "unit")
    return m.join(size, ["conv_id", "unit"], "left_semi").select(m.columns)


def cliff(m: DataFrame, budget: int, head_n: int, tail_n: int) -> DataFrame:
    """Conversations above the budget keep their head and tail; a marker row with the number left out takes the middle's place."""
    total = m.groupBy("conv_id").agg(F.sum("tokens").alias("_t"))
    over = m.join(total.where(F.col("_t") > budget).select("conv_id"), "conv_id", "left_semi")
    kept = head(over, head_n).unionByName(tail(over, tail_n).select(m.columns)).distinct()
    gone = over.join(kept.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    marker = gone.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.count("*").alias("_n")).select(
        "conv_id", "turn", F.lit("marker").alias("role"), F.concat(F.lit("["), F.col("_n").cast("string"), F.lit(" left out]")).alias("text"), F.lit(4).alias("tokens"), F.lit(None).cast("bigint").alias("unit"))
    under = m.join(total.where(F.col("_t") <= budget).select("conv_id"), "conv_id", "left_semi")
    return under.unionByName(kept).unionByName(marker)
