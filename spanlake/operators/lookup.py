"""Lookup of names: exact, by substring, definitions, references and known tokens.

Needles are a request's names: a short list that the caller holds, so a scan of
lines against them is a filter with a broadcast list, never a shuffle of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text as T

MAX_NEEDLES = 10_000


def needles(df: DataFrame, names: list[str]) -> DataFrame:
    """The names as a table small enough to send to every task."""
    if len(names) > MAX_NEEDLES:
        raise ValueError(f"more than {MAX_NEEDLES} names at once; split the request")
    return F.broadcast(df.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "needle string"))


def find_symbol(symbols: DataFrame, names: list[str], exact: bool = True, raw_like: bool = False) -> DataFrame:
    """Symbols by name, or whose name contains it without regard to the case of A-Z.

    With ``raw_like`` the wildcards ``%`` and ``_`` of a needle keep their meaning.
    """
    n = needles(symbols, names)
    if exact:
        return symbols.join(n, F.col("name") == F.col("needle"))
    low = lambda c: T.ascii_lower(F.col(c))
    if raw_like:
        return symbols.join(n, F.expr("name ilike concat('%', needle, '%')"))
    return symbols.join(n, F.contains(low("name"), low("needle")))


def find_definition(symbols: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """Symbols of the kinds that define; for a name without such, all of that name."""
    found = find_symbol(symbols, names).withColumn("_def", F.col("kind").isin(kinds))
    has = found.groupBy("needle").agg(F.bool_or("_def").alias("_has"))
    return found.join(F.broadcast(has), "needle").where("_def or not _has").drop("_def", "_has")


def find_references(lines: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Every line that contains a name literally, with an excerpt."""
    hit = lines.join(needles(lines, names), F.contains(F.col("text"), F.col("needle")))
    return hit.select("needle", key, "line", T.excerpt(F.col("text")).alias("excerpt"), F.lit(0.7).alias("confidence"))


def cooccurring(refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """References in files where another of the names is referenced too; all if there is one name only."""
    names = refs.select("needle").distinct().count()
    if names < 2:
        return refs
    both = refs.groupBy(key).agg(F.count_distinct("needle").alias("_n")).where("_n > 1").select(key)
    return refs.join(both, key, "left_semi")


def known_tokens(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (with ``token``) that are names of symbols."""
    return tokens.join(symbols.select(F.col("name").alias("token")).distinct(), "token", "left_semi")
