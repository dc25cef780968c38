"""Ranked retrieval: BM25 over any number of queries at once, strategies and their cascade, capsule ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import fulltext
from spanlake.operators.index import first_of
from spanlake.sources.corpus import written

CANDIDATES = 200


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(key, term), each term of a query once."""
    return queries.select(key, F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame, k: int = 20, doc: str = "doc_id", body: str = "text", key: str = "query_id", tokens: Column | None = None) -> DataFrame:
    """The search of ``fulltext.search`` over documents without a stored index."""
    return fulltext.search(written(fulltext.postings(docs, doc, body, tokens), "postings"), terms, k, doc, key)


def porter_terms(docs: DataFrame, body: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``terms``: full-text terms reduced to their stems; the stemmer has no built-in form."""
    from pyspark.sql.functions import pandas_udf

    from spanlake.functions.porter import stem

    @pandas_udf("array<string>")
    def stems(column):
        held: dict[str, str] = {}
        return column.map(lambda words: [held.get(w) or held.setdefault(w, stem(w)) for w in words])

    return docs.select(*keep, stems(T.terms(F.coalesce(F.col(body), F.lit("")))).alias("terms"))


def first_places(symbols: DataFrame, most: int) -> DataFrame:
    """Of each name the first lines of its first files: enough to give ``most`` places, in order, beside any one file.

    Without that file ``most`` files are left, each with a line at least.
    """
    files = symbols.withColumn("_f", F.dense_rank().over(Window.partitionBy("name").orderBy("file"))).where(F.col("_f") <= most + 1)
    return files.withColumn("_l", F.row_number().over(Window.partitionBy("name", "file").orderBy("line"))).where(F.col("_l") <= most).select("name", "file", "line")


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def cascade(queries: DataFrame, levels: list[DataFrame], last, key: str, enough: int = 3) -> DataFrame:
    """For each query the union of the first levels that has ``enough`` results; ``last`` instead where none has.

    Levels have (key, doc); each adds to those before it.  ``last(rest)`` gives (key,
    doc) for the queries that are left, and is made for these only.  ``level`` tells
    where a result was found first.
    """
    all_levels = levels[0].withColumn("_l", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        all_levels = all_levels.unionByName(x.withColumn("_l", F.lit(k)))
    docs = [c for c in levels[0].columns if c != key]
    seen = written(all_levels.groupBy(key, *docs).agg(F.min("_l").alias("_l")), "levels")
    per = seen.groupBy(key, "_l").agg(F.count("*").alias("_n"))
    total = per.withColumn("_n", F.sum("_n").over(Window.partitionBy(key).orderBy("_l")))
    stop = written(total.where(F.col("_n") >= enough).groupBy(key).agg(F.min("_l").alias("_stop")), "stops")
    found = seen.join(stop, key).where("_l <= _stop").withColumnRenamed("_l", "level").drop("_stop")
    rest = written(queries.select(key).distinct().join(stop.select(key), key, "left_anti"), "rest")
    return found.unionByName(last(rest).withColumn("level", F.lit(len(levels)))) if rest.count() else found


def abstain(seeds: Column, lexical: Column, top: Column) -> Column:
    """``abstain`` without any evidence, ``uncertain`` with weak evidence, else ``answer``."""
    return F.when((seeds == 0) & (lexical == 0), "abstain").when((seeds == 0) | (lexical == 0) | (top > -1.0), "uncertain").otherwise("answer")


def candidate_order(known: DataFrame, ranked: DataFrame, key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Known references first, in their order, then ranked candidates; each document once."""
    both = known.select(key, doc, F.lit(0).alias("source"), F.col("position").alias("_p")).unionByName(ranked.select(key, doc, F.lit(1).alias("source"), F.col("rank").alias("_p")))
    one = first_of(both, [key, doc], ["source", "_p"])
    return one.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("source", "_p", doc))).drop("_p")


def df_stratum(df: Column) -> Column:
    """Fixed bounds of document-frequency bands."""
    return F.when(df <= 1, "1").when(df <= 5, "2-5").when(df <= 20, "6-20").when(df <= 100, "21-100").otherwise(">100")


def document_frequency(docs: DataFrame, body: str = "text") -> DataFrame:
    """(term, df) of identifiers of four characters or more that aren't stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in T.STOP_WORDS])
    return docs.select(F.explode(F.array_except(words, stop)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def evenly_spaced(df: DataFrame, group: str, order: str, k: int, prefix: int = 3) -> DataFrame:
    """At most k rows of each group at evenly spaced ranks by a text column, rounded half to even.

    Ranks are counted in two levels, within the rows that share the first letters and
    over their numbers, so a group that holds most rows is never in one task.
    """
    rows = df.withColumn("_b", F.substring(order, 1, prefix))
    per = rows.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(group)).alias("_n"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_b").orderBy(order)) - 1).join(per, [group, "_b"]).withColumn("_i", F.col("_i") + F.col("_base"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / float(k - 1), 0).cast("long"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(at, F.col("_i"))).drop("_n", "_i", "_b", "_base")
