"""Question sets made from a corpus: the first few by name, each with an answer that was read in the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 10


def first_edges(edges: DataFrame, k: int) -> DataFrame:
    """The first k calls by caller, callee, file and line, numbered from 0."""
    order = ["caller", "callee", "path", "line"]
    return edges.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)  # k rows


def call_questions(edges: DataFrame, lines: DataFrame, most: int = MOST) -> DataFrame:
    """category, id, question, answer.  C: where a call is; F: the folder of a caller; E: another place that names
    the callee; G: up to two such files.

    E and G take the first calls whose callee is named in another file; the calls looked at are doubled until
    there are enough or no more.
    """
    total, k = edges.count(), 6 * most
    while True:
        some = first_edges(edges, k)
        names = F.broadcast(some.select("callee").distinct())  # k names at most
        hit = lines.join(names, F.contains(F.col("text"), F.col("callee"))).select("callee", F.col("path").alias("file"), F.col("line").alias("at"))
        # two lines of each of the first three files hold the first two outside any one file
        per = hit.withColumn("_r", F.row_number().over(Window.partitionBy("callee", "file").orderBy("at"))).where("_r <= 2")
        per = per.withColumn("_f", F.dense_rank().over(Window.partitionBy("callee").orderBy("file"))).where("_f <= 3")
        out = some.join(per, "callee").where("file <> path").withColumn("_r", F.row_number().over(Window.partitionBy("place").orderBy("file", "at"))).where("_r <= 2")
        two = out.groupBy("place", "callee").agg(F.sort_array(F.collect_list(F.struct("file", "at"))).alias("refs"))
        if k >= total or two.count() >= most:
            break
        k *= 2
    asked = two.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place")) - 1).where(F.col("n") < most)  # k rows
    ask = lambda df, kind, n, question, answer: df.select(F.lit(kind).alias("category"), F.concat(F.lit(f"{kind}-"), n.cast("string")).alias("id"), question.alias("question"), answer.alias("answer"))
    at = lambda file, line: F.concat(file, F.lit(":"), line.cast("string"))
    first, place, n = some.where(F.col("place") < most), F.col("place"), F.col("n")
    c = ask(first, "C", place, F.concat("caller", F.lit(" calls "), "callee"), at(F.col("path"), F.col("line")))
    f = ask(first, "F", place, F.concat(F.lit("where is "), "caller"), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit(" "), "path"))
    e = ask(asked, "E", n, F.concat(F.lit("who calls "), "callee"), at(F.col("refs")[0]["file"], F.col("refs")[0]["at"]))
    g = ask(asked, "G", n, F.concat(F.lit("what changes with "), "callee"), F.array_join(F.transform("refs", lambda r: r["file"]), " "))
    return c.unionByName(f).unionByName(e).unionByName(g)


def query_set(queries: DataFrame, edge: DataFrame | None, limit: int | None, order: list[str]) -> DataFrame:
    """The stratified queries, then the edge cases, as many as the limit says; numbered from 1."""
    rows = queries.withColumn("part", F.lit(0))
    if edge is not None:
        rows = rows.unionByName(edge.withColumn("part", F.lit(1)))
    if limit is not None:
        rows = rows.orderBy("part", *order).limit(limit)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("part", *order)))  # a request's queries


def pairing_manifest(tasks: DataFrame, conditions: list[str], repetitions: int, budget: int, sha: str, tokenizer: str = "chars//4") -> DataFrame:
    """A canonical manifest for each task, condition and repetition; the order of conditions alternates, no clock is read."""
    each = [(c, r, (k if r % 2 == 0 else len(conditions) - 1 - k)) for r in range(repetitions) for k, c in enumerate(conditions)]
    runs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(r).alias("repetition"), F.lit(o).alias("order")) for c, r, o in each]))
    rows = tasks.select("task_id", runs.alias("x")).select("task_id", "x.*")
    doc = F.struct(F.lit(budget).alias("budget"), "condition", "order", "repetition", F.lit(sha).alias("sha"), "task_id", F.lit(tokenizer).alias("tokenizer"))
    return rows.withColumn("manifest", F.to_json(doc))
