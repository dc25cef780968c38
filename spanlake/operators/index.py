"""Facts of a corpus, snapshots and their incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T

#: Declaration rules: kind, pattern with the name in group 1, confidence, provenance.
LINE_HEAD = ("head", r"^[ \t]*([A-Za-z_][A-Za-z0-9_]*)", 0.9, "line-head")


def symbols(lines: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """name, kind, file, line, content_hash, provenance, confidence of every line that a rule matches.

    ``lines`` has file, line, text and the file's content_hash.
    """
    rules = rules or [LINE_HEAD]
    found = F.array(*[F.struct(F.regexp_extract("text", p, 1).alias("name"), F.lit(k).alias("kind"), F.lit(v).alias("provenance"), F.lit(float(c)).alias("confidence")) for k, p, c, v in rules])
    hits = lines.select("file", "line", "content_hash", F.explode(found).alias("s")).where("s.name <> ''")
    return hits.select("s.name", "s.kind", "file", "line", "content_hash", "s.provenance", "s.confidence")


def snapshot(files: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    return files.select(F.col(key).alias("path"), T.content_hash(F.col(body)).alias("content_hash"), F.octet_length(body).cast("long").alias("size"))


def incremental_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): new, changed, skipped or gone, by content hash."""
    a, b = old.select("path", F.col("content_hash").alias("_o")), new.select("path", F.col("content_hash").alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_o") != F.col("_n"), "changed").otherwise("skipped")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def incremental_apply(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old snapshot that still hold, and the new rows of the others."""
    diff = incremental_diff(old, new)
    kept = old.join(diff.where("state = 'skipped'").select("path"), "path", "left_semi")
    fresh = new.join(diff.where("state in ('new', 'changed')").select("path"), "path", "left_semi")
    return kept.unionByName(fresh)


def generation_hash(snapshot: DataFrame) -> DataFrame:
    """One row: a hash of all rows that doesn't depend on their order.

    A tree of fixed shape over the hash of the path: rows are hashed in path order
    within 65,536 leaves, leaves within 256 branches, and branches at the root, so
    a billion rows make leaves of about 15,000.
    """
    line = F.concat_ws("|", "path", "content_hash", F.col("size").cast("string"))

    def level(rows: DataFrame, by: list, order, value) -> DataFrame:
        grouped = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))).alias("s"))
        return grouped.select(*by, "n", F.sha2(F.array_join(F.transform("s", lambda x: x["v"]), "\n"), 256).alias("h"))

    rows = snapshot.select(F.substring(F.sha2("path", 256), 1, 4).alias("leaf"), "path", line.alias("l"), F.lit(1).cast("long").alias("n"))
    leaves = level(rows, ["leaf"], F.col("path"), F.col("l")).withColumn("branch", F.substring("leaf", 1, 2))
    branches = level(leaves, ["branch"], F.col("leaf"), F.col("h"))
    return level(branches, [], F.col("branch"), F.col("h")).select(F.col("n").alias("n_files"), F.col("h").alias("generation"))


def corpus_equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(state, n): how many paths are in common, differ in content, or are on one side only."""
    a, b = left.select("path", F.col("content_hash").alias("_l")), right.select("path", F.col("content_hash").alias("_r"))
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_l") == F.col("_r"), "common").otherwise("hash_diff")
    return a.join(b, "path", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def census(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Per module: files, lines, bytes."""
    n = lines.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return files.join(n, "doc_id", "left").groupBy("module").agg(F.count("*").alias("files"), F.coalesce(F.sum("_n"), F.lit(0)).alias("lines"), F.sum("size").alias("bytes"))


def unresolved_rate(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per module: files, those without any symbol, and their share."""
    has = symbols.select(F.col("file").alias("doc_id")).distinct().withColumn("_has", F.lit(True))
    out = files.join(has, "doc_id", "left").groupBy("module").agg(F.count("*").alias("files"), F.count_if(F.col("_has").isNull()).alias("without"))
    return out.withColumn("rate", F.round(F.col("without") / F.col("files"), 6))


#: What each state of a stored snapshot means to its user; only ``ok`` can serve.
ADVICE = {
    "ok": None,
    "missing": "build the index, or read and search the files directly",
    "empty": "no files in the index; build it from the right root",
    "corrupt": "not a valid index; remove and build it again",
    "incompatible": "another version of the schema; build it again from nothing",
}


def doctor(spark, path: str) -> DataFrame:
    """One row: the state of a stored snapshot (a key of ``ADVICE``), its files, advice, and whether it can serve."""
    n = None
    try:
        found = spark.read.parquet(path)
        if not {"path", "content_hash"} <= set(found.columns):
            state = "incompatible"
        else:
            n = found.count()
            state = "ok" if n else "empty"
    except Exception as e:  # the reader's error class says which
        state = "missing" if "PATH_NOT_FOUND" in str(e) else "corrupt"
    return spark.createDataFrame([(path, state, n, ADVICE[state], state == "ok")], "path string, state string, n_files long, advice string, can_serve boolean")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given (a total one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
