"""Tables, corpora of files, and the sinks for results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import text as T

#: Folders that a walk leaves out.
EXCLUDED = ["target", "node_modules", "dist", "build", ".venv"]
MAX_FILE_BYTES = 2 << 20
EXTENSION = {"en": "py", "fr": "java", "de": "md", "es": "dat"}


#: Tables with texts, whose rows cost far more to read than to move.
TEXTS = {"documents", "pages"}
#: Products of tables written in this session, by application, tag and state of the table's files.
STORED: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table too small to be scanned by every core are dealt to all of them; others are left as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a session on one machine that names none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spanlake-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows written once to the shared folder and read again; this cuts the lineage."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_state(spark: SparkSession, path: str) -> tuple:
    """(path, bytes, time of change) of every file below a path; the driver lists, nothing is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, tag: str, source: str, write: Callable[[str], None]) -> DataFrame:
    """A product of the table at ``source`` (an index), written to the shared folder by ``write(path)``.

    Later requests of the application read it again while the table's files are the same.
    """
    key = (spark.sparkContext.applicationId, tag, source, file_state(spark, source))
    if key in STORED:  # the folder may have been cleared since
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{STORED[key]}/_SUCCESS")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            del STORED[key]
    if key not in STORED:
        path = fresh_path(spark, tag)
        write(path)
        STORED[key] = path
    return spark.read.parquet(STORED[key])


def files(spark: SparkSession, root: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """path (below ``root``), content, size and body (invalid UTF-8 replaced) of every file.

    With ``max_bytes`` larger files are left out by the scan, which then doesn't read them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    rel = F.regexp_replace("path", "^[a-z0-9]+:/*" + base.replace(".", r"\.") + "/", "")
    body = F.expr("make_valid_utf8(cast(content as string))")
    return raw.select(rel.alias("path"), "content", F.col("length").alias("size"), body.alias("body"))


def discover(found: DataFrame, include: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds ``lang`` and ``reason``: why a file is left out, or ``kept``.

    Needs path, size and head (the first 8 KiB as text or bytes).  Files below
    excluded folders or hidden ones are ``excluded``; nothing is dropped silently.
    """
    lang = T.language(F.col("path"))
    hidden = F.col("path").rlike(r"(^|/)(" + "|".join(d.replace(".", r"\.") for d in EXCLUDED) + r"|\.[^/]+)/")
    wanted = lang.isin(include) if include else F.lit(True)
    reason = (
        F.when(hidden, "excluded").when(lang.isNull(), "unsupported").when(~wanted, "excluded_by_filter")
        .when(F.col("size") > max_bytes, "too_large").when(F.instr("head", "\0") > 0, "binary").otherwise("kept")
    )
    return found.withColumn("lang", lang).withColumn("reason", reason)


def document_files(docs: DataFrame) -> DataFrame:
    """The documents table as source files: path, body, size, module."""
    ext = F.create_map(*[F.lit(x) for kv in EXTENSION.items() for x in kv])
    path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(ext[F.col("lang")], F.lit("txt")))
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", path.alias("path"), body.alias("body"), F.octet_length(body).alias("size"), F.col("source").alias("module"))


def line_scan(found: DataFrame, key: str = "doc_id", body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, line from 1, text) and ``keep``: every line of every file."""
    return found.select(key, *keep, F.posexplode(T.lines(F.col(body))).alias("_pos", "text")).select(key, (F.col("_pos") + 1).alias("line"), "text", *keep)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file, replacing one that is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One compact document a row; nulls are kept, as null and 0 differ."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    """Stores a snapshot; readers see the one before until the whole new one is there.

    Each is a folder of its own; a small file that is replaced in one step names the current one.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(f"{path}/{version}")
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(f"{path}/current")
    fresh = jvm.Path(f"{path}/current-{version}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    put_text(spark, fresh.toString(), version)
    replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, where, replace)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a folder that ``write_snapshot`` made."""
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def markdown(df: DataFrame) -> str:
    """A report's table; for results of a report's size."""
    rows = df.collect()
    cell = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def sampled_positions(n: Column, k: int) -> Column:
    """k evenly spaced positions from 0 to n-1, rounded half to even; all if there are fewer."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1))).cast("int"))
    return F.array_distinct(F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(at))
