"""Helpers shared by the operators: table reading, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session on one machine (as in local tests) takes a temporary folder of it; on a
    cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir()
    if base is not None and not isinstance(base, str):
        base = base.get() if base.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanlake-{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows written once to the shared folder and read again.

    This cuts the lineage: what follows neither recomputes the rows nor loses
    them with an executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def size_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, for choosing a number of partitions."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def over_batches(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema, max_chars: int = 4_000_000, text: str = "text") -> Callable:
    """A mapInArrow function that calls ``fn`` on slices holding about ``max_chars`` bytes of text each.

    ``fn`` returns a column for each field of ``schema``.  A slice has one row at
    least, so one very long text is a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_chars, text):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


def slices(batch: pa.RecordBatch, max_chars: int, text: str) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    n = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = n[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(n, before + max_chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null counts as empty."""
    return [t or "" for t in batch[name].to_pylist()]


def put(uri: str, data: bytes) -> None:
    """Writes a file in any file system Arrow knows; it appears under its name only when whole.

    A task that runs twice writes the same bytes under the same name.
    """
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex[:8]}") as f:
        f.write(data)
    fs.move(part, path)


def get(uri: str, ranges: list[tuple[int, int]] | None = None) -> list[bytes]:
    """The (offset, length) ranges of a file, or its whole content."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        if ranges is None:
            return [f.read()]
        out = []
        for at, n in ranges:
            f.seek(at)
            out.append(f.read(n))
        return out
