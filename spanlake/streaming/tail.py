"""A growing file of lines as a streaming source: its offset is a byte, an incomplete last line waits for its end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def read_range(uri: str, start: int, end: int | None = None) -> bytes:
    """Bytes of a file from ``start`` to ``end``, or as far as it goes."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    size = fs.get_file_info(path).size or 0
    with fs.open_input_file(path) as f:
        f.seek(min(start, size))
        return f.read((size if end is None else min(end, size)) - min(start, size))


class TailReader(SimpleDataSourceStreamReader):
    """Each batch takes at most ``most`` bytes, so a long file is read in steps."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        data, size = b"", self.most
        while True:  # a line longer than a step is read whole
            data = read_range(self.path, start["at"], start["at"] + size)
            whole = data.rfind(b"\n") + 1
            if whole or len(data) < size:
                break
            size *= 2
        return iter([(x.decode("utf-8", "replace"),) for x in data[:whole].split(b"\n")[:-1]]), {"at": start["at"] + whole}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        data = read_range(self.path, start["at"], end["at"])
        return iter([(x.decode("utf-8", "replace"),) for x in data.split(b"\n")[:-1]])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "line string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("maxBytes", str(8 << 20))))


def follow(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Appends the lines that are new since the last call to the folder ``out``."""
    spark.dataSource.register(TailSource)
    query = spark.readStream.format("line_tail").option("path", path).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
