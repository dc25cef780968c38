"""WARC archives of pages with a two-level capture index.

Archives: one gzip member for each record, so a record can be read alone by its
byte range.  Of records with equal payloads of at least ``min_bytes`` bytes the
one with the smallest page id is a ``response`` and the others are ``revisit``
records that name it and carry no payload; smaller payloads are all stored.

Index: captures sorted by reversed-host URL key and page id.  An index file holds
compressed blocks of captures, then a sparse directory with each block's first
key.  A lookup finds the file by its first key, the block by binary search in the
directory and the capture by binary search in the block, and then reads the
record's range of the archive.

Results for odd input: a null html is an empty payload; a null URL has the empty
key; a row without a page id is a ``response``, whatever its payload; rows with an equal page id and payload are all of the same type and each has
its record; rows with an equal page id and different payloads are kept apart by
their digest; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import get, put, shared_dir, size_bytes, written

DATE = "1970-01-01T00:00:00Z"  # tables of pages have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, digest string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host's parts reversed, without scheme, user, port and fragment: ``net,example,www)/path?query``."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)", url or "")
    if not m:
        return re.sub(r"\s", "", (url or "").split("#")[0])
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (re.sub(r"\s", "", m[2]) or "/")


def digest_name(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; ``payload`` is left out where it refers to another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record and its payload (None for a revisit); raises if a stored payload doesn't match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    if len(block) != int(field["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    page = lambda name: int(x) if (x := field.get(name, "")[10:-1]) else None
    out = {"page_id": page("warc-record-id"), "url": field["warc-target-uri"], "record_type": field["warc-type"], "refers_to": page("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": None}
    if out["record_type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of page {out['page_id']} is damaged")
        out["payload"] = payload
    return out


def decided(pages: DataFrame, parts: int, min_bytes: int = 0) -> DataFrame:
    """page_id, url, _html, _sha and _first: the page whose payload is stored for this one, if another.

    The first of equal payloads comes from an aggregate that combines before the
    shuffle; only ids and digests of later copies are joined back, so large
    groups of copies never meet with their payloads in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html")).withColumn("_sha", F.sha1(F.col("_html").cast("binary")))
    large = rows.where(F.octet_length("_html") >= min_bytes).select("page_id", "_sha")
    first = large.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = large.join(first, "_sha").where("page_id > _first").select("page_id", "_sha", "_first").distinct()
    return rows.repartition(parts, "page_id", "_sha").join(later, ["page_id", "_sha"], "left")


def write_archives(pages: DataFrame, uri: str, min_bytes: int = 0, part_bytes: int = 16 << 20, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row below ``uri`` and returns the captures; running it writes the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # rows may come in another order to a task that runs again, so each attempt has files of its own
        task, seq = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0
        members, captures, held = [], [], 0

        def flush() -> pa.RecordBatch:
            put(f"{uri}/{task}-{seq:04d}.warc.gz", b"".join(members))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*captures, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "digest", "archive", "offset", "length"])

        for b in batches:
            for page_id, url, html, sha, first in zip(*(b[c].to_pylist() for c in ("page_id", "url", "_html", "_sha", "_first")), strict=True):
                payload, digest = html.encode(), digest_name(sha)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url, payload, len(payload), digest, first)) + pack.flush()
                captures.append((url_key(url), page_id, digest, f"{task}-{seq:04d}.warc.gz", held, len(member)))
                members.append(member)
                held += len(member)
                if held >= archive_bytes:
                    yield flush()
                    members, captures, held, seq = [], [], 0, seq + 1
        if members:
            yield flush()

    parts = max(8, -(-size_bytes(pages, "html") // part_bytes))
    return decided(pages, parts, min_bytes).mapInArrow(run, CAPTURE)


class IndexFile:
    """Reads one index file: its directory first, blocks when needed."""

    def __init__(self, data: bytes):
        at, n = int.from_bytes(data[-16:-8], "little"), int.from_bytes(data[-8:], "little")
        self.data, self.directory = data, json.loads(zlib.decompress(data[at : at + n]))
        self.first = [(k, p) for k, p, _, _ in self.directory]
        self.open: tuple[int, list] = (-1, [])

    @staticmethod
    def pack(captures: list[tuple], per_block: int = 256) -> bytes:
        """captures: (key, page id, digest, archive, offset, length) in ascending order of the first two."""
        out, directory, at = [], [], 0
        for low in range(0, len(captures), per_block):
            block = zlib.compress(json.dumps(captures[low : low + per_block]).encode(), 1)
            directory.append((captures[low][0], captures[low][1], at, len(block)))
            out.append(block)
            at += len(block)
        tail = zlib.compress(json.dumps(directory).encode(), 1)
        return b"".join([*out, tail, at.to_bytes(8, "little"), len(tail).to_bytes(8, "little")])

    def block(self, k: int) -> list:
        if self.open[0] != k:
            _, _, at, n = self.directory[k]
            self.open = k, json.loads(zlib.decompress(self.data[at : at + n]))
        return self.open[1]

    def find(self, key: str, page_id: int) -> list[tuple[str, int, int, str]]:
        """(archive, offset, length, digest) of every capture of the page under the key."""
        k = max(0, bisect_right(self.first, (key, page_id)) - 1)
        while k and self.first[k] == (key, page_id):
            k -= 1  # captures of the page may begin in the block before
        out = []
        while k < len(self.directory) and self.first[k] <= (key, page_id):
            captures = self.block(k)
            at = bisect_right(captures, (key, page_id - 1), key=lambda c: (c[0], c[1]))
            while at < len(captures) and (captures[at][0], captures[at][1]) == (key, page_id):
                out.append((captures[at][3], captures[at][4], captures[at][5], captures[at][2]))
                at += 1
            k += 1
        return out


NO_ID = -(1 << 63)  # stands for a null page id in index keys


def write_index(captures: DataFrame, uri: str, per_file: int = 50_000) -> DataFrame:
    """Writes index files below ``uri``; returns (path, key, page_id) with each file's first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        seq = 0

        def flush() -> pa.RecordBatch:
            put(path := f"{uri}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{seq:04d}.idx", IndexFile.pack(held))
            return pa.RecordBatch.from_pydict({"path": [path], "key": [held[0][0]], "page_id": [held[0][1]]})

        for b in batches:
            held += zip(*(b[c].to_pylist() for c in ("key", "page_id", "digest", "archive", "offset", "length")), strict=True)
            while len(held) >= 2 * per_file:
                rest, held = held[per_file:], held[:per_file]
                yield flush()
                held, seq = rest, seq + 1
        if held:
            yield flush()

    parts = max(8, -(-captures.count() // per_file))
    rows = captures.withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID)))
    return rows.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset").mapInArrow(run, "path string, key string, page_id long")


def look_up(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length) from the index for every distinct (page_id, url) of ``wanted``.

    The driver holds one key for each index file, that is, one for tens of
    thousands of captures.
    """
    files = sorted(((r["key"].encode(), r["page_id"], r["path"]) for r in index.collect()))
    first, paths = [(k.decode(), p) for k, p, _ in files], [p for _, _, p in files]
    empty = "page_id long, archive string, offset long, length long"
    if not files:
        return wanted.sparkSession.createDataFrame([], empty)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, raw = [(k.encode(), p) for k, p in first], str.encode
        for b in batches:
            keys = [url_key(u) for u in b["url"].to_pylist()]
            ids = [NO_ID if p is None else p for p in b["page_id"].to_pylist()]
            out: dict[str, list] = {"file": [], "key": [], "page_id": []}
            for k, p in zip(keys, ids, strict=True):
                at = max(0, bisect_right(low, (raw(k), p)) - 1)
                while True:  # captures of one page may begin in the file before
                    out["file"].append(at)
                    out["key"].append(k)
                    out["page_id"].append(p)
                    if not at or low[at] != (raw(k), p):
                        break
                    at -= 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.int32()), ("key", pa.string()), ("page_id", pa.int64())]))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index_file = -1, None
        for b in batches:
            out: dict[str, list] = {"page_id": [], "archive": [], "offset": [], "length": []}
            for file, key, page_id in zip(*(b[c].to_pylist() for c in ("file", "key", "page_id")), strict=True):
                if file != at:
                    at, index_file = file, IndexFile(get(paths[file])[0])
                for archive, offset, length, _ in index_file.find(key, page_id):
                    for c, x in zip(out, (None if page_id == NO_ID else page_id, archive, offset, length), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    routed = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(route, "file int, key string, page_id long").distinct()
    return routed.repartition(max(8, len(paths)), "file").sortWithinPartitions("file", "key", "page_id").mapInArrow(seek, empty)


def read_records(found: DataFrame, uri: str, n_archives: int, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Reads the ranges found, neighbouring ones together, and parses their records."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs: list[list] = []  # archive, from, to, members
            for archive, offset, length in zip(*(b[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if runs and runs[-1][0] == archive and 0 <= offset - runs[-1][2] <= gap and offset + length - runs[-1][1] <= most:
                    runs[-1][2] = offset + length
                    runs[-1][3].append((offset, length))
                else:
                    runs.append([archive, offset, offset + length, [(offset, length)]])
            out: dict[str, list] = {f.name: [] for f in schema}
            for archive, low, high, members in runs:
                data = get(f"{uri}/{archive}", [(low, high - low)])[0]
                for offset, length in members:
                    got = parse(zlib.decompress(data[offset - low : offset - low + length], 31))
                    for c in out:
                        out[c].append(got[c])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    dealt = found.distinct().repartition(max(8, n_archives), "archive").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def write_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index to the shared folder, then reads every page back through the index."""
    uri = shared_dir(spark, "warc")
    captures = written(write_archives(pages, uri, min_bytes), "captures")
    index = written(write_index(captures, f"{uri}/index"), "index")
    found = look_up(pages, index)
    n = captures.select("archive").distinct().count()
    return read_records(found, uri, n)
