"""Token-ID output: one wavelet matrix file per shard.

A shard is a contiguous run of documents in ascending key order.  Its ids are
stored as bit-planes, most significant first; below each plane the symbols are
partitioned stably by that bit.  A plane is cut in blocks of 2**16 bits, each
compressed on its own, with the number of ones before it in the directory, so
that ``access``, ``rank``, ``count`` and ``occurrences`` read only the blocks they
need.

File: 8 bytes magic, 8 bytes length of the head, JSON head, then the sections the
head lists (document keys, document lengths, block tables, blocks).

Null and empty texts hold just the end id.  Rows with equal keys stand next to
each other, ordered by their text.  Null keys come first.  An empty table gives
no files and no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import get, put, shared_dir, size_bytes, slices, written

MAGIC = b"WVLTMTX1"
BLOCK = 1 << 16  # bits


PART = 1 << 15  # symbols moved at a time, so that index arrays stay in the processor's cache


def parted(x: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols without the bit, then those with it, both in order; and the number of the former."""
    out = np.empty_like(x)
    zeros = len(x) - int(np.count_nonzero(one))
    low, high = 0, zeros
    for at in range(0, len(x), PART):
        some, bit = x[at : at + PART], one[at : at + PART]
        a, b = np.flatnonzero(~bit), np.flatnonzero(bit)
        out[low : low + len(a)] = some[a]
        out[high : high + len(b)] = some[b]
        low += len(a)
        high += len(b)
    return out, zeros


def joined(x: np.ndarray, one: np.ndarray, zeros: int, bit: int) -> np.ndarray:
    """The inverse of ``parted``, with the bit set where ``one`` holds."""
    out = np.empty_like(x)
    low, high = 0, zeros
    for at in range(0, len(x), PART):
        some, mark = out[at : at + PART], one[at : at + PART]
        a, b = np.flatnonzero(~mark), np.flatnonzero(mark)
        some[a] = x[low : low + len(a)]
        some[b] = x[high : high + len(b)] | x.dtype.type(bit)
        low += len(a)
        high += len(b)
    return out


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The planes, as packed bytes, and the number of zeros in each."""
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)) != 0
        planes.append(np.packbits(one, bitorder="little"))
        x, n = parted(x, one)
        zeros.append(n)
    return planes, zeros


def pack(keys: list[int | None], sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    """The file of one shard."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = build(ids, bits)
    blocks, ends, ones = [], [], []
    for plane in planes:
        before = 0
        for at in range(0, len(plane), BLOCK // 8):
            part = plane[at : at + BLOCK // 8]
            raw = part.tobytes()
            small = squeeze(raw)
            blocks.append(small if len(small) < 0.9 * len(raw) else b"\0" + raw)
            ones.append(before)
            before += int(np.bitwise_count(part).sum())
    ends = np.cumsum([len(b) for b in blocks], dtype=np.int64)
    sections = {
        "keys": squeeze(json.dumps(keys).encode()),
        "sizes": squeeze(np.array(sizes, "<u4").tobytes()),
        "ends": squeeze(ends.astype("<i8").tobytes()),
        "ones": squeeze(np.array(ones, "<i8").tobytes()),
    }
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "sections": {k: len(v) for k, v in sections.items()}}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *sections.values(), *blocks])


class WaveletMatrix:
    """Reads a shard's file; blocks are decompressed when first needed.

    Given the file's bytes, or a function (offset, length) -> bytes: ``stored`` makes one
    that reads ranges of a stored file, so that only the head and the blocks an
    answer needs are read.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.fetch = data if callable(data) else lambda at, n: data[at : at + n]
        start = self.fetch(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = 16 + int.from_bytes(start[8:], "little")
        head = json.loads(self.fetch(16, at - 16))
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        part, raw, low = {}, self.fetch(at, sum(head["sections"].values())), 0
        for k, size in head["sections"].items():
            part[k] = zstandard.ZstdDecompressor().decompress(raw[low : low + size])
            low += size
        at += low
        self.keys = json.loads(part["keys"])
        self.sizes = np.frombuffer(part["sizes"], "<u4")
        self.ends = np.frombuffer(part["ends"], "<i8")
        self.ones = np.frombuffer(part["ones"], "<i8")
        self.at, self.per_plane = at, -(-self.n // BLOCK)
        self.loaded: dict[int, np.ndarray] = {}

    @classmethod
    def stored(cls, uri: str) -> WaveletMatrix:
        return cls(lambda at, n: get(uri, [(at, n)])[0])

    def block(self, k: int) -> np.ndarray:
        low = int(self.ends[k - 1]) if k else 0
        raw = self.fetch(self.at + low, int(self.ends[k]) - low)
        return np.frombuffer(raw[1:] if raw[:1] == b"\0" else zstandard.ZstdDecompressor().decompress(raw), np.uint8)

    def cached(self, k: int) -> np.ndarray:
        if k not in self.loaded:
            self.loaded[k] = self.block(k)
        return self.loaded[k]

    def bit(self, level: int, i: int) -> int:
        b = self.cached(level * self.per_plane + i // BLOCK)
        return int(b[i % BLOCK // 8] >> i % 8 & 1)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k = level * self.per_plane + i // BLOCK
        b, r = self.cached(k), i % BLOCK
        return int(self.ones[k]) + int(np.bitwise_count(b[: r // 8]).sum()) + (int(b[r // 8]) & (1 << r % 8) - 1).bit_count()

    def select(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit equal to ``one`` in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            one = self.bit(level, i)
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if one else i - ones
            out = out << 1 | one
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        """Where the token's copies among positions i..j stand below the last plane."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self.rank1(level, i), self.rank1(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if token >> self.bits - 1 - level & 1 else (i - a, j - b)
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Copies of a token among the first i."""
        low, high = self._range(token, 0, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> list[int]:
        """Ascending positions of a token."""
        low, high = self._range(token, 0, self.n)
        out = []
        for i in range(low, high):
            for level in range(self.bits - 1, -1, -1):
                one = token >> self.bits - 1 - level & 1
                i = self.select(level, one, i - self.zeros[level] if one else i)
            out.append(i)
        return out

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            k = level * self.per_plane
            packed = [self.block(k + p) for p in range(self.per_plane)]
            one = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)
            x = joined(x, one, self.zeros[level], 1 << self.bits - 1 - level)
        return x


SIGNS = ".,!?;:#$%&*"


def latin(word: str) -> bool:
    """Letters that normalisation leaves alone but for their case."""
    return word.isalpha() and (word.isascii() or max(word) <= "ÿ")


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, each distinct piece once while it is held.

    For a tokenizer that lower-cases, drops white space and splits letters from
    signs, a text's ids are those of its chunks between blanks, and those of a
    chunk of Latin letters and trailing signs are the two parts'.  Latin letters
    go to the same model by a shorter way, without normalisation and splitting;
    every other chunk, and a whole text with a special token's opening, goes to
    the library as it is.  The tests compare all ways with the library.
    """

    def __init__(self, tokenizer_json: str, cache_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(tokenizer_json)
        self.opening = spec["added_tokens"][0]["content"][:2]
        self.vocabulary = 1 + max(self.library.get_vocab().values())
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None}
        spec["pre_tokenizer"]["pretokenizers"][0].update(pattern={"String": "\n"}, invert=False)  # one piece a line
        self.lines = Tokenizer.from_str(json.dumps(spec))
        self.cache_words = cache_words
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces: their texts, the number of ids of each and where these begin among all."""
        self.known = pa.array([], pa.string())
        self.size, self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def letters(self, pieces: list[str]) -> list[bytes]:
        """The ids of lower-case Latin pieces, thousands in one call."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 4096):
            got = self.lines.encode("\n".join(pieces[at : at + 4096]), add_special_tokens=False)
            raw = np.array(got.ids, "<u4").tobytes()
            cut = np.searchsorted(np.array(got.word_ids), np.arange(len(pieces[at : at + 4096]) + 1)) * 4
            cut = cut.tolist()
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def pieces(self, distinct: pa.Array) -> np.ndarray:
        """The number of each piece among those known; new ones are encoded first."""
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(at))
        if len(new):
            names = new.to_pylist()
            plain = [k for k, w in enumerate(names) if latin(w)]
            ids = self.letters([names[k].lower() for k in plain])
            order = np.empty(len(names), np.int64)
            order[plain] = np.arange(len(plain))
            apart = np.ones(len(names), bool)
            apart[plain] = False
            other = np.flatnonzero(apart)
            order[other] = len(plain) + np.arange(len(other))
            ids += self.whole([names[k] for k in other.tolist()])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            self.size, self.begin = np.concatenate([self.size, size[order]]), np.concatenate([self.begin, begin[order]])
            fresh = len(self.known) + np.cumsum(pc.is_null(at).to_numpy(zero_copy_only=False)) - 1
            self.known = pa.concat_arrays([self.known, new])
            return np.where(pc.is_null(at).to_numpy(zero_copy_only=False), fresh, pc.fill_null(at, 0).to_numpy())
        return at.to_numpy().astype(np.int64)

    def words(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after another, and where each begins (and the last ends).

        A chunk of Latin letters and trailing signs is its two parts; any other is one part.
        """
        core = pc.utf8_rtrim(fresh, characters=SIGNS)
        apart = pc.match_substring_regex(core, "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$")
        core = pc.if_else(apart, core, fresh)
        # the rest of each chunk, cut from the bytes of all
        size, whole = (pc.binary_length(x).to_numpy() for x in (core, fresh))
        data = np.frombuffer(fresh.buffers()[2] or b"", np.uint8)
        left = whole - size
        end = np.cumsum(whole.astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
        at = np.arange(int(offsets[-1])) + np.repeat(end - left - offsets[:-1], left)
        tail = pa.StringArray.from_buffers(len(fresh), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes()))
        index = np.empty((len(fresh), 2), np.int64)
        for side, column in enumerate((core, tail)):
            coded = column.dictionary_encode()
            index[:, side] = self.pieces(coded.dictionary)[coded.indices.to_numpy()]
        index = index.ravel()
        n = self.size[index]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.arange(total[-1]) + np.repeat(self.begin[index] - total[:-1], n)], total[::2]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one after another, each followed by ``end_id``, and their numbers."""
        if len(self.known) > self.cache_words:
            self.clear()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, self.opening)
        low = pc.ascii_lower(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " "))
        chunks = pc.split_pattern(low, " ")
        coded = chunks.flatten().dictionary_encode()
        at = chunks.offsets.to_numpy()
        at = at - at[0]
        flat, begin = self.words(coded.dictionary)
        size, begin = np.diff(begin), begin[:-1]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        # one more word for each text: the end, after the library's ids where the text went there whole
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        tails = [end, *(x + end for x in self.whole([texts[int(k)].as_py() for k in whole]))]
        last = np.full(len(texts), len(size), np.int64)
        last[whole] = len(size) + 1 + np.arange(len(whole))
        more = np.array([len(x) // 4 for x in tails], np.int64)
        begin = np.concatenate([begin, len(flat) + np.cumsum(more) - more])
        size = np.concatenate([size, more])
        flat = np.concatenate([flat, np.frombuffer(b"".join(tails), "<u4")])
        index = np.insert(coded.indices.to_numpy().astype(np.int64), at[1:], last)
        n = size[index]
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(total[-1]) + np.repeat(begin[index] - total[:-1], n)
        per_text = total[at[1:] + np.arange(1, len(texts) + 1)] - total[at[:-1] + np.arange(len(texts))]
        return flat[place], per_text


def write_shards(df: DataFrame, tokenizer_json: str, end_id: int, uri: str, text: str = "text", key: str = "doc_id", part_bytes: int = 64 << 20, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encodes every text and writes shard files below ``uri``, in ascending order of the integer key.

    Returns a manifest: path, part, seq, n_docs, n_tokens.  Running it writes the
    files, so materialise it once.  A task holds the ids of one shard at most, or
    of one document if that is longer.
    """
    parts = max(8, -(-size_bytes(df, text) // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = ChunkEncoder(tokenizer_json)
        bits = max(encoder.vocabulary - 1, end_id).bit_length()
        keys, sizes, found, held = [], [], [], 0

        def flush():
            put(path := f"{uri}/{part:06d}-{TaskContext.get().taskAttemptId()}-{seq:05d}.wm", pack(keys, sizes, np.concatenate(found), bits))
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_docs": [len(keys)], "n_tokens": [held]}, schema=schema)

        for batch in batches:
            for some in slices(batch, 8_000_000, "__spanlake_text"):
                ids, size = encoder.encode(some["__spanlake_text"], end_id)
                end = np.cumsum(size)
                names, low = some["_key"].to_pylist(), 0
                while low < len(names):  # as many documents as fill the shard
                    start = int(end[low - 1]) if low else 0
                    high = min(len(names), 1 + int(np.searchsorted(end, start + shard_tokens - held)))
                    keys += names[low:high]
                    sizes += size[low:high].tolist()
                    found.append(ids[start : int(end[high - 1])])
                    held += len(found[-1])
                    low = high
                    if held >= shard_tokens:
                        yield flush()
                        keys, sizes, found, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield flush()

    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("__spanlake_text"))
    dealt = rows.repartitionByRange(parts, "_key").sortWithinPartitions("_key", "__spanlake_text")
    return dealt.mapInArrow(run, "path string, part int, seq int, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document from the files: key, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it over all shards; the
    offsets of shards come from the manifest, a row for each file.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                shard = WaveletMatrix(get(path)[0])
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                size = shard.sizes.astype(np.int64)
                end = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({key: shard.keys, "start": base + end - size, "n_tokens": size, "ids_crc32": crc}, schema=schema)

    parts = max(8, manifest.count())
    return placed.repartition(parts, "path").mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, df: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Writes all shards of ``df`` to the shared folder and reads every document back from them."""
    manifest = written(write_shards(df, tokenizer_json, end_id, shared_dir(spark, "tokens")), "manifest")
    return read_shards(manifest)
