"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition are laid end to end as one array of
symbols.  Every adjacent pair that has a merge rank is entered in an index from
rank to all positions where it stands.  Ranks are taken in ascending order from
a heap; one step merges all positions of a rank at once and enters the pairs
that arise at the neighbours.  A pair that arises from a merge always has a later
rank, so each rank is taken once and the result equals merging word by word.

Results for odd input: null and empty texts have no ids; the special token's own
string in a text becomes its id, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import over_batches, texts_of

#: Fixed value: the word pattern of this family of byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]


class Special(str):
    """A special token's string, kept apart from a word of the same letters."""


class ByteBPE:
    """Encoder and decoder for the JSON text of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_json: str, cache_words: int = 400_000):
        import regex

        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left.astype(np.int64) << 32 | self.right
        self.rank_of_key = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of_key]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(WORD_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        to_byte = {s: b for b, s in enumerate(symbols)}
        piece = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), b"")
        piece |= {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if all(c in to_byte for c in s)}
        piece |= {i: s.encode() for s, i in self.special.items()}
        self.piece_len = np.array([len(piece[i]) for i in range(len(piece))], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(piece[i] for i in range(len(piece))), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.rank_of_key[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        n, end = int(size.sum()), np.cumsum(size)
        symbol = np.empty(n + 1, np.int32)
        symbol[:n] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        symbol[n] = -1  # stands before and after every word
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[end - 1] = n
        before[end - size] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            if (some := rank >= 0).any():
                at, rank = at[some], rank[some]
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                lows, edges = rank[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist(), len(at)]
                for k, r in enumerate(lows):
                    if r in index:
                        index[r].append(at[edges[k] : edges[k + 1]])
                    else:
                        index[r] = [at[edges[k] : edges[k + 1]]]
                        heapq.heappush(heap, r)

        enter(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # of a run of the same symbol, pairs are taken from its left
                starts = np.concatenate([[True], at[1:] != after[at[:-1]]])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            following = after[gone]
            symbol[at], symbol[gone] = self.made[r], -2
            after[at] = following
            before[following] = at
            left = before[at]
            enter(np.unique(np.concatenate([at, left[symbol[left] >= 0]])))
        alive = symbol[:n] >= 0
        ids = symbol[:n][alive].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(alive, dtype=np.int64)])[np.concatenate([[0], end])] * 4
        cut = cut.tolist()
        return [ids[cut[k] : cut[k + 1]] for k in range(len(raw))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split, new, cache = [], set(), self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                parts = self.cut(text)  # at odd places the special tokens' strings
                words = [w for k, part in enumerate(parts) for w in ([Special(part)] if k % 2 else self.words(part))]
                new.update(w for w in words if type(w) is str)
            else:
                words = self.words(text)
                new.update(words)
            split.append(words)
        if fresh := sorted(new.difference(cache)):
            cache.update(zip(fresh, self.encode_words(fresh), strict=True))
        get = cache.__getitem__
        odd = lambda w: get(w) if type(w) is str else self.special[w].to_bytes(4, "little")
        marked = [any(type(w) is Special for w in words) if self.cut and any(s in t for s in self.special) else False for words, t in zip(split, texts, strict=True)]
        return [b"".join(map(odd if m else get, words)) for words, m in zip(split, marked, strict=True)]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian, 32 bits) stand for."""
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        size = self.piece_len[i]
        begin = np.cumsum(size) - size
        return self.piece_bytes[np.arange(int(size.sum())) + np.repeat(self.piece_at[i] - begin, size)].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def read_tokenizer(path: str) -> str:
    """The file's text; the driver reads it and sends it along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` array<int> of every row; other columns are dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    out = StructType([df.schema[c] for c in keep]).add("ids", ArrayType(IntegerType()))
    schema = to_arrow_schema(out)

    def run(batches):
        bpe = ByteBPE(tokenizer_json)

        def fn(part):
            texts = texts_of(part, "__spanlake_text")
            place: dict[str, int] = {}  # copies in a slice are encoded once
            at = [place.setdefault(t, len(place)) for t in texts]
            each = bpe.encode(list(place))
            ids = [each[k] for k in at]
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            return {c: part[c] for c in keep} | {"ids": pa.ListArray.from_arrays(at, flat)}

        yield from over_batches(fn, schema, text="__spanlake_text")(batches)

    return df.select(*[F.col(c) for c in keep], F.col(text).alias("__spanlake_text")).mapInArrow(run, out)


def decode(df: DataFrame, tokenizer_json: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and the ``text`` that ``ids`` array<int> stand for (null: empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    out = StructType([df.schema[c] for c in keep]).add("text", StringType())
    schema = to_arrow_schema(out)

    def run(batches):
        bpe = ByteBPE(tokenizer_json)
        for b in batches:
            text = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(text, pa.string())], schema=schema)

    return df.select(*[F.col(c) for c in keep], F.col(ids).alias("_ids")).mapInArrow(run, out)


def round_trip(df: DataFrame, tokenizer_json: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every text, decodes its ids again, and gives size and digests of both.

    Columns: the key, n_tokens, ids_sha256, decoded_sha256.  Works batch by batch
    in one pass without a shuffle; repeated rows give repeated results.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    out = StructType([df.schema[key]]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    schema = to_arrow_schema(out)
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = ByteBPE(tokenizer_json)

        def fn(part):
            ids = bpe.encode(texts_of(part, "__spanlake_text"))
            return {
                key: part[key],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [digest(x) for x in ids],
                "decoded_sha256": [digest(bpe.decode(x).encode()) for x in ids],
            }

        yield from over_batches(fn, schema, text="__spanlake_text")(batches)

    return df.select(key, F.col(text).alias("__spanlake_text")).mapInArrow(run, out)
