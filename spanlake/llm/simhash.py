"""SimHash near-duplicates with a self-join of binary tries.

Fingerprints of equal value collapse first, so a group of copies is one entry of
the trie.  To spread the join, the 64 bits are cut in blocks: two fingerprints
with at most ``budget`` differing bits agree in at least ``blocks - budget`` of
them, so for every choice of that many blocks the fingerprints are dealt by those
blocks' bits, which stand on top of the trie and allow no difference.  Each task
walks its tries level by level: a frontier of node pairs (ranges of the sorted
fingerprints), where a pair that takes different branches gains a differing bit
and is dropped beyond the budget.  A root with more than ``per_task`` fingerprints (a large group of near copies) is
cut in slices, and every pair of slices is a trie of its own.  A task returns a
spanning forest of the links it found, not all pairs; the forests of all tasks are
joined into components.

Results for odd input: a text without words has fingerprint zero and is linked
like any other; a null text is an empty one; repeated rows and equal texts share
a component; an empty table gives no rows and one of a single text no links; a
null key never becomes a component's id while another key is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import slices, texts_of, written
from spanlake.llm.components import Forest, components

SEED = 42
BITS = 64


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])[: len(words) - width + 1]
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end[width - 1 :].tolist(), strict=True)), np.uint64, len(begin))
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 4) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    out = StructType([df.schema[c] for c in keep]).add("fp", LongType())
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000, "__spanlake_text"):
                fp = np.array([fingerprint(t, width) for t in texts_of(part, "__spanlake_text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part[c].cast(schema.field(c).type) for c in keep), pa.array(fp)], schema=schema)

    return df.select(*keep, F.col(text).alias("__spanlake_text")).mapInArrow(run, out)


def trie_links(fp: np.ndarray, fixed: np.ndarray, budget: int, order: list[int], leaf: int = 8, frontier: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fp`` (unsigned, distinct within a root) at ``budget`` or fewer differing bits.

    ``fixed`` is the root each entry belongs to; entries of different roots never
    meet.  ``order`` lists the bits below the roots, top level first; entries are
    sorted by root and then by those bits.
    """
    level_bits = [(fp >> np.uint64(b) & np.uint64(1)).astype(np.int64) for b in order]
    ones = [np.concatenate([[0], np.cumsum(b)]) for b in level_bits]
    cuts = np.flatnonzero(np.concatenate([[True], fixed[1:] != fixed[:-1], [True]])) if len(fp) else np.zeros(1, np.int64)
    low, high = cuts[:-1], cuts[1:]
    some = high - low > 1
    low, high = low[some], high[some]
    stack = [(0, low, high, low, high, np.zeros(len(low), np.int8))]
    while stack:
        level, al, ah, bl, bh, gap = stack.pop()
        if len(al) > frontier:
            half = len(al) // 2
            stack += [(level, *(x[half:] for x in (al, ah, bl, bh, gap))), (level, *(x[:half] for x in (al, ah, bl, bh, gap)))]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) if level < len(order) else np.ones(len(al), bool)
        if small.any():  # leaves: compare entry by entry
            a0, n, b0, m = al[small], (ah - al)[small], bl[small], (bh - bl)[small]
            size = n * m
            cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(m, size)
            i, j = np.repeat(a0, size) + cell // wide, np.repeat(b0, size) + cell % wide
            near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            if small.all():
                continue
            al, ah, bl, bh, gap = (x[~small] for x in (al, ah, bl, bh, gap))
        c = ones[level]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        spare = gap < budget
        parts = [
            (al, am, bl, bm, gap, np.ones(len(al), bool)),
            (am, ah, bm, bh, gap, np.ones(len(al), bool)),
            (al, am, bm, bh, gap + 1, spare),
            (am, ah, bl, bm, gap + 1, spare & ~same),
        ]
        kept = []
        for a, b, c0, d, g, ok in parts:
            ok = ok & (b > a) & (d > c0) & ~((a == c0) & (b - a < 2))
            kept.append([x[ok] for x in (a, b, c0, d, g)])
        joined = [np.concatenate([k[x] for k in kept]) for x in range(5)]
        if len(joined[0]):
            stack.append((level + 1, *joined))


def block_plan(n: int, budget: int, per_root: int = 2048) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Blocks of bits, and the choices of blocks that must agree, for n distinct fingerprints.

    More blocks let more bits agree, for more choices; the fewest are taken that
    leave about ``per_root`` fingerprints or less under a root.
    """
    for blocks in range(budget + 1, budget + 5):
        agree = blocks - budget
        if n / 2 ** (BITS * agree / blocks) <= per_root:
            break
    bits = [list(map(int, part)) for part in np.array_split(np.arange(BITS), blocks)]
    return bits, list(combinations(range(blocks), agree))


def near_links(distinct: DataFrame, budget: int = 4, fp: str = "fp", per_task: int = 8192) -> DataFrame:
    """Links (u, v) between distinct fingerprints that hold all of them together: a spanning forest for each task."""
    n = distinct.count()
    bits, choices = block_plan(n, budget)
    masks = [sum(1 << b for part in choice for b in bits[part]) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    roots = F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        group, all_fp = rows["choice"].to_numpy().astype(np.int64) << 32 | rows["trie"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        for g in np.unique(group).tolist():
            c = g >> 32
            x = all_fp[group == g]
            top = [b for part in choices[c] for b in bits[part]]
            below = [b for b in range(BITS) if not masks[c] >> b & 1]
            turned = np.zeros(len(x), np.uint64)
            for b in (*top, *below):
                turned = turned << np.uint64(1) | x >> np.uint64(b) & np.uint64(1)
            at = np.argsort(turned)
            x, root = x[at], turned[at] >> np.uint64(len(below))
            forest = Forest(len(x))
            for i, j in trie_links(x, root, budget, below):
                forest.link(i, j)
            u, v = forest.edges()
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x[u].view(np.int64)), pa.array(x[v].view(np.int64))], ["u", "v"])

    dealt = distinct.select(F.col(fp).alias("fp"), roots)
    # few rows: one for each root that holds more than per_task fingerprints
    hot = dealt.groupBy("choice", "root").agg(F.count("*").alias("size")).where(F.col("size") > per_task).select("choice", "root", F.ceil(F.col("size") / per_task).cast("int").alias("slices"))
    dealt = dealt.join(hot, ["choice", "root"], "left").withColumn("slice", F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("other")
    dealt = dealt.select("choice", "root", "fp", "slice", other).withColumn("trie", F.greatest("slice", "other") * 32768 + F.least("slice", "other"))
    parts = max(8, n * len(choices) // 200_000)
    return dealt.repartition(parts, "choice", "root", "trie").select("choice", F.col("trie").cast("long").alias("trie"), "fp").mapInArrow(run, "u long, v long")


def classes(rows: DataFrame, budget: int, name) -> DataFrame:
    """(fp, root, least): the component of each distinct ``fp`` and the smallest ``name`` (a column) in it."""
    distinct = rows.groupBy("fp").agg(F.min(name).alias("low"))
    member = components(near_links(distinct.select("fp"), budget))
    named = distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    return named.select("fp", "root").join(named.groupBy("root").agg(F.min("low").alias("least")), "root")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", budget: int = 4, width: int = 4) -> DataFrame:
    """Key, ``fp`` and ``component_id``, the smallest key that links of ``budget`` or fewer bits reach, for every row."""
    rows = written(fingerprints(df, text, (key,), width), "fingerprints")
    return rows.join(classes(rows, budget, F.col(key)).select("fp", F.col("least").alias("component_id")), "fp").select(key, "fp", "component_id")


def representatives(df: DataFrame, text: str = "text", key: str = "doc_id", budget: int = 4, width: int = 4) -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest key, rows without a key last.

    A row is told by its key and text together (a digest of both), so rows that
    repeat a key with other texts are documents of their own, and rows without a
    key are compared like all others.  Of equal keys the smallest digest stays, of
    rows with equal key and text one.  Texts are shuffled once: the join and the
    choice among repeated rows share its partitioning.
    """
    name = F.sha2(F.concat(F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit("")), F.coalesce(F.sha2(F.col(text), 256), F.lit(""))), 256)
    rows = written(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text"), name.alias("name")), "text", ("key", "name"), width), "fingerprints")
    chosen = classes(rows, budget, F.struct(F.col("key").isNull().alias("last"), "key", "name")).select(F.col("least.name").alias("__name")).distinct()
    found = df.withColumn("__name", name).join(chosen, "__name", "left_semi")
    order = Window.partitionBy("__name").orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))
    return found.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(df.columns)


def hexadecimal(fp):
    """The fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
