"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the tape is
cut in blocks of ``block`` words.  Slot i of the mix has the point frac(i * g),
g the golden ratio, which falls in one source's share of the cumulative targets;
the k-th slot of a source takes block k of its tape, and starts the tape again
after its last block until its target is met.  A document's share of the mix is
the words of its blocks over all slots that take them.

Positions on the tapes and ranks of slots are prefix sums in two levels (within
buckets of hashes or runs of slots, and over their totals), so a source that
holds a third of all rows is never in one task.  Rows that are equal in key, source
and text are one entry of the tape, as often as there are copies; what it takes is
dealt evenly among them.  The driver has one entry for each source, ``MOST_SOURCES``
at most; a table with more is refused (mix by a coarser column).

Results for odd input: a null text has size 0 and is never taken; a null source
is a source of its own, after all others; a source without words has target 0;
an empty table gives no rows; rows without a key, or with the same key and another
text, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import written

GOLDEN = (5**0.5 - 1) / 2
RUN = 1 << 16  # slots of a run
CYCLE = (5.0, 2.0, 1.0)
#: Sources the driver and each task hold a number for, and those whose table is broadcast.
MOST_SOURCES, FEW_SOURCES = 1_000_000, 50_000


def word_count(text):
    """Number of maximal runs of characters other than blank; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    # sources fill up in the order of their room for each unit of weight; the rest share what is left
    order = sorted(range(len(sizes)), key=lambda k: most * sizes[k] / weights[k])
    out, left, weight = [0.0] * len(sizes), float(total), sum(weights)
    for place, k in enumerate(order):
        if left / weight * weights[k] <= most * sizes[k]:
            for j in order[place:]:
                out[j] = left / weight * weights[j]
            break
        out[k] = most * float(sizes[k])
        left, weight = left - out[k], weight - weights[k]
    return out


def sizes_by_source(docs: DataFrame) -> list[tuple[str | None, int]]:
    """(source, words) in code point order, null last; one entry for each source."""
    by = docs.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("n"))
    rows = by.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix by a coarser column")
    return sorted(((r["_source"], int(r["n"] or 0)) for r in rows), key=lambda x: (x[0] is None, x[0] or ""))


def tape(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_from``, the words of the same source before the document on its tape.

    ``docs`` has _source_no, _size, _copies, _order (a hash), _tie.  Buckets split
    the range of the hash; their totals are few rows for each source.
    """
    words = F.sum(F.col("_size") * F.col("_copies"))
    rows = docs.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(buckets)))
    total = rows.groupBy("_source_no", "_bucket").agg(words.alias("_n"))
    before = Window.partitionBy("_source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_source_no", "_bucket").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(words.over(within), F.lit(0)))
    return rows.join(total, ["_source_no", "_bucket"]).withColumn("_from", F.col("_base") + F.col("_before")).drop("_base", "_before")


def slots_needed(goal: float, size: int, block: int) -> tuple[int, int]:
    """Slots that take round(goal) words from a tape of ``size`` words, and the words of the last of them."""
    whole, rest = divmod(round(goal), size) if size else (0, 0)
    per_pass = -(-size // block)
    if not rest:
        return whole * per_pass, (size - 1) % block + 1 if size else 0
    return whole * per_pass + -(-rest // block), (rest - 1) % block + 1


def schedule(spark, goals: list[float], sizes: list[int], block: int) -> DataFrame:
    """(slot, source_no, rank, block, turn, words): which block of its tape each slot of the mix takes.

    Slots follow the golden-ratio points; those of a source that has reached its
    goal are left out, and the few that others then lack stand at the end.  A
    source's last slot takes only the words still missing, so the words taken are
    the goals, rounded.
    """
    slots = -(-round(sum(goals)) // block)
    cumulative = np.cumsum(np.array(goals, float))
    cumulative = cumulative / cumulative[-1]
    length = np.array([max(1, -(-n // block)) for n in sizes], np.int64)
    need, last = (np.array(x, np.int64) for x in zip(*(slots_needed(g, n, block) for g, n in zip(goals, sizes, strict=True)), strict=True))

    def source_of(run: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(run * RUN, min(slots, (run + 1) * RUN))
        return slot, np.minimum(np.searchsorted(cumulative, (slot * GOLDEN) % 1.0, side="right"), len(length) - 1)

    def placed(slot: np.ndarray, source: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        ok = rank < need[source]
        slot, source, rank = slot[ok], source[ok], rank[ok]
        words = np.where(rank == need[source] - 1, last[source], block)
        return pa.RecordBatch.from_pydict({"slot": slot, "source_no": source.astype(np.int32), "rank": rank, "block": rank % length[source], "turn": (rank // length[source]).astype(np.int32), "words": words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in b["id"].to_pylist():
                source, n = np.unique(source_of(run)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"run": np.full(len(n), run), "n": n, "source_no": source.astype(np.int32)})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, bases in zip(b["run"].to_pylist(), b["bases"].to_pylist(), strict=True):
                base = np.zeros(len(length), np.int64)
                for x in bases:
                    base[x["source_no"]] = x["base"]
                slot, source = source_of(run)
                order = np.argsort(source, kind="stable")
                begin = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(length)))[:-1]])
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - begin[source[order]]
                yield placed(slot, source, rank + base[source])

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, source = b["at"].to_numpy(), b["source_no"].to_numpy()
                yield placed(slots + at, source, b["rank"].to_numpy())

    runs = -(-slots // RUN)
    kind = "slot long, source_no int, rank long, block long, turn int, words long"
    counted = written(spark.range(0, runs, 1, min(runs, max(8, runs // 8))).mapInArrow(count, "run long, n long, source_no int"), "runs")
    have = np.zeros(len(length), np.int64)
    for r in counted.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        have[r["source_no"]] = r["n"]
    more = [(k, int(s)) for s in range(len(length)) for k in range(int(have[s]), int(need[s]))]
    more = [(at, s, k) for at, (k, s) in enumerate(sorted(more))]
    before = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    dealt = based.groupBy("run").agg(F.collect_list(F.struct("source_no", "base")).alias("bases"))
    out = dealt.mapInArrow(ranked, kind)
    if more:
        out = out.unionByName(spark.createDataFrame(more, "at long, source_no int, rank long").mapInArrow(lacking, kind))
    return out


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cycle: tuple[float, ...] = CYCLE, total_share: float = 1.5, most: int = 2, block: int = 64, per_bucket: int = 2000) -> tuple[DataFrame, DataFrame | None]:
    """The documents' part in the mix, and the schedule of its slots (None if there is nothing to take).

    Columns of the first: key, _source_no, size, source_size, target, taken.
    Sources weigh ``cycle`` in code point order, repeating; together they share
    ``total_share`` of all words, none more than ``most`` times its size.
    """
    spark = df.sparkSession
    tie = F.xxhash64(F.col(text).cast("string"))
    docs = df.select(F.col(key), F.col(source).cast("string").alias("_source"), word_count(F.col(text)).alias("_size"), F.xxhash64(F.col(key).cast("string"), tie, F.lit("mix")).alias("_order"), tie.alias("_tie"))
    docs = written(docs.groupBy(*docs.columns).agg(F.count("*").alias("_copies")), "sizes")
    by = sizes_by_source(docs)
    sizes = [n for _, n in by]
    weights = [cycle[k % len(cycle)] for k in range(len(by))]
    goal = targets(sizes, weights, total_share * sum(sizes), most)
    names = spark.createDataFrame([(k, s, n, float(t)) for k, ((s, n), t) in enumerate(zip(by, goal, strict=True))], "_source_no int, _name string, source_size long, target double")
    if len(by) <= FEW_SOURCES and sum(len(s or "") for s, _ in by) <= 1 << 22:
        names = F.broadcast(names)
    docs = docs.join(names, F.col("_source").eqNullSafe(F.col("_name"))).drop("_source", "_name")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy")
    if not sum(sizes):
        none = docs.select(key, "_source_no", F.col("_size").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("taken"), each)
        return none.drop("_copy"), None
    buckets = max(8, docs.count() // per_bucket)
    placed = written(tape(docs, buckets).withColumn("_id", F.monotonically_increasing_id()), "tape")
    plan = schedule(spark, goal, sizes, block)
    pieces = placed.where("_size > 0").withColumn("_words", F.col("_size") * F.col("_copies"))
    pieces = pieces.select("_id", F.col("_source_no").alias("source_no"), "_from", "_words", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_from + _words - 1) div {block}"))).alias("block"))
    end = F.least(F.col("_from") + F.col("_words"), F.col("block") * block + F.col("words"))
    words = F.greatest(end - F.greatest("_from", F.col("block") * block), F.lit(0))
    joined = pieces.join(plan.select("source_no", "block", "words"), ["source_no", "block"])
    taken = joined.groupBy("_id").agg(F.sum(words).cast("long").alias("_taken"))
    out = placed.join(taken, "_id", "left").withColumn("_taken", F.coalesce("_taken", F.lit(0).cast("long")))
    out = out.select(key, "_source_no", F.col("_size").alias("size"), "source_size", "target", "_taken", "_copies", each)
    share = F.expr("_taken div _copies") + (F.col("_copy") < F.col("_taken") % F.col("_copies")).cast("long")
    return out.select(key, "_source_no", "size", "source_size", "target", share.alias("taken")), plan


def mixed(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, all columns unchanged, as often as the mix takes them, to the nearest whole number.

    Texts without words are in no mix.  Rows with the same key share what their
    key takes.
    """
    parts, _ = mix(df, text, source, key, **options)
    times = parts.groupBy(F.col(key).alias("__key")).agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__times")).where("__times > 0")
    rows = df.join(times, df[key].eqNullSafe(times["__key"])).drop("__key")
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")
