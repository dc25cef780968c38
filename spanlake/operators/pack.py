"""Line spans and their packing under hard budgets.

Spans are closed intervals of line numbers from 1.  All operators work on the
candidates of each query apart; a query has a bounded number of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.sources.corpus import written

UNIT_OVERHEAD = 64  # bytes a unit takes beside its text


def islands(df: DataFrame, keys: list[str], at: str = "line", gap: int = 1) -> DataFrame:
    """Runs of ``at`` whose neighbours are at most ``gap`` apart: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(at)
    first = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    run = df.withColumn("_new", first).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_run")


def match_spans(matches: DataFrame, sizes: DataFrame, keys: list[str], file: str = "doc_id", ctx: int = 6) -> DataFrame:
    """Clusters of matching lines with ``ctx`` lines around them, within the file.

    ``matches`` has keys and line, ``sizes`` the file and n_lines.  Matches whose
    surroundings touch are one span.
    """
    spans = islands(matches, keys, gap=2 * ctx + 1).join(sizes.select(file, "n_lines"), file)
    return spans.select(*keys, F.greatest(F.col("start") - ctx, F.lit(1)).alias("start"), F.least(F.col("end") + ctx, F.col("n_lines")).cast("int").alias("end"))


def sliced(spans: DataFrame, keep: list[str], size: int = 60) -> DataFrame:
    """Spans cut in slices of ``size`` lines at most."""
    return spans.withColumn("_s", F.explode(F.expr(f"sequence(start, end, {size})"))).select(*keep, F.col("_s").alias("start"), F.least("end", F.col("_s") + size - 1).alias("end"))


def round_robin(spans: DataFrame, query: str, file: str, file_rank: str, per_file: int = 3) -> DataFrame:
    """First span of every file by rank, then the second of each, ...; ``dropped`` counts a file's spans beyond ``per_file``."""
    w = Window.partitionBy(query, file).orderBy("start")
    slots = spans.withColumn("slot", F.row_number().over(w)).withColumn("dropped", F.greatest(F.count("*").over(Window.partitionBy(query, file)) - per_file, F.lit(0)))
    order = Window.partitionBy(query).orderBy("slot", file_rank)
    return slots.where(F.col("slot") <= per_file).withColumn("position", F.row_number().over(order))


def prefix_budget(units: DataFrame, query: str, budget: int, cost: str = "cost") -> DataFrame:
    """Units in order while their running cost stays within the budget."""
    w = Window.partitionBy(query).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_pack(units: DataFrame, query: str, budget: int, cost: str = "cost") -> DataFrame:
    """Per query the positions kept, those over budget, and what is used.

    A unit that doesn't fit is passed over and later, smaller ones may still fit,
    which no running sum can tell: an ordered fold over the query's candidates.
    """
    items = F.sort_array(F.collect_list(F.struct("position", F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("kept"), F.expr("cast(array() as array<int>)").alias("over"))

    def step(s, x):
        fits = s["used"] + x["c"] <= budget
        return F.struct(
            F.when(fits, s["used"] + x["c"]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.concat(s["kept"], F.array(x["position"]))).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["over"]).otherwise(F.concat(s["over"], F.array(x["position"]))).alias("over"),
        )

    return units.groupBy(query).agg(items.alias("_i")).select(query, F.aggregate("_i", start, step).alias("s")).select(query, "s.used", "s.kept", "s.over")


def evidence_reserve(units: DataFrame, query: str, budget: int, reserve_pct: int, cost: str = "cost") -> DataFrame:
    """As greedy packing, but units that aren't ``lexical`` may use only the part of the budget that isn't reserved."""
    limit = budget * (100 - reserve_pct) // 100
    items = F.sort_array(F.collect_list(F.struct("position", F.col(cost).cast("long").alias("c"), "lexical")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("plain"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(s, x):
        fits = (s["used"] + x["c"] <= budget) & (x["lexical"] | (s["plain"] + x["c"] <= limit))
        return F.struct(
            F.when(fits, s["used"] + x["c"]).otherwise(s["used"]).alias("used"),
            F.when(fits & ~x["lexical"], s["plain"] + x["c"]).otherwise(s["plain"]).alias("plain"),
            F.when(fits, F.concat(s["kept"], F.array(x["position"]))).otherwise(s["kept"]).alias("kept"),
        )

    return units.groupBy(query).agg(items.alias("_i")).select(query, F.aggregate("_i", start, step).alias("s")).select(query, "s.used", F.col("s.plain").alias("used_plain"), "s.kept")


def subtract_covered(spans: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """What of the spans isn't covered: lines of the spans without the covered ones, as runs."""
    own = spans.select(*keys, F.explode(F.sequence("start", "end")).alias("line")).distinct()
    other = covered.select(*keys, F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return islands(own.join(other, [*keys, "line"], "left_anti"), keys)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans of the same file that share a line."""
    b = b.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a.join(b, keys).where("start <= b_end and b_start <= end").select(*keys, "start", "end", "b_start", "b_end")


def enclosing(lines: DataFrame, declarations: DataFrame, file: str = "doc_id") -> DataFrame:
    """For each line the last declaration at or before it in its file: as-of, by one pass over the sorted file."""
    both = lines.select(file, "line", F.lit(None).cast("string").alias("_n"), F.lit(None).cast("int").alias("_d"), F.lit(1).alias("_k"))
    both = both.unionByName(declarations.select(file, "line", F.col("name").alias("_n"), F.col("line").alias("_d"), F.lit(0).alias("_k")))
    w = Window.partitionBy(file).orderBy("line", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("name", F.last("_n", True).over(w)).withColumn("decl_line", F.last("_d", True).over(w))
    return out.where("_k = 1").select(file, "line", "name", "decl_line")


def unit_json(file: Column, start: Column, end: Column, digest: Column, text: Column, evidence: Column, reason: Column, truncated: Column) -> Column:
    """A unit as it is delivered."""
    fields = (("file", file), ("line", start), ("end_line", end), ("hash", digest), ("text", text), ("evidence", evidence), ("reason", reason), ("truncated", truncated))
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]))


def settled(size: Column) -> Column:
    """Bytes of a document of ``size`` bytes that further states its own bytes and a quarter of them."""
    digits = lambda c: F.length(c.cast("string")).cast("long")
    # digits grow by one at most from round to round
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), size.cast("long"), lambda out, _: size.cast("long") + digits(out) + digits(F.floor(out / 4)))


ENVELOPE = '{{"schema":"context/1","state":"{state}","units":[],"budget":{{"requested_tokens":{tokens},"max_bytes":{bytes},"used_tokens":,"used_bytes":}},"omitted":{{"n":{n},"reasons":[{reasons}]}},"hints":[{hints}]}}'


def envelope_bytes(state: Column, budget_tokens: int, max_bytes: int, n: Column, reasons: Column, hints: Column) -> Column:
    """Bytes of a response without its units and its own size; reasons and hints are arrays of texts."""
    fixed = len(ENVELOPE.format(state="", tokens=budget_tokens, bytes=max_bytes, n="", reasons="", hints=""))
    listed = lambda a: F.octet_length(F.to_json(a)) - 2
    return F.lit(fixed) + F.length(state) + F.length(n.cast("string")) + listed(reasons) + listed(hints)


def state_of(stale: Column, omitted: Column, truncated: Column, reasons: Column) -> Column:
    return F.when(stale, "stale").when((omitted > 0) | truncated | (F.size(reasons) > 0), "partial").otherwise("ok")


def deliver(units: DataFrame, base: DataFrame, query: str, budget_tokens: int, max_bytes: int, most_hints: int = 5) -> DataFrame:
    """The response to each query: the longest prefix of its units whose whole serialisation fits both budgets.

    ``units`` has query, position (from 1 without gaps), file, start, end, digest,
    text, evidence, reason; ``base`` a row for each query with dropped, reasons, hints
    and stale, from before.  Room that is left goes to the first three, two or one
    quarter of the next unit's lines, the largest that fits.  Result: state, n_units,
    used_bytes, used_tokens, omitted, reasons, hints, cut_end (the last line of a unit
    that was cut).  Sizes are those of the serialised response that states them.
    """
    empty = F.expr("cast(array() as array<string>)")
    as_json = lambda text, end, cut: unit_json(F.col("file").cast("string"), F.col("start"), end, F.col("digest"), text, F.col("evidence"), F.col("reason"), F.lit(cut))
    sized = written(units.withColumn("_len", F.octet_length(as_json(F.col("text"), F.col("end"), False))), "units")
    n = sized.groupBy(query).agg(F.count("*").alias("_all"), F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("position") <= most_hints + 1, F.struct("position", F.col("file").cast("string").alias("f"))))), lambda x: x["f"]), 1, most_hints + 1).alias("_next"))
    run = Window.partitionBy(query).orderBy("position")
    prefix = sized.select(query, F.col("position").alias("k"), (F.sum("_len").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("position") - 1).alias("_units"), F.collect_list(F.col("file").cast("string")).over(run.rowsBetween(1, most_hints + 1)).alias("_next"))
    start = base.join(n, query, "left")
    none = start.select(query, F.lit(0).alias("k"), F.lit(0).cast("long").alias("_units"), F.coalesce("_next", empty).alias("_next"))
    rows = none.unionByName(prefix).join(start.drop("_next").fillna(0, ["_all"]), query)

    def measured(df: DataFrame, omitted: Column, extra: Column, truncated: Column) -> DataFrame:
        reasons = F.array_sort(F.array_distinct(F.concat("reasons", extra)))
        df = df.withColumn("omitted", omitted).withColumn("_reasons", reasons).withColumn("state", state_of(F.col("stale"), F.col("omitted"), truncated, F.col("_reasons")))
        hints = F.slice(F.concat("hints", F.transform("_next", lambda f: F.concat(F.lit("expand: "), f))), 1, most_hints)
        no_match = (F.col("_all") == 0) & (F.size("reasons") == 0) & (F.size(hints) == 0)
        df = df.withColumn("_hints", F.when(no_match, F.array(F.lit("no match: widen the query"))).otherwise(hints))
        df = df.withColumn("_size", envelope_bytes(F.col("state"), budget_tokens, max_bytes, F.col("omitted"), F.col("_reasons"), F.col("_hints")) + F.col("_units")).withColumn("used_bytes", settled(F.col("_size")))
        df = df.withColumn("used_tokens", F.floor(F.col("used_bytes") / 4).cast("long"))
        return df.withColumn("_fits", (F.col("used_bytes") <= max_bytes) & (F.col("used_tokens") <= budget_tokens))

    cut = F.col("k") < F.col("_all")
    whole = measured(rows, F.col("dropped") + F.col("_all") - F.col("k"), F.when(cut, F.array(F.lit("budget"))).otherwise(empty), F.lit(False))
    best = whole.groupBy(query).agg(F.max_by(F.struct(*[c for c in whole.columns if c != query]), F.when(F.col("_fits"), F.col("k")).otherwise(-1)).alias("b")).select(query, "b.*")
    best = written(best.withColumn("cut_end", F.lit(None).cast("int")), "best")
    # the next unit, cut
    lines = F.split("text", "\n")
    following = best.where(F.col("_fits") & cut).select(query, "k", "_all", "_units", "dropped", "reasons", "hints", "stale", "_next").join(sized.withColumn("k", F.col("position") - 1), [query, "k"])
    keep = F.explode(F.array_distinct(F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda q: F.floor(F.size(lines) * q / 4).cast("int")))).alias("keep")
    some = following.select("*", keep).where((F.col("keep") > 0) & (F.col("keep") < F.size(lines)))
    end = (F.col("start") + F.col("keep") - 1).cast("int")
    some = some.withColumn("cut_end", end).withColumn("_units", F.col("_units") + F.octet_length(as_json(F.array_join(F.slice(lines, F.lit(1), F.col("keep")), "\n"), end, True)) + (F.col("k") > 0).cast("int"))
    some = some.withColumn("_next", F.slice("_next", 2, most_hints)).withColumn("k", F.col("k") + 1)
    some = measured(some, F.col("dropped") + F.col("_all") - F.col("k"), F.array(F.lit("budget")), F.lit(True)).where("_fits")
    cols = ["state", "k", "used_bytes", "used_tokens", "omitted", "_reasons", "_hints", "cut_end"]
    part = some.groupBy(query).agg(F.max_by(F.struct(*cols), "keep").alias("p"))
    out = best.join(part, query, "left").select(query, F.coalesce("p", F.struct(*cols)).alias("r"), "_fits", "stale", "dropped", "reasons").select(query, "r.*", "_fits", "stale", "dropped", "reasons")
    # a budget below the empty response: nothing is delivered and the reason says so
    low = F.array_sort(F.array_distinct(F.concat("reasons", F.array(F.lit("envelope_too_large")))))
    hint = F.array(F.lit("budget below the empty response; raise it"))
    out = out.withColumn("_size", envelope_bytes(F.when(F.col("stale"), "stale").otherwise("partial"), budget_tokens, max_bytes, F.col("dropped"), low, hint))
    size = settled(F.col("_size"))
    pick = lambda c, other: F.when(F.col("_fits"), F.col(c)).otherwise(other)
    return out.select(
        query, pick("state", F.when(F.col("stale"), "stale").otherwise("partial")).alias("state"), pick("k", F.lit(0)).alias("n_units"), pick("used_bytes", size).alias("used_bytes"), pick("used_tokens", F.floor(size / 4).cast("long")).alias("used_tokens"),
        pick("omitted", F.col("dropped")).alias("omitted"), F.array_join(pick("_reasons", low), ",").alias("reasons"), F.array_join(pick("_hints", hint), " | ").alias("hints"), "cut_end",
    )


def unit_text(spans: DataFrame, files: DataFrame, file: str = "doc_id") -> DataFrame:
    """Adds the text of each span; ``files`` has the file and its array of lines."""
    j = spans.join(files.select(file, "lines"), file)
    return j.withColumn("text", F.array_join(F.slice("lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n")).drop("lines")
