"""Accounting of telemetry events; the same rules run on batches and on streams.

A number that was never observed is null, which differs from 0.  Events of the
shim are accounted elsewhere and count nowhere here; a violating event counts as a
violation and as nothing else, nor does it register its request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What only the shim may report, kinds of events, fields of tokens.
RESERVED_KINDS = ["opened"]
RESERVED_TOOLS = ["reader", "index"]
KINDS = ["model_call", "tool_call", "turn", "retry", "error", "stop"]
TOKENS = ["input", "output", "cache_read", "cache_write", "reasoning"]
METRICS = ["model_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "tool_calls", "turns", "errors", "retries", "cost"]

EVENT = (
    "attempt long, event_id long, seconds double, source string, kind string, tool string, request_id string, status string, error_class string, reason string, "
    "tokens struct<input: double, output: double, cache_read: double, cache_write: double, reasoning: double>, latency_ms double, cost struct<amount: double, currency: string>, stdout_bytes long"
)


def classify(events: DataFrame) -> DataFrame:
    """Adds ``origin`` (shim, executor, unattributed) and ``violation`` of reserved kinds and tools, null if none."""
    kind, tool = F.coalesce(F.col("kind").isin(RESERVED_KINDS), F.lit(False)), F.coalesce(F.col("tool").isin(RESERVED_TOOLS), F.lit(False))
    origin = F.when(F.col("source") == "shim", "shim").when(F.col("source") == "executor", "executor").otherwise("unattributed")
    violation = (
        F.when(F.col("source") == "shim", F.lit(None).cast("string")).when((F.col("source") == "executor") & kind, "reserved_kind").when((F.col("source") == "executor") & tool, "impersonated_tool")
        .when((F.col("source") == "executor"), F.lit(None).cast("string")).when(kind | tool, "unattributed_reserved_kind")
    )
    return events.withColumn("origin", origin).withColumn("violation", violation)


def filled(c: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def counted(events: DataFrame) -> DataFrame:
    """Classified events with ``_live`` (counts at all) and ``_repeat`` (a model call whose request came before)."""
    c = classify(events)
    live = (F.col("origin") != "shim") & F.col("violation").isNull()
    named = live & F.coalesce(F.col("kind") == "model_call", F.lit(False)) & filled(F.col("request_id"))
    key = F.when(named, F.concat(F.lit("r"), "request_id")).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    c = c.withColumn("_live", live).withColumn("_key", key)
    place = F.row_number().over(Window.partitionBy("attempt", "_key").orderBy("event_id"))
    return c.withColumn("_repeat", named & (place > 1)).drop("_key")


def facets(counted: DataFrame) -> DataFrame:
    """(attempt, facet, name, n, first, last): calls by tool, errors by class, stops by reason, costs by currency."""
    is_ = lambda k: F.col("_live") & ~F.col("_repeat") & F.coalesce(F.col("kind") == k, F.lit(False))
    failed = is_("error") | is_("model_call") & F.coalesce(F.col("status") == "error", F.lit(False))
    facet = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("facet"), value.alias("name")))
    named = lambda c, other: F.when(F.length(c) > 0, F.col(c)).otherwise(other)
    each = F.array_compact(F.array(
        facet("tool", named("tool", "unnamed"), is_("tool_call")), facet("error", named("error_class", "unclassed"), failed), facet("stop", F.col("reason"), is_("stop") & filled(F.col("reason"))),
        facet("currency", F.col("cost.currency"), is_("model_call") & F.col("cost.amount").isNotNull() & filled(F.col("cost.currency"))),
    ))
    rows = counted.select("attempt", "event_id", F.explode(each).alias("f")).select("attempt", "event_id", "f.*")
    return rows.groupBy("attempt", "facet", "name").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def account(events: DataFrame) -> DataFrame:
    """One row of all counters for each attempt.

    Lists by name are sorted ``name=n`` texts; they are made of counts that are
    aggregated by name before.
    """
    c = counted(events)
    live = F.col("_live")
    is_ = lambda k: live & ~F.col("_repeat") & F.coalesce(F.col("kind") == k, F.lit(False))
    call, ok = is_("model_call"), F.coalesce(F.col("status") != "error", F.lit(True))
    priced = call & F.col("cost.amount").isNotNull()
    t = c.groupBy("attempt").agg(
        F.count_if(live).alias("events"), F.count_if(live & (F.col("origin") == "unattributed")).alias("unattributed"), F.count_if(call).alias("_calls"), F.count_if(call & ok).alias("_ok"),
        F.count_if(call & ~ok).alias("_failed"), F.count_if(is_("error")).alias("_errors"), F.count_if(is_("retry")).alias("_retries"), *[F.sum(F.when(call, F.col(f"tokens.{x}"))).alias(f"{x}_tokens") for x in TOKENS],
        F.round(F.sum(F.when(call, F.col("latency_ms"))), 1).alias("latency_total"), F.max(F.when(call, F.col("latency_ms"))).alias("latency_max"), F.nullif(F.count_if(call & F.col("latency_ms").isNotNull()), F.lit(0)).alias("latency_n"),
        F.round(F.sum(F.when(priced, F.col("cost.amount"))), 8).alias("cost"), F.count_if(priced).alias("_priced"), F.count_if(call & F.col("cost.amount").isNull()).alias("_unpriced"),
        F.count_if(is_("tool_call")).alias("_tools"), F.coalesce(F.sum(F.when(is_("tool_call"), F.col("stdout_bytes"))), F.lit(0)).alias("_bytes"), F.count_if(is_("turn")).alias("_turns"), F.count_if(F.col("_repeat")).alias("duplicates"),
        (F.count_if(F.col("violation").isNotNull()) + F.count_if(live & ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)))).alias("_bad"),
    )
    of = lambda x, value: F.when(F.col("facet") == x, value)
    listed = lambda x: F.array_join(F.sort_array(F.collect_list(of(x, F.concat_ws("=", "name", F.col("n").cast("string"))))), ",")
    f = facets(c).groupBy("attempt").agg(
        listed("tool").alias("_by_tool"), listed("error").alias("_by_class"), listed("stop").alias("_by_reason"), F.max_by(of("stop", F.col("name")), of("stop", F.col("last"))).alias("stop_reason"),
        F.min_by(of("currency", F.col("name")), of("currency", F.col("first"))).alias("currency"),
        (F.coalesce(F.sum(of("currency", F.col("n"))), F.lit(0)) - F.coalesce(F.min_by(of("currency", F.col("n")), of("currency", F.col("first"))), F.lit(0))).alias("_mixed"),
    )
    j = t.join(f, "attempt", "left")
    seen = lambda x: F.when(F.col("_calls") > 0, x)
    return j.select(
        "attempt", "events", "unattributed", seen(F.col("_calls")).alias("model_calls"), seen(F.col("_ok")).alias("calls_ok"), seen(F.col("_failed")).alias("calls_error"), seen(F.col("_errors") + F.col("_failed")).alias("errors"),
        seen(F.col("_retries")).alias("retries"), *[f"{x}_tokens" for x in TOKENS], "latency_total", "latency_max", "latency_n", "cost", F.when(F.col("_priced") > 0, F.col("currency")).alias("currency"),
        F.nullif("_priced", F.lit(0)).alias("calls_with_cost"), F.when(F.col("_priced") > 0, F.col("_unpriced")).alias("calls_without_cost"), F.when(F.col("events") > 0, F.col("_tools")).alias("tool_calls"),
        F.when(F.col("_tools") > 0, F.col("_bytes")).alias("delivered_bytes"), F.when((F.col("_turns") > 0) | (F.col("_calls") > 0), F.col("_turns")).alias("turns"), "stop_reason", "duplicates",
        (F.col("_bad") + F.coalesce("_mixed", F.lit(0))).alias("violations"), F.coalesce("_by_tool", F.lit("")).alias("tools"), seen(F.coalesce("_by_class", F.lit(""))).alias("error_classes"),
        F.when(F.col("stop_reason").isNotNull(), F.col("_by_reason")).alias("stop_reasons"),
    )


#: Rows of a price list that are sent to every task.
MOST_PRICES = 10_000


def call_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Per attempt the price of its model calls, each request once; ``unpriced`` counts tokens without a price.

    ``prices``: model (the event's tool names it), field, per_million.  A call's cost
    is the sum over its token fields; the attempt's is null if any is unpriced.
    """
    n = prices.count()
    if n > MOST_PRICES:
        raise ValueError(f"more than {MOST_PRICES} prices")
    calls = counted(events).where(F.col("_live") & ~F.col("_repeat") & (F.col("kind") == "model_call"))
    each = calls.select("attempt", "tool", F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"tokens.{x}").alias("tokens")) for x in TOKENS])).alias("t")).select("attempt", "tool", "t.*")
    p = each.join(F.broadcast(prices.select(F.col("model").alias("tool"), "field", "per_million")), ["tool", "field"], "left")
    unknown = F.count_if(F.col("per_million").isNull() & (F.col("tokens") > 0))
    return p.groupBy("attempt").agg(F.when(unknown == 0, F.round(F.sum(F.col("tokens") * F.col("per_million") / 1e6), 9)).alias("cost"), unknown.alias("unpriced"))


def ceiling_hit(events: DataFrame, wall_s: float, tool_calls: int, turns: int) -> DataFrame:
    """Per attempt the first event at which a ceiling is exceeded, checked in the order wall, tool calls, turns."""
    w = Window.partitionBy("attempt").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = events.select("attempt", "event_id", (F.col("seconds") - F.min("seconds").over(w)).alias("_w"), F.count_if(F.col("kind") == "tool_call").over(w).alias("_c"), F.count_if(F.col("kind") == "turn").over(w).alias("_t"))
    reason = F.when(F.col("_w") > wall_s, "wall_s").when(F.col("_c") > tool_calls, "tool_calls").when(F.col("_t") > turns, "turns")
    return run.withColumn("reason", reason).where("reason is not null").groupBy("attempt").agg(F.min(F.struct("event_id", "reason")).alias("s")).select("attempt", "s.event_id", "s.reason")


def unpivoted(report: DataFrame, value: str) -> DataFrame:
    return report.select("attempt", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot("attempt", METRICS, "metric", value)


def reconcile(stream: DataFrame, result: DataFrame) -> DataFrame:
    """attempt, metric, both values and how they compare; missing is neither 0 nor a match."""
    j = unpivoted(stream, "stream_value").join(unpivoted(result, "result_value"), ["attempt", "metric"], "full_outer")
    s, r = F.col("stream_value"), F.col("result_value")
    state = F.when(s.isNull() & r.isNull(), "missing").when(s.isNull(), "missing_stream").when(r.isNull(), "missing_result").when(F.abs(s - r) < 1e-6, "match").otherwise("mismatch")
    return j.withColumn("state", state)


def coverage(report: DataFrame, results: DataFrame) -> DataFrame:
    """attempt, metric, whether it was observed, from where, and why not; ``results`` has the executors' own totals."""
    own = results.select("attempt", F.lit(True).alias("_has"), F.col("identified").alias("_who"), (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()).alias("_tokens"), F.col("cost").isNotNull().alias("_cost"))
    j = report.join(own, "attempt", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tokens = F.coalesce(*[F.col(f"{x}_tokens") for x in TOKENS]).isNotNull()
    found = {
        "model_identity": (F.when(yes("_who"), "result"), F.when(yes("_has"), "identity incomplete").otherwise("no result")),
        "tokens": (F.when(tokens, "stream").when(yes("_tokens"), "result"), F.lit("no tokens seen")),
        "cost": (F.when(F.col("cost").isNotNull(), "stream").when(yes("_cost"), "result"), F.lit("no price seen")),
        "tool_calls": (F.when(F.col("unattributed") == 0, "stream"), F.lit("events without a source")),
        "turns": (F.when(F.col("turns").isNotNull(), "stream"), F.lit("no turns seen")),
    }
    each = [F.struct(F.lit(m).alias("metric"), s.isNotNull().alias("observed"), F.coalesce(s, F.lit("absent")).alias("source"), F.when(s.isNull(), why).alias("reason")) for m, (s, why) in found.items()]
    return j.select("attempt", F.explode(F.array(*each)).alias("c")).select("attempt", "c.*")


def contract_state(report: DataFrame, reconciled: DataFrame, covered: DataFrame, results: DataFrame) -> DataFrame:
    """attempt and its contract's state: violation, missing, partial or ok."""
    bad = reconciled.groupBy("attempt").agg(F.count_if(F.col("state") == "mismatch").alias("mismatches"))
    part = covered.groupBy("attempt").agg(F.count_if(~F.col("observed")).alias("uncovered"))
    j = report.select("attempt", "violations").join(bad, "attempt", "left").join(part, "attempt", "left").join(results.select("attempt").distinct().withColumn("_r", F.lit(True)), "attempt", "left")
    state = F.when((F.col("violations") > 0) | (F.col("mismatches") > 0), "violation").when(F.col("_r").isNull(), "missing").when(F.col("uncovered") > 0, "partial").otherwise("ok")
    return j.select("attempt", state.alias("state"))


def evidence_class(kind: Column, state: Column) -> Column:
    return F.when(kind == "dry", "infrastructure_only").when(state.isin("ok", "partial"), "real").when(state == "missing", "unverified").otherwise("contract_violation")


def outcome(kind: Column, state: Column, stopped: Column, exit_code: Column, patch_bytes: Column) -> Column:
    """How an attempt ended: dry, stopped by a ceiling, failed, without a patch, or finished; a violated contract overrides."""
    return (
        F.when(kind == "dry", "dry").when(state == "violation", "contract_violation").when(stopped.isNotNull(), F.concat(F.lit("stopped:"), stopped))
        .when(F.coalesce(exit_code, F.lit(-1)) != 0, "failed").when(F.coalesce(patch_bytes, F.lit(0)) == 0, "no_patch").otherwise("finished")
    )
