"""Queries on telemetry and histories; events stand for the stream, users for attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import accounting as A
from spanlake.operators import history as H
from spanlake.plans.registry import query
from spanlake.sources.corpus import fresh_path, table

EV_SQL = """ev as (select user_id as attempt, event_id, epoch_us(ts)::double / 1e6 as seconds, case when event_id % 17 = 0 then null when event_id % 3 = 0 then 'shim' else 'executor' end as source,
    case when event_id % 29 = 0 then 'opened' when event_id % 23 = 0 then 'retry' when event_id % 37 = 0 then 'strange' else case event_type when 'purchase' then 'model_call' when 'click' then 'tool_call' when 'view' then 'turn' when 'error' then 'error' else 'stop' end end as kind,
    case when event_id % 31 = 0 then 'reader' else ['m1', 'm2', 'm3', 'm4', null][1 + event_id % 5] end as tool, case when event_id % 10 = 0 then null when event_id % 26 = 0 then ' ' else json_extract_string(props, '$.k') end as request_id,
    case when event_id % 5 = 0 then 'error' else 'ok' end as status, ['timeout', 'limit', null, ''][1 + event_id % 4] as error_class, case when event_id % 6 = 0 then ' ' when event_id % 2 = 0 then 'done' else 'budget' end as reason,
    floor(value)::double as input, case when event_id % 3 <> 0 then floor(value * 2)::double end as output, case when event_id % 7 = 0 then 5.0::double end as cache_read, null::double as cache_write, case when event_id % 41 = 0 then 0.0::double end as reasoning,
    case when event_id % 4 <> 0 then floor(value * 8) / 8 end as latency_ms, case when event_id % 19 <> 0 then floor(value * 4) / 4 end as amount, case when event_id % 19 <> 0 and event_id % 11 <> 0 then case when event_id % 13 = 0 then 'EUR' else 'USD' end end as currency,
    case when event_id % 9 <> 0 then event_id % 1000 end as stdout_bytes from events),
  cl as (select *, case when source = 'shim' then 'shim' when source = 'executor' then 'executor' else 'unattributed' end as origin, case when source = 'shim' then null when source = 'executor' and kind = 'opened' then 'reserved_kind'
    when source = 'executor' and tool = 'reader' then 'impersonated_tool' when source = 'executor' then null when kind = 'opened' or tool = 'reader' then 'unattributed_reserved_kind' end as violation from ev),
  dk as (select *, origin <> 'shim' and violation is null as live, origin <> 'shim' and violation is null and kind = 'model_call' and coalesce(length(trim(request_id)), 0) > 0 as named,
    row_number() over (partition by attempt, case when origin <> 'shim' and violation is null and kind = 'model_call' and length(trim(request_id)) > 0 then 'r' || request_id else 'e' || event_id end order by event_id) as n from cl),
  lv as (select *, live and not (named and n > 1) as once from dk), cal as (select * from lv where once and kind = 'model_call')"""
TOKEN_SQL = ", ".join(f"sum({x}) filter (once and kind = 'model_call') as {x}_tokens" for x in A.TOKENS)
ACC_SQL = f"""{EV_SQL},
  fa as (select attempt, 'tool' as facet, coalesce(nullif(tool, ''), 'unnamed') as name, event_id from lv where once and kind = 'tool_call'
    union all select attempt, 'error', coalesce(nullif(error_class, ''), 'unclassed'), event_id from lv where once and (kind = 'error' or kind = 'model_call' and status = 'error')
    union all select attempt, 'stop', reason, event_id from lv where once and kind = 'stop' and trim(reason) <> '' union all select attempt, 'currency', currency, event_id from cal where amount is not null and trim(currency) <> ''),
  fc as (select attempt, facet, name, count(*) as n, min(event_id) as first, max(event_id) as last from fa group by 1, 2, 3),
  fs as (select attempt, string_agg(name || '=' || n, ',' order by name || '=' || n) filter (facet = 'tool') as by_tool, string_agg(name || '=' || n, ',' order by name || '=' || n) filter (facet = 'error') as by_class, string_agg(name || '=' || n, ',' order by name || '=' || n) filter (facet = 'stop') as by_reason,
    max_by(name, last) filter (facet = 'stop') as stop_reason, min_by(name, first) filter (facet = 'currency') as currency, coalesce(sum(n) filter (facet = 'currency'), 0) - coalesce(min_by(n, first) filter (facet = 'currency'), 0) as mixed from fc group by 1),
  tt as (select attempt, count(*) filter (live) as events, count(*) filter (live and origin = 'unattributed') as unattributed, count(*) filter (once and kind = 'model_call') as calls, count(*) filter (once and kind = 'model_call' and status <> 'error') as ok,
    count(*) filter (once and kind = 'model_call' and status = 'error') as failed, count(*) filter (once and kind = 'error') as errs, count(*) filter (once and kind = 'retry') as retr, {TOKEN_SQL},
    round(sum(latency_ms) filter (once and kind = 'model_call'), 1) as latency_total, max(latency_ms) filter (once and kind = 'model_call') as latency_max, nullif(count(latency_ms) filter (once and kind = 'model_call'), 0) as latency_n,
    round(sum(amount) filter (once and kind = 'model_call'), 8) as cost, count(amount) filter (once and kind = 'model_call') as priced, count(*) filter (once and kind = 'model_call' and amount is null) as unpriced, count(*) filter (once and kind = 'tool_call') as tl,
    coalesce(sum(stdout_bytes) filter (once and kind = 'tool_call'), 0)::bigint as bytes, count(*) filter (once and kind = 'turn') as tn, count(*) filter (named and n > 1) as duplicates,
    count(*) filter (violation is not null) + count(*) filter (live and kind = 'strange') as bad from lv group by 1),
  acc as (select attempt, events, unattributed, nullif(calls, 0) as model_calls, case when calls > 0 then ok end as calls_ok, case when calls > 0 then failed end as calls_error, case when calls > 0 then errs + failed end as errors, case when calls > 0 then retr end as retries,
    {", ".join(f"{x}_tokens" for x in A.TOKENS)}, latency_total, latency_max, latency_n, cost, case when priced > 0 then fs.currency end as currency, nullif(priced, 0) as calls_with_cost, case when priced > 0 then unpriced end as calls_without_cost,
    case when events > 0 then tl end as tool_calls, case when tl > 0 then bytes end as delivered_bytes, case when tn > 0 or calls > 0 then tn end as turns, stop_reason, duplicates, (bad + coalesce(mixed, 0))::bigint as violations, coalesce(by_tool, '') as tools,
    case when calls > 0 then coalesce(by_class, '') end as error_classes, by_reason as stop_reasons from tt left join fs using (attempt))"""


def events(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = (
        F.when(i % 29 == 0, "opened").when(i % 23 == 0, "retry").when(i % 37 == 0, "strange").when(F.col("event_type") == "purchase", "model_call").when(F.col("event_type") == "click", "tool_call")
        .when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "error", "error").otherwise("stop")
    )
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (i % n).cast("int"))
    value = F.col("value")
    tokens = F.struct(
        F.floor(value).cast("double").alias("input"), F.when(i % 3 != 0, F.floor(value * 2).cast("double")).alias("output"), F.when(i % 7 == 0, 5.0).alias("cache_read"), F.lit(None).cast("double").alias("cache_write"), F.when(i % 41 == 0, 0.0).alias("reasoning")
    )
    cost = F.when(i % 19 != 0, F.struct((F.floor(value * 4) / 4).alias("amount"), F.when(i % 11 != 0, F.when(i % 13 == 0, "EUR").otherwise("USD")).alias("currency")))
    return e.select(
        F.col("user_id").alias("attempt"), i, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.when(i % 17 == 0, None).when(i % 3 == 0, "shim").otherwise("executor").alias("source"), kind.alias("kind"),
        F.when(i % 31 == 0, "reader").otherwise(pick(["m1", "m2", "m3", "m4", None], 5)).alias("tool"), F.when(i % 10 == 0, None).when(i % 26 == 0, " ").otherwise(F.get_json_object("props", "$.k")).alias("request_id"),
        F.when(i % 5 == 0, "error").otherwise("ok").alias("status"), pick(["timeout", "limit", None, ""], 4).alias("error_class"), F.when(i % 6 == 0, " ").when(i % 2 == 0, "done").otherwise("budget").alias("reason"), tokens.alias("tokens"),
        F.when(i % 4 != 0, F.floor(value * 8) / 8).alias("latency_ms"), cost.alias("cost"), F.when(i % 9 != 0, i % 1000).alias("stdout_bytes"),
    )


METRIC_SQL = ", ".join(A.METRICS)
RESULT_SQL = f"""{ACC_SQL}, res as (select attempt, attempt % 4 <> 1 as identified, case when attempt % 5 = 0 then model_calls + 1 else model_calls end as model_calls, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, tool_calls, case when attempt % 3 <> 0 then turns end as turns, errors, retries, cost from acc where attempt % 7 <> 0),
  us as (unpivot (select attempt, {", ".join(f"{m}::double as {m}" for m in A.METRICS)} from acc) on {METRIC_SQL} into name metric value stream_value),
  ur as (unpivot (select attempt, {", ".join(f"{m}::double as {m}" for m in A.METRICS)} from res) on {METRIC_SQL} into name metric value result_value),
  ms as (select attempt, m.metric from acc cross join (values {", ".join(f"('{m}')" for m in A.METRICS)}) m(metric)),
  rec as (select attempt, metric, stream_value, result_value, case when stream_value is null and result_value is null then 'missing' when stream_value is null then 'missing_stream' when result_value is null then 'missing_result'
    when abs(stream_value - result_value) < 1e-6 then 'match' else 'mismatch' end as state from ms left join us using (attempt, metric) left join ur using (attempt, metric)),
  cs as (select acc.attempt, unnest([{{'m': 'model_identity', 's': case when r.identified then 'result' end, 'w': case when r.attempt is not null then 'identity incomplete' else 'no result' end}},
    {{'m': 'tokens', 's': case when coalesce({", ".join(f"acc.{x}_tokens" for x in A.TOKENS)}) is not null then 'stream' when coalesce(r.input_tokens, r.output_tokens) is not null then 'result' end, 'w': 'no tokens seen'}},
    {{'m': 'cost', 's': case when acc.cost is not null then 'stream' when r.cost is not null then 'result' end, 'w': 'no price seen'}}, {{'m': 'tool_calls', 's': case when unattributed = 0 then 'stream' end, 'w': 'events without a source'}},
    {{'m': 'turns', 's': case when acc.turns is not null then 'stream' end, 'w': 'no turns seen'}}]) as x from acc left join res r using (attempt)),
  cv as (select attempt, x.m as metric, x.s is not null as observed, coalesce(x.s, 'absent') as source, case when x.s is null then x.w end as reason from cs),
  bd as (select attempt, count(*) as n from rec where state = 'mismatch' group by 1), ub as (select attempt, count(*) as n from cv where not observed group by 1),
  con as (select acc.attempt, case when violations > 0 or bd.n > 0 then 'violation' when acc.attempt % 7 = 0 then 'missing' when ub.n > 0 then 'partial' else 'ok' end as state from acc left join bd using (attempt) left join ub using (attempt))"""


def results(report):
    """What executors declared: some attempts have no result, some disagree, some lack a metric or an identity."""
    a = F.col("attempt")
    changed = {"model_calls": F.when(a % 5 == 0, F.col("model_calls") + 1).otherwise(F.col("model_calls")), "turns": F.when(a % 3 != 0, F.col("turns"))}
    return report.where(a % 7 != 0).select("attempt", (a % 4 != 1).alias("identified"), *[changed.get(m, F.col(m)).alias(m) for m in A.METRICS])


@query(f"with {EV_SQL} select event_id, origin, violation from cl")
def classify_events(spark, sf_dir):
    return A.classify(events(spark, sf_dir)).select("event_id", "origin", "violation")


@query(f"with {ACC_SQL} select * from acc")
def stream_accounting(spark, sf_dir):
    return A.account(events(spark, sf_dir))


@query(f"with {ACC_SQL} select attempt, facet, name, n, first, last from fc")
def stream_facets(spark, sf_dir):
    """Calls by tool, errors by class, stops by reason and costs by currency, a row each."""
    return A.facets(A.counted(events(spark, sf_dir)))


PRICES = [(m, f, p * k) for m, p in (("m1", 1.5), ("m2", 3.0), ("m3", 0.25)) for f, k in (("input", 1.0), ("output", 4.0), ("cache_read", 0.5))]
PRICE_SQL = ", ".join(f"('{m}', '{f}', {p}::double)" for m, f, p in PRICES)


@query(f"""with {EV_SQL}, pr(tool, field, per_million) as (values {PRICE_SQL}), tk as (unpivot (select attempt, event_id, tool, {", ".join(A.TOKENS)} from cal) on {", ".join(A.TOKENS)} into name field value tokens),
    j as (select tk.attempt, tokens, per_million from tk left join pr using (tool, field)), s as (select attempt, sum(tokens * per_million / 1e6) as c, count(*) filter (per_million is null and tokens > 0) as unpriced from j group by 1)
    select attempt, case when coalesce(unpriced, 0) = 0 then round(c, 9) end as cost, coalesce(unpriced, 0) as unpriced from (select distinct attempt from cal) left join s using (attempt)""")
def call_cost(spark, sf_dir):
    """The tool's name stands for the model; some models and fields have no price."""
    return A.call_cost(events(spark, sf_dir), spark.createDataFrame(PRICES, "model string, field string, per_million double"))


CEILING_SQL = f"""with {EV_SQL}, r as (select attempt, event_id, seconds - min(seconds) over w as w, count(*) filter (kind = 'tool_call') over w as c, count(*) filter (kind = 'turn') over w as t from ev window w as (partition by attempt order by event_id rows unbounded preceding)),
    h as (select attempt, event_id, case when w > 2000000 then 'wall_s' when c > 8 then 'tool_calls' when t > 9 then 'turns' end as reason from r)
    select attempt, min(event_id) as event_id, arg_min(reason, event_id) as reason from h where reason is not null group by 1"""


@query(CEILING_SQL)
def ceiling_hit(spark, sf_dir):
    return A.ceiling_hit(events(spark, sf_dir), 2_000_000, 8, 9)


@query(f"with {RESULT_SQL} select * from rec")
def reconcile(spark, sf_dir):
    r = A.account(events(spark, sf_dir))
    return A.reconcile(r, results(r))


@query(f"with {RESULT_SQL} select * from cv")
def coverage(spark, sf_dir):
    r = A.account(events(spark, sf_dir))
    return A.coverage(r, results(r))


@query(f"with {RESULT_SQL} select * from con")
def assess_contract(spark, sf_dir):
    r = A.account(events(spark, sf_dir))
    return A.contract_state(r, A.reconcile(r, results(r)), A.coverage(r, results(r)), results(r))


@query(f"""with {RESULT_SQL} select attempt, case when attempt % 11 = 0 then 'infrastructure_only' when state in ('ok', 'partial') then 'real' when state = 'missing' then 'unverified' else 'contract_violation' end as evidence_class,
    case when attempt % 11 = 0 then 'dry' when state = 'violation' then 'contract_violation' when attempt % 6 = 0 then 'stopped:turns' when attempt % 4 <> 0 then 'failed' when attempt % 8 = 0 then 'no_patch' else 'finished' end as outcome from con""")
def evidence_class(spark, sf_dir):
    c, a = assess_contract(spark, sf_dir), F.col("attempt")
    kind = F.when(a % 11 == 0, "dry").otherwise("external")
    outcome = A.outcome(kind, F.col("state"), F.when(a % 6 == 0, "turns"), a % 4, F.when(a % 8 == 0, 0).otherwise(120))
    return c.select("attempt", A.evidence_class(kind, F.col("state")).alias("evidence_class"), outcome.alias("outcome"))


@query("""select event_id, 'a' as provider, json_extract_string(props, '$.k')::double as input_tokens, null::double as cache_tokens from events where event_type in ('purchase', 'click')
    union all select event_id, 'b', value, json_extract_string(props, '$.k')::double from events where event_type not in ('purchase', 'click')""")
def normalise_provider(spark, sf_dir):
    """Two response shapes, as JSON, become one kind of event; what a shape doesn't have stays null."""
    e = table(spark, sf_dir, "events")
    a = e.where(F.col("event_type").isin("purchase", "click")).select("event_id", F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("double").alias("prompt_tokens")).alias("usage"))).alias("body"))
    b = e.where(~F.col("event_type").isin("purchase", "click")).select("event_id", F.to_json(F.struct(F.struct(F.col("value").alias("input_tokens"), F.get_json_object("props", "$.k").cast("double").alias("cache_read")).alias("usage"))).alias("body"))
    a = a.select("event_id", F.lit("a").alias("provider"), F.from_json("body", "usage struct<prompt_tokens: double>").alias("d")).select("event_id", "provider", F.col("d.usage.prompt_tokens").alias("input_tokens"))
    b = b.select("event_id", F.lit("b").alias("provider"), F.from_json("body", "usage struct<input_tokens: double, cache_read: double>").alias("d"))
    b = b.select("event_id", "provider", F.col("d.usage.input_tokens").alias("input_tokens"), F.col("d.usage.cache_read").alias("cache_tokens"))
    return b.unionByName(a, allowMissingColumns=True).select("event_id", "provider", "input_tokens", "cache_tokens")


def event_folder(spark, sf_dir, which=None, path=None):
    """The events (or some) as a folder of JSON files, one more file with a malformed and an incomplete line."""
    path, e = path or fresh_path(spark, "events"), events(spark, sf_dir)
    (e if which is None else e.where(which)).repartition(4, "attempt").write.mode("append").json(path)
    spark.createDataFrame([('{"attempt": 1, "kind":',), ('{"attempt": "x"',)], "value string").coalesce(1).write.mode("append").text(path)
    return path


@query(f"with {ACC_SQL} select * from acc")
def stream_accounting_ss(spark, sf_dir):
    """The same accounting by Structured Streaming over a folder of JSON files, in two runs that share their state."""
    from spanlake.streaming import accounting as S

    path = event_folder(spark, sf_dir, F.col("event_id") <= table(spark, sf_dir, "events").agg(F.median("event_id")).first()[0])
    S.run_available(S.accounted(S.event_stream(spark, path)), f"{path}-out", f"{path}-state", "update")
    event_folder(spark, sf_dir, F.col("event_id") > table(spark, sf_dir, "events").agg(F.median("event_id")).first()[0], path)
    S.run_available(S.accounted(S.event_stream(spark, path)), f"{path}-out", f"{path}-state", "update")
    return S.latest(spark, f"{path}-out")


@query(CEILING_SQL)
def ceiling_stream(spark, sf_dir):
    """Attempts that exceed a ceiling, found by the stream; all events come in one batch, as files have no order."""
    from spanlake.streaming import accounting as S

    path = event_folder(spark, sf_dir)
    S.run_available(S.ceilings(S.event_stream(spark, path), 2_000_000, 8, 9), f"{path}-out", f"{path}-state")
    return spark.read.option("basePath", f"{path}-out").parquet(f"{path}-out").drop("batch")


MSG_SQL = """m as (select conv_id, turn, role, text, greatest(1, length(coalesce(text, '')) // 4)::int as tokens, case when role <> 'system' then sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding) end as unit from conversations),
    us as (select conv_id, unit, count(*) as s from m where unit is not null group by 1, 2), ut as (select *, sum(s) over (partition by conv_id order by unit desc) - s as aft, sum(s) over (partition by conv_id order by unit) - s as bef from us)"""


@query(f"with {MSG_SQL} select conv_id, turn, role, tokens from m where unit is null or exists (select 1 from ut where ut.conv_id = m.conv_id and ut.unit = m.unit and aft < 3)")
def drop_old(spark, sf_dir):
    return H.tail(H.messages(table(spark, sf_dir, "conversations")), 3).select("conv_id", "turn", "role", "tokens")


CLIFF_SQL = f"""{MSG_SQL}, tt as (select conv_id, sum(tokens) as t from m group by 1), kp as (select m.* from m join tt using (conv_id) where t <= 300 or unit is null or exists (select 1 from ut where ut.conv_id = m.conv_id and ut.unit = m.unit and (aft < 2 or bef < 1))),
    gone as (select conv_id, min(turn) as turn, count(*) as n from m anti join kp using (conv_id, turn) group by 1),
    cf as (select conv_id, turn, role, tokens from kp union all select conv_id, turn, 'marker', 4 from gone)"""


@query(f"with {CLIFF_SQL} select conv_id, turn, role, tokens from cf")
def history_policy(spark, sf_dir):
    """Head, marker and tail for conversations above 300 tokens."""
    return H.cliff(H.messages(table(spark, sf_dir, "conversations")), 300, 1, 2).select("conv_id", "turn", "role", "tokens")


@query(f"""with {CLIFF_SQL} select conv_id, count(*) as messages, sum(tokens)::bigint as tokens, count(*) filter (role = 'marker') as markers,
    count(*) filter (role = 'assistant' and not exists (select 1 from cf x where x.conv_id = cf.conv_id and x.role = 'user' and x.turn < cf.turn)) as orphans from cf group by 1""")
def history_replay(spark, sf_dir):
    """Sizes of the histories that the policy leaves, and answers without any question before them."""
    h = H.cliff(H.messages(table(spark, sf_dir, "conversations")), 300, 1, 2)
    first = h.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("_q"))
    j = h.join(first, "conv_id", "left")
    orphan = (F.col("role") == "assistant") & (F.col("_q").isNull() | (F.col("_q") >= F.col("turn")))
    return j.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.count_if(F.col("role") == "marker").alias("markers"), F.count_if(orphan).alias("orphans"))
