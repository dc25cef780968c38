"""Queries on spans, budgets and whole contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import pack as P
from spanlake.plans.registry import LINES_SQL, corpus, query
from spanlake.plans.retrieve import BM25_SQL, ranked
from spanlake.sources.corpus import table, written

CTX, WIDE = 6, 20  # lines around a match, in a context and in an expansion
LOW_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

MATCH_SQL = f"""{LINES_SQL}, {BM25_SQL}, top as (select item_id, doc_id, rank::int as rank from bm where rank <= 20),
    tk as (select item_id, list_distinct(regexp_extract_all(translate(text, {LOW_SQL}), '[A-Za-z0-9_]+')) as l from benchmark),
    nl as (select doc_id, count(*)::int as n_lines from lines group by 1),
    mt as (select item_id, doc_id, rank, line from top join tk using (item_id) join lines using (doc_id) where len(list_filter(l, lambda t: contains(translate(lines.text, {LOW_SQL}), t))) > 0)"""


def spans_sql(name: str, ctx: int) -> str:
    return f"""{name}_f as (select *, case when line - lag(line) over (partition by item_id, doc_id order by line) <= {2 * ctx + 1} then 0 else 1 end as f from mt),
    {name}_r as (select *, sum(f) over (partition by item_id, doc_id order by line) as r from {name}_f),
    {name} as (select item_id, doc_id, rank, greatest(min(line) - {ctx}, 1)::int as "start", least(max(line) + {ctx}, any_value(n_lines))::int as "end" from {name}_r join nl using (doc_id) group by item_id, doc_id, rank, r)"""


SPAN_SQL = f"{MATCH_SQL}, {spans_sql('sp', CTX)}"
RR_SQL = f"""{SPAN_SQL}, sl as (select *, row_number() over (partition by item_id, doc_id order by "start")::int as slot, greatest(count(*) over (partition by item_id, doc_id) - 3, 0) as dropped from sp),
    rr as (select *, row_number() over (partition by item_id order by slot, rank)::int as position from sl where slot <= 3)"""
UNIT_SQL = f"""{RR_SQL}, un as (select rr.*, (select string_agg(text, chr(10) order by line) from lines l where l.doc_id = rr.doc_id and l.line between rr."start" and rr."end") as text from rr),
    u as (select *, strlen(text) + 64 as cost from un)"""


def matches(spark, sf_dir):
    """Lines of an item's 20 best documents that hold one of its tokens; these documents as arrays of lines, with their hash; and their ranks."""
    tokens = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(T.ascii_lower(F.col("text")))).alias("_t"))
    top = written(ranked(spark, sf_dir).select("item_id", "doc_id", "rank"), "top")
    docs = table(spark, sf_dir, "documents").join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = written(docs.select("doc_id", T.lines(F.coalesce("text", F.lit(""))).alias("lines"), T.content_hash(F.coalesce("text", F.lit(""))).alias("digest")), "candidates")
    low = docs.select("doc_id", F.posexplode(F.transform("lines", T.ascii_lower)).alias("_p", "text"))
    lines = top.join(tokens, "item_id").join(low, "doc_id")
    hit = lines.where(F.exists("_t", lambda t: F.contains(F.col("text"), t)))
    return written(hit.select("item_id", "doc_id", "rank", (F.col("_p") + 1).alias("line")), "matches"), docs.withColumn("n_lines", F.size("lines")), top


def spans(spark, sf_dir):
    found, docs, _ = matches(spark, sf_dir)
    return P.match_spans(found, docs, ["item_id", "doc_id", "rank"], ctx=CTX), docs


def units(spark, sf_dir):
    s, docs = spans(spark, sf_dir)
    u = P.unit_text(P.round_robin(s, "item_id", "doc_id", "rank"), docs)
    return u.withColumn("cost", F.octet_length("text") + P.UNIT_OVERHEAD)


@query(f'with {SPAN_SQL} select item_id, doc_id, "start", "end" from sp')
def match_spans(spark, sf_dir):
    return spans(spark, sf_dir)[0].select("item_id", "doc_id", "start", "end")


@query(f'with {RR_SQL} select item_id, doc_id, "start", "end", slot, dropped, position from rr')
def round_robin(spark, sf_dir):
    return P.round_robin(spans(spark, sf_dir)[0], "item_id", "doc_id", "rank").select("item_id", "doc_id", "start", "end", "slot", "dropped", "position")


@query(f"with {UNIT_SQL}, r as (select *, sum(cost) over (partition by item_id order by position)::bigint as used from u) select item_id, position, doc_id, used from r where used <= 6000")
def prefix_budget(spark, sf_dir):
    return P.prefix_budget(units(spark, sf_dir), "item_id", 6000).select("item_id", "position", "doc_id", "used")


@query(f"""with recursive {UNIT_SQL}, g as (select item_id, 0 as position, 0::bigint as used, []::int[] as kept, []::int[] as over from (select distinct item_id from u)
      union all select g.item_id, u.position, case when used + cost <= 6000 then used + cost else used end, case when used + cost <= 6000 then list_append(kept, u.position) else kept end,
        case when used + cost <= 6000 then over else list_append(over, u.position) end from g join u on u.item_id = g.item_id and u.position = g.position + 1)
    select item_id, used, array_to_string(kept, ',') as kept, array_to_string(over, ',') as over from g where position = (select max(position) from u where u.item_id = g.item_id)""")
def greedy_pack(spark, sf_dir):
    p = P.greedy_pack(units(spark, sf_dir), "item_id", 6000)
    return p.select("item_id", "used", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), F.array_join(F.transform("over", lambda x: x.cast("string")), ",").alias("over"))


@query(f"""with recursive {UNIT_SQL}, g as (select item_id, 0 as position, 0::bigint as used, 0::bigint as plain, []::int[] as kept from (select distinct item_id from u)
      union all select g.item_id, u.position, case when ok then used + cost else used end, case when ok and slot > 1 then plain + cost else plain end, case when ok then list_append(kept, u.position) else kept end
        from g join u on u.item_id = g.item_id and u.position = g.position + 1, lateral (select used + cost <= 6000 and (slot = 1 or plain + cost <= 4200) as ok) o)
    select item_id, used, plain as used_plain, array_to_string(kept, ',') as kept from g where position = (select max(position) from u where u.item_id = g.item_id)""")
def evidence_reserve(spark, sf_dir):
    """A file's first span counts as the lexical evidence for which 30 % are reserved."""
    p = P.evidence_reserve(units(spark, sf_dir).withColumn("lexical", F.col("slot") == 1), "item_id", 6000, 30)
    return p.select("item_id", "used", "used_plain", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


@query(f"""with {UNIT_SQL}, f as (select item_id, list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))), lambda x: length(x) >= 10) as terms from benchmark)
    select item_id, count(*) as n_units, sum(cost)::bigint as full_cost, count(*) filter (ok)::bigint as n_focused, coalesce(sum(cost) filter (ok), 0)::bigint as focused_cost
    from (select u.*, slot = 1 or len(list_filter(terms, lambda t: contains(translate(u.text, {LOW_SQL}), t))) > 0 as ok from u join f using (item_id)) group by 1""")
def focus_prune(spark, sf_dir):
    """A file's first span is its skeleton and stays; others stay if they hold a long term of the item."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.filter(T.focus_terms(F.col("text")), lambda t: F.length(t) >= 10).alias("_t"))
    u = units(spark, sf_dir).join(terms, "item_id").withColumn("ok", (F.col("slot") == 1) | F.exists("_t", lambda t: F.contains(T.ascii_lower(F.col("text")), t)))
    return u.groupBy("item_id").agg(F.count("*").alias("n_units"), F.sum("cost").alias("full_cost"), F.count_if("ok").alias("n_focused"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("cost"))), F.lit(0)).alias("focused_cost"))


# Delivered: for every span the lines from its second on, up to two.
COVER_SQL = f"""{SPAN_SQL}, cv as (select item_id, doc_id, "start" + 1 as "start", least("end", "start" + 2) as "end" from sp where "end" > "start")"""


def covered(s):
    return s.where("end > start").select("item_id", "doc_id", (F.col("start") + 1).alias("start"), F.least("end", F.col("start") + 2).alias("end"))


@query(f"""with {COVER_SQL}, own as (select distinct item_id, doc_id, unnest(range("start", "end" + 1))::int as line from sp), cl as (select distinct item_id, doc_id, unnest(range("start", "end" + 1))::int as line from cv),
    lf as (select * from own except select * from cl), g as (select *, line - row_number() over (partition by item_id, doc_id order by line) as g from lf)
    select item_id, doc_id, min(line) as "start", max(line) as "end" from g group by item_id, doc_id, g""")
def subtract_covered(spark, sf_dir):
    s = spans(spark, sf_dir)[0]
    return P.subtract_covered(s, covered(s), ["item_id", "doc_id"])


@query(f"""with {COVER_SQL} select sp.item_id, sp.doc_id, sp."start", sp."end", cv."start" as b_start, cv."end" as b_end from sp join cv on sp.item_id = cv.item_id and sp.doc_id = cv.doc_id and sp."start" <= cv."end" and cv."start" <= sp."end" """)
def span_overlap(spark, sf_dir):
    s = spans(spark, sf_dir)[0]
    return P.overlaps(s, covered(s), ["item_id", "doc_id"])


DECL_SQL = f"{LINES_SQL}, decl as (select doc_id, line, regexp_extract(text, '^(T[a-z]+)', 1) as name from lines where regexp_matches(text, '^T[a-z]'))"


@query(f"with {DECL_SQL} select l.doc_id, l.line, d.name, d.line as decl_line from lines l asof left join decl d on l.doc_id = d.doc_id and l.line >= d.line")
def enclosing_decl(spark, sf_dir):
    """Lines that begin with a capital T and a letter count as declarations."""
    lines = corpus(spark, sf_dir)[1]
    decl = lines.where(F.col("text").rlike("^T[a-z]")).select("doc_id", "line", F.regexp_extract("text", "^(T[a-z]+)", 1).alias("name"))
    return P.enclosing(lines, decl)


@query("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 3")
def topk_per_key(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("_r")).where("_r <= 3").drop("_r")


@query(f"""with {MATCH_SQL}, f as (select item_id, doc_id, rank, min(line) as m from mt group by 1, 2, 3)
    select item_id, doc_id, greatest(m - 2, 1)::int as "start", least(m + 2, n_lines)::int as "end", row_number() over (partition by item_id order by rank)::int as position from f join nl using (doc_id)""")
def context_lex(spark, sf_dir):
    """One unit for each file, around its first match."""
    found, docs, _ = matches(spark, sf_dir)
    first = found.groupBy("item_id", "doc_id", "rank").agg(F.min("line").alias("m")).join(docs.select("doc_id", "n_lines"), "doc_id")
    return first.select("item_id", "doc_id", F.greatest(F.col("m") - 2, F.lit(1)).alias("start"), F.least(F.col("m") + 2, F.col("n_lines")).alias("end"), F.row_number().over(Window.partitionBy("item_id").orderBy("rank")).alias("position"))


# What an index holds and what the files hold now; an index that lacks some files and is older than others.
DISK_SQL = """ds as (select doc_id, case when doc_id % 31 = 4 then null when doc_id % 29 = 3 then 'old' else sha256(coalesce(text, '')) end as known, sha256(coalesce(text, '')) as current from documents)"""


def disk(docs):
    """(doc_id, known, current) of candidates: the hash in the index, null if it lacks the file, and the file's own."""
    i, h = F.col("doc_id"), F.col("digest")
    return docs.select(i, F.when(i % 31 == 4, None).when(i % 29 == 3, "old").otherwise(h).alias("known"), h.alias("current"))


DROP_SQL = f"""{DISK_SQL}, mh as (select distinct item_id, doc_id from mt),
    vs as (select t.item_id, t.doc_id, t.rank, current, case when known is null then 'not_indexed' when known <> current then 'stale_source' when mh.doc_id is null then 'no_literal_match' else 'verified' end as state from top t join ds using (doc_id) left join mh using (item_id, doc_id))"""


def verified(docs, top, found):
    """The candidates and why they are left out, or ``verified``: by the index's hash and the file's, then by a literal match."""
    has = found.select("item_id", "doc_id").distinct().withColumn("_m", F.lit(True))
    j = top.join(disk(docs), "doc_id").join(has, ["item_id", "doc_id"], "left")
    state = F.when(F.col("known").isNull(), "not_indexed").when(F.col("known") != F.col("current"), "stale_source").when(F.col("_m").isNull(), "no_literal_match").otherwise("verified")
    return j.select("item_id", "doc_id", "rank", "current", state.alias("state"))


@query(f"""with {MATCH_SQL}, {DROP_SQL} select item_id, state, count(*) as n from vs group by 1, 2""")
def context_drops(spark, sf_dir):
    """Why candidates are left out."""
    found, docs, top = matches(spark, sf_dir)
    return verified(docs, top, found).groupBy("item_id", "state").agg(F.count("*").alias("n"))


def digits(c: str) -> str:
    return f"length(({c})::bigint::varchar)"


def settled_sql(c: str) -> str:
    out = c
    for _ in range(4):
        out = f"({c} + {digits(out)} + {digits(f'({out}) // 4')})"
    return out


def unit_bytes_sql(text: str, end: str, cut: str) -> str:
    return f"""strlen('{{"file":"","line":,"end_line":,"hash":"","text":,"evidence":,"reason":,"truncated":}}') + length(file) + {digits('"start"')} + {digits(end)} + length(digest) + strlen(to_json({text})::varchar) + strlen(to_json(evidence)::varchar) + strlen(to_json(reason)::varchar) + {4 if cut == 'true' else 5}"""


def deliver_sql(tokens: int, most: int) -> str:
    """The twin of ``pack.deliver`` over the tables ``un`` (units) and ``ba`` (a row for each item)."""
    fixed = len(P.ENVELOPE.format(state="", tokens=tokens, bytes=most, n="", reasons="", hints=""))
    listed = lambda a: f"(strlen(to_json({a})::varchar) - 2)"
    size = lambda state, n, reasons, hints, units: settled_sql(f"({fixed} + length({state}) + {digits(n)} + {listed(reasons)} + {listed(hints)} + {units})")
    return f"""uj as (select *, {unit_bytes_sql("text", '"end"', "false")} as len from un), na as (select item_id, count(*) as al from uj group by 1), bb as (select ba.*, coalesce(al, 0) as al from ba left join na using (item_id)),
    pf as (select item_id, position as k, sum(len) over (partition by item_id order by position) + position - 1 as ub from uj union all select item_id, 0, 0 from bb),
    nx as (select pf.item_id, k, ub, coalesce((select list(file order by position) from uj where uj.item_id = pf.item_id and uj.position > k and uj.position <= k + 6), []) as nx from pf),
    c1 as (select nx.*, bb.* exclude (item_id), dropped + al - k as om, list_sort(list_distinct(case when k < al then list_append(reasons, 'budget') else reasons end)) as rs, list_concat(hints, list_transform(nx, lambda f: 'expand: ' || f))[1:5] as hh from nx join bb using (item_id)),
    c2 as (select * exclude (hh), case when al = 0 and len(reasons) = 0 and len(hh) = 0 then ['no match: widen the query'] else hh end as hs, case when stale then 'stale' when om > 0 or len(rs) > 0 then 'partial' else 'ok' end as state from c1),
    c3 as (select *, {size("state", "om", "rs", "hs", "ub")}::bigint as used from c2), c4 as (select *, used <= {most} and used // 4 <= {tokens} as fits from c3),
    bst as (select * from (select *, row_number() over (partition by item_id order by case when fits then k else -1 end desc, k) as rn from c4) where rn = 1),
    p1 as (select b.item_id, b.k, b.al, b.ub, b.dropped, b.reasons, b.hints, b.stale, b.nx, uj.* exclude (item_id, position, len), string_split(text, chr(10)) as ls, unnest([3, 2, 1]) as q from bst b join uj on uj.item_id = b.item_id and uj.position = b.k + 1 where fits and b.k < al),
    p2 as (select *, (len(ls) * q) // 4 as keep from p1), p3 as (select *, array_to_string(ls[1:keep], chr(10)) as ct, ("start" + keep - 1)::int as cut_end from p2 where keep > 0 and keep < len(ls)),
    p4 as (select *, ub + {unit_bytes_sql("ct", "cut_end", "true")} + (k > 0)::int as ub2, dropped + al - k - 1 as om, list_sort(list_distinct(list_append(reasons, 'budget'))) as rs, list_concat(hints, list_transform(nx[2:6], lambda f: 'expand: ' || f))[1:5] as hs, case when stale then 'stale' else 'partial' end as state from p3),
    p5 as (select *, {size("state", "om", "rs", "hs", "ub2")}::bigint as used from p4), p6 as (select * from (select *, row_number() over (partition by item_id order by keep desc) as rn from p5 where used <= {most} and used // 4 <= {tokens}) where rn = 1),
    lo as (select item_id, list_sort(list_distinct(list_append(reasons, 'envelope_too_large'))) as rs, case when stale then 'stale' else 'partial' end as state, dropped as om, ['budget below the empty response; raise it'] as hs from bst where not fits), l2 as (select *, {size("state", "om", "rs", "hs", "0")}::bigint as used from lo),
    delivered as (select item_id, state, k::int as n_units, used as used_bytes, used // 4 as used_tokens, om::bigint as omitted, array_to_string(rs, ',') as reasons, array_to_string(hs, ' | ') as hints, null::int as cut_end from bst where fits and item_id not in (select item_id from p6)
      union all select item_id, state, (k + 1)::int, used, used // 4, om::bigint, array_to_string(rs, ','), array_to_string(hs, ' | '), cut_end from p6 union all select item_id, state, 0, used, used // 4, om::bigint, array_to_string(rs, ','), array_to_string(hs, ' | '), null from l2)"""


BASE_SQL = """ba as (select b.item_id, coalesce(d.n, 0) as dropped, coalesce(d.reasons, []::varchar[]) as reasons, list_concat(case when d.stale then ['index out of date; index again'] else []::varchar[] end, coalesce(d.refs, []::varchar[]))[1:5] as hints, coalesce(d.stale, false) as stale from benchmark b left join
      (select item_id, sum(n) as n, list_sort(list_distinct(list(reason))) as reasons, coalesce(list('expand: ' || doc_id order by rank) filter (doc_id is not null), [])[1:5] as refs, bool_or(reason in ('not_indexed', 'stale_source')) as stale from dr group by 1) d using (item_id))"""


def base(spark, sf_dir, dropped):
    """What is said of candidates left out before the budget; ``dropped`` has item_id, rank, doc_id (null: none to name), reason, n."""
    refs = F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("rank", F.concat(F.lit("expand: "), F.col("doc_id").cast("string")).alias("h"))))), lambda x: x["h"]), 1, 5)
    d = dropped.groupBy("item_id").agg(F.sum("n").alias("dropped"), F.array_sort(F.collect_set("reason")).alias("reasons"), refs.alias("hints"), F.bool_or(F.col("reason").isin("not_indexed", "stale_source")).alias("stale"))
    none = F.expr("cast(array() as array<string>)")
    j = table(spark, sf_dir, "benchmark").select("item_id").join(d, "item_id", "left")
    return j.select("item_id", F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("reasons", none).alias("reasons"), F.slice(F.concat(F.when(F.col("stale"), F.array(F.lit("index out of date; index again"))).otherwise(none), F.coalesce("hints", none)), 1, 5).alias("hints"), F.coalesce("stale", F.lit(False)).alias("stale"))


# evidence: the first five tokens of the item, as written, that stand in the unit
EVIDENCE_SQL = f"""tv as (select item_id, list_filter(l, lambda x, i: list_position(l, x) = i) as tv from (select item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') as l from benchmark))"""
EVIDENCE_OF = f"'tokens=' || array_to_string(list_filter(tv, lambda t: contains(translate(text, {LOW_SQL}), translate(t, {LOW_SQL})))[1:5], ',')"


def with_evidence(spark, sf_dir, units):
    t = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("_tv"), F.transform(T.tokens(F.col("text")), T.ascii_lower).alias("_tl"))
    low = units.join(F.broadcast(t) if t.count() <= 10_000 else t, "item_id").withColumn("_low", T.ascii_lower(F.col("text")))
    there = lambda tokens: F.filter(tokens, lambda x, i: F.contains(F.col("_low"), F.get("_tl", i)))
    early = there(F.slice("_tv", 1, 8))  # mostly five of these stand there, and the others needn't be looked for
    present = F.slice(F.when(F.size(early) >= 5, early).otherwise(there(F.col("_tv"))), 1, 5)
    return low.withColumn("evidence", F.concat(F.lit("tokens="), F.array_join(present, ","))).drop("_tv", "_tl", "_low")


TOKENS, BYTES = 2000, 7000
CONTEXT_SQL = f"""{MATCH_SQL}, {spans_sql("sp0", CTX)}, {DROP_SQL}, sp as (select sp0.*, current from sp0 join vs using (item_id, doc_id) where state = 'verified'),
    sl as (select *, row_number() over (partition by item_id, doc_id order by "start")::int as slot, count(*) over (partition by item_id, doc_id) as ns from sp),
    rr as (select *, row_number() over (partition by item_id order by slot, rank)::int as position from sl where slot <= 3),
    ux as (select rr.item_id, position, rr.doc_id::varchar as file, rr."start", rr."end", current as digest, (select string_agg(text, chr(10) order by line) from lines l where l.doc_id = rr.doc_id and l.line between rr."start" and rr."end") as text,
      'rank ' || rank || '; ' || (select count(*) from mt where mt.item_id = rr.item_id and mt.doc_id = rr.doc_id and mt.line between rr."start" and rr."end") || ' matches' as reason from rr),
    {EVIDENCE_SQL}, un as (select ux.*, {EVIDENCE_OF} as evidence from ux join tv using (item_id)),
    dr as (select item_id, rank, doc_id, state as reason, 1 as n from vs where state <> 'verified' union all select item_id, null, null, 'diversity_cap', sum(greatest(ns - 3, 0)) from sl where slot = 1 group by 1 having sum(greatest(ns - 3, 0)) > 0),
    {BASE_SQL}"""


def context(spark, sf_dir):
    """The units of each item in order, and what was left out before the budget."""
    found, docs, top = matches(spark, sf_dir)
    checked = written(verified(docs, top, found), "checked")
    s = written(P.match_spans(found, docs, ["item_id", "doc_id", "rank"], ctx=CTX).join(checked.where("state = 'verified'").select("item_id", "doc_id", "current"), ["item_id", "doc_id"]), "spans")
    per = s.groupBy("item_id", "doc_id").agg(F.greatest(F.count("*") - 3, F.lit(0)).alias("n")).groupBy("item_id").agg(F.sum("n").alias("n")).where("n > 0")
    capped = per.select("item_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit("diversity_cap").alias("reason"), "n")
    dropped = checked.where("state <> 'verified'").select("item_id", "rank", "doc_id", F.col("state").alias("reason"), F.lit(1).cast("long").alias("n")).unionByName(capped)
    chosen = P.round_robin(s, "item_id", "doc_id", "rank").drop("dropped")
    inside = chosen.join(found.select("item_id", "doc_id", "line"), ["item_id", "doc_id"]).where("line between start and end").groupBy("item_id", "position").agg(F.count("*").alias("_m"))
    u = P.unit_text(chosen, docs).join(inside, ["item_id", "position"])
    u = u.select("item_id", "position", F.col("doc_id").alias("file"), "start", "end", F.col("current").alias("digest"), "text", F.format_string("rank %d; %d matches", F.col("rank"), F.col("_m")).alias("reason"))
    return with_evidence(spark, sf_dir, u), base(spark, sf_dir, dropped)


@query(f"with {CONTEXT_SQL}, {deliver_sql(TOKENS, BYTES)} select * from delivered")
def context_ctx(spark, sf_dir):
    """The whole answer: verified candidates, clusters, round robin, and the largest serialised response within both budgets."""
    return P.deliver(*context(spark, sf_dir), "item_id", TOKENS, BYTES)


@query(f"with {CONTEXT_SQL}, {deliver_sql(60, 7000)} select * from delivered")
def context_small(spark, sf_dir):
    """A budget that only some empty responses fit."""
    return P.deliver(*context(spark, sf_dir), "item_id", 60, 7000)


# Delivered: for every span the lines from its second on, up to two.  Known references of an expansion: an item's best
# document with three lines from its first match on (this much was delivered), and its second best without a line.
EXPAND_SQL = f"""{MATCH_SQL}, {spans_sql("sq", WIDE)}, ds as (select doc_id, sha256(coalesce(text, '')) as current, case when doc_id % 4 = 0 then 'test/' else 'src/' end || doc_id as path from documents),
    kn as (select item_id, ['context', 'references', 'tests'][1 + item_id % 3] as kind from benchmark), f1 as (select item_id, doc_id, rank, min(line) as m from mt group by 1, 2, 3),
    od as (select t.item_id, t.doc_id, t.rank, kind, current, m, n_lines, case when rank = 1 then m end as s, rank <= 2 as given from top t join kn using (item_id) join ds using (doc_id) join nl using (doc_id) left join f1 using (item_id, doc_id, rank) where rank <= 2 or kind = 'references' or kind = 'tests' and path like '%test%'),
    dv as (select item_id, doc_id, s as a, least(s + 2, n_lines) as b from od where s is not null),
    wl as (select item_id, doc_id, unnest(range(greatest(s - 20, 1), least(s + 2 + 20, n_lines) + 1))::int as line, greatest(s - 20, 1) as z from od where s is not null),
    wc as (select wl.*, (line - z) // 60 as sid from wl where not exists (select 1 from dv where dv.item_id = wl.item_id and dv.doc_id = wl.doc_id and line between a and b)),
    wg as (select *, line - row_number() over (partition by item_id, doc_id, sid order by line) as g from wc), wi as (select item_id, doc_id, sid, min(line)::int as "start", max(line)::int as "end" from wg group by item_id, doc_id, sid, g),
    mx as (select item_id, 'lexical' as o from kn),
    wu as (select wi.item_id, wi.doc_id, "start", "end", row_number() over (partition by wi.item_id order by "start")::int as p, kind, current, (select string_agg(text, chr(10) order by line) from lines l where l.doc_id = wi.doc_id and l.line between wi."start" and wi."end") as text,
      (select count(*) from mt where mt.item_id = wi.item_id and mt.doc_id = wi.doc_id and mt.line between wi."start" and wi."end") as m from wi join od using (item_id, doc_id)),
    {EVIDENCE_SQL}, wv as (select wu.item_id, doc_id, doc_id::varchar as file, "start", "end", p, kind, current as digest, text, 'known' || case when m > 0 then '; ' || m || ' matches' else '; wider window' end as reason, {EVIDENCE_OF} as evidence from wu join tv using (item_id)),
    ww as (select *, {unit_bytes_sql("text", '"end"', "false")} as cost from wv),
    wr as (select item_id, 0 as p, 0::bigint as used, []::int[] as kept from (select distinct item_id from ww) union all
      select wr.item_id, ww.p, case when kind = 'context' or used + cost <= 4900 then used + cost else used end, case when kind = 'context' or used + cost <= 4900 then list_append(kept, ww.p) else kept end from wr join ww on ww.item_id = wr.item_id and ww.p = wr.p + 1),
    wk as (select item_id, kept from wr where p = (select max(p) from ww where ww.item_id = wr.item_id)), w2 as (select ww.*, list_contains(kept, p) as ok from ww join wk using (item_id)),
    ll as (select sq.item_id, sq.doc_id, sq."start" as sid, unnest(range(sq."start", sq."end" + 1))::int as line from sq join od using (item_id, doc_id) where s is null or kind <> 'context'),
    lc as (select * from ll where not exists (select 1 from dv where dv.item_id = ll.item_id and dv.doc_id = ll.doc_id and line between a and b) and not exists (select 1 from w2 where ok and w2.item_id = ll.item_id and w2.doc_id = ll.doc_id and line between w2."start" and w2."end")),
    lg as (select *, line - row_number() over (partition by item_id, doc_id, sid order by line) as g from lc), li as (select item_id, doc_id, min(line)::int as "start", max(line)::int as "end" from lg group by item_id, doc_id, sid, g),
    lu as (select li.item_id, li.doc_id, "start", "end", od.rank, current, case when s is null and given then 'known' else 'lexical:' || kind end as o, (select string_agg(text, chr(10) order by line) from lines l where l.doc_id = li.doc_id and l.line between li."start" and li."end") as text,
      (select count(*) from mt where mt.item_id = li.item_id and mt.doc_id = li.doc_id and mt.line between li."start" and li."end") as m from li join od using (item_id, doc_id)),
    lv as (select lu.item_id, rank, 1 as grp, doc_id::varchar as file, "start", "end", current as digest, text, o || case when m > 0 then '; ' || m || ' matches' else '; wider window' end as reason, {EVIDENCE_OF} as evidence from lu join tv using (item_id)),
    ea as (select item_id, 1 as rank, 0 as grp, file, "start", "end", digest, text, reason, evidence from w2 where ok union all select * from lv),
    un as (select * exclude (rank, grp), row_number() over (partition by item_id order by rank, grp, "start")::int as position from ea),
    dr as (select item_id, rank, doc_id, 'no_literal_match' as reason, 1::bigint as n from od where m is null union all select item_id, 1, null, 'evidence_reserved', count(*) from w2 where not ok group by 1
      union all select item_id, rank, null, 'duplicate', 1 from od where m is not null and not exists (select 1 from ea where ea.item_id = od.item_id and ea.file = od.doc_id::varchar) and not exists (select 1 from w2 where w2.item_id = od.item_id and w2.doc_id = od.doc_id and not ok)),
    {BASE_SQL}"""


def expansion(spark, sf_dir, max_bytes: int, reserve_pct: int):
    """Units around known references and, if evidence is wanted, at the matches; nothing that was delivered or is emitted before."""
    found, docs, top = matches(spark, sf_dir)
    keys, i = ["item_id", "doc_id"], F.col("item_id")
    kind = F.get(F.array(F.lit("context"), F.lit("references"), F.lit("tests")), (i % 3).cast("int")).alias("kind")
    d = F.col("doc_id")
    path = F.concat(F.when(d % 4 == 0, "test/").otherwise("src/"), d.cast("string"))
    order = top.select("item_id", "doc_id", "rank", kind).where((F.col("rank") <= 2) | (F.col("kind") == "references") | (F.col("kind") == "tests") & T.is_test_path(path))
    first = found.groupBy(*keys).agg(F.min("line").alias("m"))
    order = order.join(docs.select("doc_id", "n_lines", "digest"), "doc_id").join(first, keys, "left")
    order = written(order.withColumn("s", F.when(F.col("rank") == 1, F.col("m"))), "order")
    asked = order.where("s is not null")
    low, high = F.greatest(F.col("s") - WIDE, F.lit(1)), F.least(F.col("s") + 2 + WIDE, F.col("n_lines"))
    had = asked.select(*keys, F.explode(F.sequence("s", F.least(F.col("s") + 2, F.col("n_lines")))).alias("line"))
    window = asked.select(*keys, low.alias("z"), F.explode(F.sequence(low, high)).alias("line")).join(had, [*keys, "line"], "left_anti")
    window = P.islands(window.withColumn("sid", F.expr("(line - z) div 60")), [*keys, "sid"]).drop("sid")

    def as_units(s, origin):
        """Adds text, evidence and reason; ``s`` has start, end and all of ``order``."""
        n = s.join(found.select(*keys, "line"), keys).where("line between start and end").groupBy(*keys, "start").agg(F.count("*").alias("_m"))
        u = P.unit_text(s, docs).join(n, [*keys, "start"], "left")
        u = u.withColumn("reason", F.concat(origin, F.when(F.col("_m").isNotNull(), F.format_string("; %d matches", F.col("_m"))).otherwise("; wider window"))).withColumn("file", d.cast("string"))
        return with_evidence(spark, sf_dir, u)

    facts = order.select(*keys, "rank", "kind", "digest", "s")
    w = as_units(window.join(facts, keys), F.lit("known"))
    cost = F.octet_length(P.unit_json(F.col("file"), F.col("start"), F.col("end"), F.col("digest"), F.col("text"), F.col("evidence"), F.col("reason"), F.lit(False)))
    w = w.withColumn("cost", F.when(F.col("kind") == "context", 0).otherwise(cost)).withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy("start")))
    w = written(w, "windows")
    kept = P.greedy_pack(w, "item_id", max_bytes * (100 - reserve_pct) // 100).select("item_id", F.explode("kept").alias("position"))
    windows, reserved = w.join(kept, ["item_id", "position"], "left_semi"), w.join(kept, ["item_id", "position"], "left_anti")
    lexical = P.match_spans(found, docs, [*keys, "rank"], ctx=WIDE).join(facts.select(*keys, "kind", "s"), keys).where("s is null or kind <> 'context'")
    line = lexical.select(*keys, F.col("start").alias("sid"), F.explode(F.sequence("start", "end")).alias("line"))
    gone = had.unionByName(windows.select(*keys, F.explode(F.sequence("start", "end")).alias("line")))
    rest = P.islands(line.join(gone, [*keys, "line"], "left_anti"), [*keys, "sid"]).drop("sid")
    lex = as_units(rest.join(facts, keys), F.when(F.col("s").isNull() & (F.col("rank") <= 2), "known").otherwise(F.concat(F.lit("lexical:"), F.col("kind"))))
    cols = ["item_id", "rank", "file", "start", "end", "digest", "text", "evidence", "reason"]
    units = windows.select(*cols, F.lit(0).alias("grp")).unionByName(lex.select(*cols, F.lit(1).alias("grp")))
    units = written(units.withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy("rank", "grp", "start"))), "units")
    out = ["item_id", "rank", "doc_id", "reason", "n"]
    none, one = F.lit(None).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n")
    lost = order.where("m is null").select("item_id", "rank", "doc_id", F.lit("no_literal_match").alias("reason"), one)
    held = reserved.groupBy("item_id").agg(F.count("*").alias("n")).select("item_id", F.lit(1).alias("rank"), none, F.lit("evidence_reserved").alias("reason"), "n")
    said = units.select("item_id", F.col("file").cast("long").alias("doc_id")).unionByName(reserved.select(*keys)).distinct()
    again = order.where("m is not null").join(said, keys, "left_anti").select("item_id", "rank", none, F.lit("duplicate").alias("reason"), one)
    return units, base(spark, sf_dir, lost.select(out).unionByName(held.select(out)).unionByName(again.select(out)))


@query(f"with recursive {EXPAND_SQL}, {deliver_sql(TOKENS, BYTES)} select * from delivered")
def expand_refs(spark, sf_dir):
    """Windows around known references and the matches beside them; 30 % of the bytes are reserved for evidence."""
    return P.deliver(*expansion(spark, sf_dir, BYTES, 30), "item_id", TOKENS, BYTES)
