"""Queries on generators, remaining predicates and packing details."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import extract as X
from spanlake.operators import fulltext
from spanlake.operators import generate as G
from spanlake.operators import measure as M
from spanlake.operators import pack as P
from spanlake.operators import verify as V
from spanlake.plans.measure import TOP_SQL, scored_sql
from spanlake.plans.pack import UNIT_SQL, units
from spanlake.plans.registry import FILES_SQL, SYMBOLS_SQL, corpus, query
from spanlake.plans.retrieve import BM25_SQL, CONT_SQL, ranked, truth
from spanlake.sources.corpus import document_files, fresh_path, table, written

@query(f"with {FILES_SQL} select path, size::bigint as size from files where module not in ('src3', 'src5')")
def nested_repos(spark, sf_dir):
    """The folders of two modules count as repositories of their own."""
    files = document_files(table(spark, sf_dir, "documents"))
    roots = spark.createDataFrame([("src/src3",), ("src/src5",)], "root string")
    return X.outside_nested(files, roots).select("path", F.col("size").cast("long").alias("size"))


@query(f"with {SYMBOLS_SQL} select name, kind, file, line, content_hash from symbols")
def symbol_scan(spark, sf_dir):
    return corpus(spark, sf_dir)[2].select("name", "kind", "file", "line", "content_hash").orderBy("file", "line")


@query("select page_id, regexp_matches(lower(url), 'test|spec') as is_test, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') as module, left(sha256(url), 12) as root_id from pages")
def path_facts(spark, sf_dir):
    """Whether a path looks like a test, its module, and the short id of a root."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.is_test_path(F.col("url")).alias("is_test"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/[^/]*$", "").alias("module"), F.left(F.sha2("url", 256), F.lit(12)).alias("root_id"))


@query("select doc_id, strlen(json_object('doc_id', doc_id, 'n_chars', n_chars)::varchar)::int as bytes, strlen(json_object('doc_id', doc_id, 'n_chars', n_chars)::varchar)::int // 4 as tokens from documents")
def payload_size(spark, sf_dir):
    j = F.to_json(F.struct("doc_id", "n_chars"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(j).alias("bytes"), T.byte_estimate(j).alias("tokens"))


@query("with recursive b as (select doc_id, n_chars as base, n_chars as n from documents union select doc_id, base, base + length(n::varchar) from b) select doc_id, base, max(n) as settled from b group by 1, 2")
def settle_budget(spark, sf_dir):
    """The size of a document that states its own size: two rounds reach the fixpoint, as digits grow by one at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("base"))
    digits = lambda c: F.length(c.cast("string"))
    once = F.col("base") + digits(F.col("base"))
    return d.select("doc_id", "base", (F.col("base") + digits(F.col("base") + digits(once))).alias("settled"))


@query(f"""with {UNIT_SQL}, r as (select *, sum(cost) over (partition by item_id order by position) as run from u), ct as (select item_id, min(position) as position from r where run > 2000 group by 1),
    c as (select r.item_id, r.position, r.doc_id, r."start", r."end", 2000 - (r.run - r.cost) as room, unnest([0.75, 0.5, 0.25]) as part from r join ct using (item_id, position)),
    k as (select *, floor(("end" - "start" + 1) * part)::int as keep from c),
    s as (select k.*, (select coalesce(sum(strlen(text) + 1), 0) - 1 + 64 from lines l where l.doc_id = k.doc_id and l.line between k."start" and k."start" + k.keep - 1) as cost from k where keep >= 1)
    select item_id, position, doc_id, "start", ("start" + max(keep) - 1)::int as "end" from s where cost <= room group by item_id, position, doc_id, "start" """)
def partial_unit(spark, sf_dir):
    """Of the first unit beyond 2,000 bytes the largest of three, two or one quarter of its lines that still fits."""
    w = Window.partitionBy("item_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    u = units(spark, sf_dir).withColumn("run", F.sum("cost").over(w)).where("run > 2000")
    first = u.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("position"))).where("_r = 1")
    part = first.select("item_id", "position", "doc_id", "start", "end", "text", (2000 - (F.col("run") - F.col("cost"))).alias("room"), F.explode(F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25))).alias("part"))
    part = part.withColumn("keep", F.floor((F.col("end") - F.col("start") + 1) * F.col("part")).cast("int")).where("keep >= 1")
    cost = F.octet_length(F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.col("keep")), "\n")) + P.UNIT_OVERHEAD
    return part.where(cost <= F.col("room")).groupBy("item_id", "position", "doc_id", "start").agg(F.max("keep").alias("k")).select("item_id", "position", "doc_id", "start", (F.col("start") + F.col("k") - 1).alias("end"))


@query(f"""with {UNIT_SQL}, r as (select *, sum(cost) over (partition by item_id order by position) as run from u), l as (select item_id, list(doc_id || ':' || "start" order by position) as h from r where run > 6000 group by 1)
    select b.item_id, array_to_string(coalesce(h[1:5], ['no match: widen the query']), ' ') as hints from benchmark b left join l using (item_id) where h is not null or b.item_id not in (select item_id from u)""")
def hints(spark, sf_dir):
    """Up to five of the units left out, or that nothing matched."""
    u = units(spark, sf_dir)
    w = Window.partitionBy("item_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    left = u.withColumn("run", F.sum("cost").over(w)).where("run > 6000").withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("position"))).where("_r <= 5")
    lists = left.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("h")))), lambda x: x["h"]), " ").alias("hints"))
    none = table(spark, sf_dir, "benchmark").select("item_id").join(u.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("no match: widen the query").alias("hints"))
    return lists.unionByName(none)


@query("""with x as (select o_orderkey as k, o_custkey as c, o_orderstatus = 'P' as p from orders), y as (select *, k % 13 <> 0 as model, k % 17 <> 0 as usage, k % 9 not in (0, 1) as cost, k % 19 <> 0 as cover from x)
    select k as id, case when k % 23 = 0 then 'unreadable' else array_to_string(list_filter([case when k % 6 = 0 then 'schema' end, case when not model then 'model_missing' when k % 5 = 0 then 'model:provider' when k % 5 = 1 and c % 2 = 0 then 'model:id,version' end,
      case when model and c % 7 = 0 then 'model_unverified' end, case when not usage then 'usage_missing' end, case when usage and c % 4 = 0 then 'usage:input_tokens' end, case when usage and k % 8 = 0 then 'usage:output_tokens' end, case when usage and k % 3 = 1 then 'usage:turns' end,
      case when k % 9 = 1 then 'cost_no_object' end, case when cost and k % 10 = 0 then 'cost:provider_billed' end, case when cost and c % 6 = 0 then 'cost:currency' end, case when p then 'stop' end, case when not cover then 'coverage_missing' end,
      case when cover and c % 11 = 0 then 'coverage:tokens' end, case when cover and c % 11 = 2 then 'coverage_unexplained:cost' end, case when cover and c % 11 = 1 then 'coverage_unobserved:turns' end], lambda x: x is not null), ',') end as violations from y""")
def validate_result(spark, sf_dir):
    """Result documents, as JSON, and all that is wrong with them; the twin knows how each was spoilt."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    model = F.when(k % 13 == 0, "5").otherwise(F.concat(F.lit('{"provider":'), F.when(k % 5 == 0, '" "').otherwise('"p"'), F.when((k % 5 == 1) & (c % 2 == 0), ',"id":1').otherwise(',"id":"m","version":"1"'), F.when(c % 7 != 0, ',"verified_by":"x"').otherwise(""), F.lit("}")))
    usage = F.when(k % 17 == 0, "null").otherwise(F.concat(F.lit('{"model_calls":1,"input_tokens":'), F.when(c % 4 == 0, "-1").otherwise("10"), F.lit(',"output_tokens":'), F.when(k % 8 == 0, "true").otherwise("2.5"), F.lit(',"cache_read_tokens":null,"turns":'), F.when(k % 3 == 1, '"3"').otherwise("3"), F.lit("}")))
    cost = F.when(k % 9 == 0, "null").when(k % 9 == 1, '"free"').otherwise(F.concat(F.lit('{"provider_billed":'), F.when(k % 10 == 0, "-2").otherwise("0.25"), F.when(c % 6 == 0, "").otherwise(',"currency":"USD"'), F.lit(',"source":"s"}')))
    seen = '{"observed":true}'
    tokens = F.when(c % 11 == 0, "").otherwise(f'"tokens":{seen},')
    money = F.when(c % 11 == 2, '{"observed":false,"reason":" "}').when(c % 11 == 3, '{"observed":false,"reason":"none"}').otherwise(seen)
    cover = F.when(k % 19 == 0, "[]").otherwise(F.concat(F.lit(f'{{"model_identity":{seen},'), tokens, F.lit('"cost":'), money, F.lit(f',"tool_calls":{seen},"turns":'), F.when(c % 11 == 1, "{}").otherwise(seen), F.lit("}")))
    stop = F.when(F.col("o_orderstatus") == "P", '{"reason":" "}').otherwise('{"reason":"done"}')
    schema = F.when(k % 6 == 0, "v0").otherwise(V.RESULT)
    doc = F.concat(F.lit('{"schema":"'), schema, F.lit('","model":'), model, F.lit(',"usage":'), usage, F.lit(',"cost":'), cost, F.lit(',"stop":'), stop, F.lit(',"coverage":'), cover, F.when(k % 23 != 0, "}").otherwise(""))
    parsed = table(spark, sf_dir, "orders").select(k.alias("id"), F.try_parse_json(doc).alias("v"))
    return parsed.select("id", F.array_join(V.result_violations(F.col("v")), ",").alias("violations"))


@query("""with t as (select ['local_bug', 'cross_file', 'api_tests', 'configuration', 'misc'][1 + p_partkey % 5] as category from part), n as (select category, count(*) as n from t group by 1)
    select category, n, n - (select min(n) from n) <= 1 and category <> 'misc' as balanced from n""")
def category_balance(spark, sf_dir):
    cat = F.get(F.array(*[F.lit(x) for x in ("local_bug", "cross_file", "api_tests", "configuration", "misc")]), (F.col("p_partkey") % 5).cast("int"))
    n = table(spark, sf_dir, "part").groupBy(cat.alias("category")).agg(F.count("*").alias("n"))
    low = n.agg(F.min("n").alias("_m"))
    return n.join(F.broadcast(low), F.col("n") >= F.col("_m")).select("category", "n", ((F.col("n") - F.col("_m") <= 1) & (F.col("category") != "misc")).alias("balanced"))


@query("""select o_orderpriority as condition, count(c_custkey) as attempts, count(*) filter (c_custkey is null) as without_task from orders left join (select c_custkey from customer where c_nationkey <> 7) on o_custkey = c_custkey group by 1""")
def attempt_tasks(spark, sf_dir):
    """Attempts with their tasks; those whose task is missing are counted, not dropped."""
    c = table(spark, sf_dir, "customer").where("c_nationkey <> 7").select("c_custkey")
    j = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("o_orderpriority").alias("condition")).agg(F.count("c_custkey").alias("attempts"), F.count_if(F.col("c_custkey").isNull()).alias("without_task"))


@query(f"""with {SYMBOLS_SQL}, first as (select name, min(file) as file from symbols where length(name) >= 6 group by 1), t as (select * from first order by file, name limit 20),
    refs as (select t.name, count(distinct l.doc_id) as n, min(l.doc_id) as first_ref from t join lines l on contains(l.text, t.name) and l.doc_id <> t.file group by 1)
    select 'A' as category, 'where is ' || name as question, file as gt_file, null::bigint as n_refs from t union all select 'B', 'which module has ' || name, file, null from t union all select 'D', 'who mentions ' || name, first_ref, n from t join refs using (name)""")
def questions(spark, sf_dir):
    """Questions on the first 20 long names by file: location, module, and references where there are any."""
    _, lines, symbols = corpus(spark, sf_dir)
    t = symbols.where(F.length("name") >= 6).groupBy("name").agg(F.min("file").alias("file")).orderBy("file", "name").limit(20)
    hit = lines.join(F.broadcast(t), F.contains(F.col("text"), F.col("name")) & (F.col("doc_id") != F.col("file")))  # 20 names
    refs = hit.groupBy("name").agg(F.count_distinct("doc_id").alias("n_refs"), F.min("doc_id").alias("gt_file"))
    ask = lambda c, s: (F.lit(c).alias("category"), F.concat(F.lit(s), "name").alias("question"))
    none = F.lit(None).cast("long").alias("n_refs")
    a = t.select(*ask("A", "where is "), F.col("file").alias("gt_file"), none).unionByName(t.select(*ask("B", "which module has "), F.col("file").alias("gt_file"), none))
    return a.unionByName(refs.select(*ask("D", "who mentions "), "gt_file", "n_refs"))


@query(f"""with {SYMBOLS_SQL}, f as (select distinct module, name, file from symbols join files on doc_id = file where length(name) >= 5), r as (select *, row_number() over (partition by module order by file, name) as r from f)
    select module, name, file from r where r <= 8""")
def module_questions(spark, sf_dir):
    """Eight names of each module to ask about."""
    files, _, symbols = corpus(spark, sf_dir)
    f = symbols.where(F.length("name") >= 5).join(files.select(F.col("doc_id").alias("file"), "module"), "file").select("module", "name", "file").distinct()
    return f.withColumn("_r", F.row_number().over(Window.partitionBy("module").orderBy("file", "name"))).where("_r <= 8").drop("_r")


EXPECTED_SQL = f"""{FILES_SQL}, {BM25_SQL}, r as (select item_id, rank, path, 'src/' || coalesce(module, 'none') || '/' as pkg from bm join files using (doc_id) where rank <= 20),
    ev as (select item_id, 'files' as field, path as value from r where item_id % 5 = 0 and rank in (3, 9) union all select item_id, 'edge', path from r where item_id % 5 = 1 and rank = 2 or item_id % 5 = 2 and rank = 9 or item_id % 10 = 7 and rank = 4
      union all select item_id, 'path', path from r where item_id % 5 = 1 and rank in (7, 8) or item_id % 10 = 2 and rank = 1 union all select item_id, 'package', pkg from r where item_id % 5 = 3 and rank = 4 + item_id % 9
      union all select item_id, 'file', path from r where item_id % 5 = 3 and rank = 11 or item_id % 5 = 4 and rank = 1 + item_id % 8)"""


@query(f"""with {EXPECTED_SQL}, g as (select item_id, path as value from r where rank <= 5), x as (select ev.item_id, field, bool_or(g.value is not null) as hit from ev left join g on g.item_id = ev.item_id and (g.value = ev.value or field = 'package' and starts_with(g.value, ev.value)) group by 1, 2),
    p as (select item_id, bool_or(hit) filter (field = 'files') as fs, bool_or(hit) filter (field = 'edge') as e, bool_or(hit) filter (field = 'path') as pa, bool_or(hit) filter (field = 'package') as pk, bool_or(hit) filter (field = 'file') as f from x group by 1),
    q as (select *, case when pk is not null then pk or coalesce(f, false) else coalesce(f, false) end as rest from p)
    select item_id, coalesce(fs, e, rest) as loose, coalesce(fs, case when e is not null then e and coalesce(pa, true) end, rest) as sweep, coalesce(fs, case when pa is not null then pa and coalesce(e, true) end, e, rest) as canonical from q""")
def hit_rules(spark, sf_dir):
    """Three readings of a hit among the five best, over expected files, edges, paths and packages."""
    i, k = F.col("item_id"), F.col("rank")
    files = document_files(table(spark, sf_dir, "documents")).select("doc_id", "path", F.concat(F.lit("src/"), F.coalesce("module", F.lit("none")), F.lit("/")).alias("pkg"))
    top = fulltext.small(written(ranked(spark, sf_dir).select("item_id", "doc_id", "rank"), "top"))
    r = written(files.join(top, "doc_id").select(i, k, "path", "pkg"), "ranked")
    pick = lambda field, when, value="path": r.where(when).select(i, F.lit(field).alias("field"), F.col(value).alias("value"))
    expected = pick("files", (i % 5 == 0) & k.isin(3, 9)).unionByName(pick("edge", (i % 5 == 1) & (k == 2) | (i % 5 == 2) & (k == 9) | (i % 10 == 7) & (k == 4))).unionByName(pick("path", (i % 5 == 1) & k.isin(7, 8) | (i % 10 == 2) & (k == 1)))
    expected = expected.unionByName(pick("package", (i % 5 == 3) & (k == 4 + i % 9), "pkg")).unionByName(pick("file", (i % 5 == 3) & (k == 11) | (i % 5 == 4) & (k == 1 + i % 8)))
    return M.hit_rules(r.where(k <= 5).select(i, F.col("path").alias("file")), expected)


@query(f"""with {CONT_SQL} select item_id, count(*) as n_files, array_to_string(list_sort(list(doc_id)), ' ') as files from gt group by 1""")
def ground_truth(spark, sf_dir):
    """All documents that contain an item's passage, as one set."""
    return truth(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("files"))


@query("""with b as (select item_id, text, length(text) // 100 as band from benchmark), s as (select item_id, 0 as part from (select *, row_number() over (partition by band order by item_id) as r from b) where r <= 3),
    e as (select item_id, 1 as part from b where length(text) = (select max(length(text)) from b) or length(text) = (select min(length(text)) from b)), u as (select * from s union all select * from e)
    select item_id, part, position from (select *, row_number() over (order by part, item_id)::int as position from u) where position <= 12""")
def query_set(spark, sf_dir):
    """Three items of each length, then the longest and shortest as edge cases, twelve in all."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    strata = b.withColumn("_r", F.row_number().over(Window.partitionBy(F.floor(F.col("n") / 100)).orderBy("item_id"))).where("_r <= 3").select("item_id")
    ends = b.agg(F.max("n").alias("_a"), F.min("n").alias("_b")).first()
    edge = b.where(F.col("n").isin(ends["_a"], ends["_b"])).select("item_id")
    return G.query_set(strata, edge, 12, ["item_id"]).select("item_id", "part", "position")


@query("""with r as (select item_id as task_id, c.condition, rep::int as repetition, (case when rep % 2 = 0 then c.k else 1 - c.k end)::int as "order" from benchmark, (values ('with', 0), ('without', 1)) c(condition, k), range(3) x(rep))
    select *, json_object('budget', 4000, 'condition', condition, 'order', "order", 'repetition', repetition, 'sha', 'abc', 'task_id', task_id, 'tokenizer', 'chars//4')::varchar as manifest from r""")
def pairing_manifest(spark, sf_dir):
    return G.pairing_manifest(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id")), ["with", "without"], 3, 4000, "abc")


@query(f"""with {BM25_SQL}, {CONT_SQL}, {scored_sql(TOP_SQL)}, ch as (select item_id, case when item_id % 5 = 0 then n_common + 1 else n_common end as n_common, case when item_id % 7 <> 0 then n_delivered end as n_delivered from sd)
    select 'spoilt' as replay, count(*) as items, count(*) filter (sd.n_common is distinct from ch.n_common or sd.n_delivered is distinct from ch.n_delivered) as differences from sd join ch using (item_id)
    union all select 'stored', count(*), 0 from sd""")
def score_replay(spark, sf_dir):
    """Scores computed again from a stored delivery: none may differ from the first; of scores spoilt on purpose each must."""
    path = fresh_path(spark, "replay")
    delivered, t = ranked(spark, sf_dir).select("item_id", "doc_id"), written(truth(spark, sf_dir), "truth")
    delivered.write.parquet(path)
    a, b = written(M.score_delivery(delivered, t), "scores"), M.score_delivery(spark.read.parquet(path), t)
    i = F.col("item_id")
    spoilt = a.withColumn("n_common", F.col("n_common") + F.when(i % 5 == 0, 1).otherwise(0)).withColumn("n_delivered", F.when(i % 7 != 0, F.col("n_delivered")))
    row = lambda name, x: M.replayed(a, x).select(F.lit(name).alias("replay"), "items", "differences")
    return row("spoilt", spoilt).unionByName(row("stored", b))


@query(f"with {FILES_SQL}, d as (select path, size from files where doc_id % 97 <> 1) select count(f.path) as on_disk, count(d.path) as indexed, count(*) filter (f.path is null or d.path is null) as mismatches, count(*) filter (d.path is null) = 0 as covered from files f full join d on f.path = d.path")
def index_covers(spark, sf_dir):
    """Whether an index that lacks some files covers the tree."""
    f = document_files(table(spark, sf_dir, "documents"))
    a, b = f.select("path", F.lit(1).alias("_a")), f.where("doc_id % 97 <> 1").select("path", F.lit(1).alias("_b"))
    j = a.join(b, "path", "full_outer")
    return j.agg(F.count("_a").alias("on_disk"), F.count("_b").alias("indexed"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("mismatches"), (F.count_if(F.col("_b").isNull()) == 0).alias("covered"))


@query("""select split_part(spec, ':', 1) as policy, unnest(string_split(split_part(spec, ':', 2), ','))::int as budget, rep::int as repetition, case when rep % 2 = 0 then 'a,b' else 'b,a' end as arm_order, item_id
    from (values ('LEX:1000,2000:3'), ('CTX:4000:2')) s(spec), range(3) r(rep), benchmark where rep < split_part(spec, ':', 3)::int""")
def round_plan(spark, sf_dir):
    """A round's runs: each spec names policy, budgets and repetitions; the arms' order alternates."""
    s = spark.createDataFrame([("LEX:1000,2000:3",), ("CTX:4000:2",)], "spec string")
    part = lambda k: F.split_part("spec", F.lit(":"), F.lit(k))
    p = s.select(part(1).alias("policy"), F.explode(F.split(part(2), ",")).alias("b"), part(3).cast("int").alias("n")).select("policy", F.col("b").cast("int").alias("budget"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("repetition"))
    runs = [(r.policy, r.budget, r.repetition) for r in p.collect()]  # the spec's own few rows
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("policy"), F.lit(b).alias("budget"), F.lit(c).alias("repetition")) for a, b, c in runs]))
    return table(spark, sf_dir, "benchmark").select("item_id", each.alias("r")).select("r.policy", "r.budget", "r.repetition", F.when(F.col("r.repetition") % 2 == 0, "a,b").otherwise("b,a").alias("arm_order"), "item_id")


@query("""select o_orderkey as id, left(sha256(json_object('condition', o_orderpriority, 'order', o_orderkey % 4, 'task', o_custkey)::varchar), 16) as fingerprint,
    replace(replace('/home/u/work/' || o_custkey, '/home/u/work', '/w'), '/home/u', '/h') as path, starts_with('/w/' || o_custkey || '/gold', '/w/' || o_custkey || '/') as separated_fails from orders""")
def run_manifest(spark, sf_dir):
    """Fingerprints of canonical manifests, translated paths (longest prefix first), and whether gold lies inside the workspace."""
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.col("o_orderpriority").alias("condition"), (F.col("o_orderkey") % 4).alias("order"), F.col("o_custkey").alias("task")))
    path, c = F.concat(F.lit("/home/u/work/"), F.col("o_custkey").cast("string")), F.col("o_custkey").cast("string")
    for a, b in sorted([("/home/u", "/h"), ("/home/u/work", "/w")], key=lambda x: -len(x[0])):
        path = F.replace(path, F.lit(a), F.lit(b))
    return o.select(F.col("o_orderkey").alias("id"), F.left(F.sha2(doc, 256), F.lit(16)).alias("fingerprint"), path.alias("path"), F.concat(F.lit("/w/"), c, F.lit("/gold")).startswith(F.concat(F.lit("/w/"), c, F.lit("/"))).alias("separated_fails"))
