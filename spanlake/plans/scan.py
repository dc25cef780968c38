"""Queries on scans, text primitives and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.plans.registry import FILES_SQL, LINES_SQL, corpus, query
from spanlake.sources.corpus import discover, document_files, table
from spanlake.sources.corpus import line_scan as scan_lines

NEEDLES = ["license", "rights"]
GLOBS = ["src/src1*", "*.java"]
IMMUTABLE = ["src/src0/*"]
#: Leak patterns: name, pattern, whether a hit is certain.
LEAKS = [("access_key", "AKIA[0-9A-Z]{12,}", "hard"), ("address", "[a-z.0-9]+@[a-z0-9.]+", "soft"), ("number", "[0-9]{13,}", "soft")]


@query(f"with {LINES_SQL} select doc_id, line, text from lines")
def line_scan(spark, sf_dir):
    return scan_lines(document_files(table(spark, sf_dir, "documents")))


@query("""with t as (select item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') as l from benchmark)
    select item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as tokens, len(list_filter(l, lambda x, i: list_position(l, x) = i))::int as n_tokens from t""")
def tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


@query("""with q as (select item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') as l from benchmark),
    d as (select item_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from q)
    select d.item_id, x.doc_id, array_to_string(list_filter(d.l, lambda t: contains(translate(x.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))[1:5], ' ') as present
    from d join documents x on x.doc_id = d.item_id""")
def tokens_present(spark, sf_dir):
    """The first five tokens of an item that stand in the document of the same number."""
    q = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.ascii_lower(F.col("text")).alias("b"))
    out = d.join(F.broadcast(q) if q.count() <= 10_000 else q, F.col("doc_id") == F.col("item_id"))
    return out.select("item_id", "doc_id", F.array_join(F.slice(F.filter("t", lambda t: F.contains(F.col("b"), T.ascii_lower(t))), 1, 5), " ").alias("present"))


@query(f"""with {LINES_SQL} select doc_id, line from lines where regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license|rights')""")
def locate_lines(spark, sf_dir):
    _, lines, _ = corpus(spark, sf_dir)
    low = T.ascii_lower(F.col("text"))
    return lines.where(F.contains(low, F.lit(NEEDLES[0])) | F.contains(low, F.lit(NEEDLES[1]))).select("doc_id", "line")


@query("""select item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 2))), ' ') as terms from benchmark""")
def focus_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.focus_terms(F.col("text")), " ").alias("terms"))


@query(f"""with {FILES_SQL}, c as (select *, case lower(regexp_extract(path, '\\.([a-z]+)$', 1)) when 'py' then 'python' when 'java' then 'java' when 'md' then 'markdown' end as lang from files)
    select lang, case when lang is null then 'unsupported' when lang = 'java' then 'structural' else 'lexical' end as capability, count(*) as n from c group by all""")
def lang_classify(spark, sf_dir):
    files = document_files(table(spark, sf_dir, "documents")).withColumn("lang", T.language(F.col("path")))
    return files.groupBy("lang", T.capability(F.col("lang")).alias("capability")).agg(F.count("*").alias("n"))


@query(f"""with {FILES_SQL}, c as (select case when regexp_extract(path, '\\.([a-z]+)$', 1) not in ('py', 'java', 'md') then 'unsupported'
      when regexp_extract(path, '\\.([a-z]+)$', 1) = 'md' then 'excluded_by_filter' when size > 8192 then 'too_large' when contains(body, chr(0)) then 'binary' else 'kept' end as reason from files)
    select reason, count(*) as n from c group by 1""")
def discovery_counts(spark, sf_dir):
    files = document_files(table(spark, sf_dir, "documents")).withColumn("head", F.substring("body", 1, 8192))
    return discover(files, include=["python", "java"], max_bytes=8192).groupBy("reason").agg(F.count("*").alias("n"))


@query("select doc_id, 'it-' || left(sha256('n1|' || doc_id), 10) as item from documents")
def opaque_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.opaque_id("n1", F.col("doc_id")).alias("item"))


PATH_SQL = "(case when page_id % 5 = 0 then '/' when page_id % 5 = 1 then '../' else '' end) || regexp_replace(url, '^[a-z]+://', '') || (case when page_id % 5 = 2 then '/../x' else '' end)"


@query(f"""with p as (select page_id, {PATH_SQL} as path from pages)
    select page_id, path, length(path) > 0 and not starts_with(path, '/') and not regexp_matches(path, '(^|/)\\.\\.(/|$)') and not regexp_matches(path, '^[A-Za-z]:') as safe from p""")
def path_safety(spark, sf_dir):
    """Paths made from the pages' URLs, some of them absolute or climbing."""
    k = F.col("page_id") % 5
    path = F.concat(F.when(k == 0, "/").when(k == 1, "../").otherwise(""), F.regexp_replace("url", "^[a-z]+://", ""), F.when(k == 2, "/../x").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("safe", T.path_safe(F.col("path")))


@query("""with r as (select doc_id, 'docs/' || doc_id || (case when doc_id % 4 = 3 then '' else ':' || (doc_id % 9) end) || (case doc_id % 3 when 0 then '@sha256:' || upper(left(sha256(text), 8)) when 1 then '@' else '' end) as ref from documents)
    select doc_id, nullif(regexp_extract(ref, '^(.+):([0-9]+)(?:@(?:sha256:)?([^@]*))?$', 1), '') as file, try_cast(nullif(regexp_extract(ref, '^(.+):([0-9]+)(?:@(?:sha256:)?([^@]*))?$', 2), '') as int) as line,
      lower(nullif(regexp_extract(ref, '^(.+):([0-9]+)(?:@(?:sha256:)?([^@]*))?$', 3), '')) as hash from r""")
def parse_ref(spark, sf_dir):
    d = F.col("doc_id")
    ref = F.concat(F.lit("docs/"), d.cast("string"), F.when(d % 4 == 3, "").otherwise(F.concat(F.lit(":"), (d % 9).cast("string"))),
                   F.when(d % 3 == 0, F.concat(F.lit("@sha256:"), F.upper(F.left(T.content_hash(F.col("text")), F.lit(8))))).when(d % 3 == 1, "@").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.parsed_ref(ref).alias("r")).select("doc_id", "r.*")


@query("""with p as (select p_partkey, 'diff --git a/x/' || p_partkey || '.c b/x/' || p_partkey || '.c' || chr(10) || '+' || p_name || chr(10) ||
      case when p_size % 2 = 0 then 'rename from y' || chr(10) || 'rename to y/' || p_size || '.c' || chr(10) else 'diff --git a/x/' || p_partkey || '.c b/x/' || p_partkey || '.c' || chr(10) end as t from part),
    l as (select p_partkey, regexp_extract_all(t, '(?m)^diff --git a/\\S+ b/(\\S+)', 1) || regexp_extract_all(t, '(?m)^rename to (\\S+)', 1) as l from p)
    select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as paths from l""")
def patch_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    head = F.format_string("diff --git a/x/%d.c b/x/%d.c\n", "p_partkey", "p_partkey")
    patch = F.concat(head, F.lit("+"), "p_name", F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.format_string("rename from y\nrename to y/%d.c\n", "p_size")).otherwise(head))
    return p.select("p_partkey", F.array_join(T.patch_paths(patch), " ").alias("paths"))


@query("""with p as (select p_partkey, '1/' || p_size || ' passed' || chr(10) || case when p_size > 5 then p_size - 1 || '/' || p_size || ' passed' else '' end as t from part)
    select p_partkey, regexp_extract_all(t, '([0-9]+)/([0-9]+) passed', 1)[-1]::int as passed, regexp_extract_all(t, '([0-9]+)/([0-9]+) passed', 2)[-1]::int as total from p""")
def case_counts(spark, sf_dir):
    n = F.col("p_size")
    log = F.concat(F.format_string("1/%d passed\n", n), F.when(n > 5, F.format_string("%d/%d passed", n - 1, n)).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.case_counts(log).alias("c")).select("p_partkey", "c.passed", "c.total")


@query(" union all ".join(f"""select '{n}' as pattern, '{k}' as severity, count(*) as docs, sum(len(regexp_extract_all(text, '{p}')))::bigint as hits from documents where regexp_matches(text, '{p}') having count(*) > 0""" for n, p, k in LEAKS))
def leak_scan(spark, sf_dir):
    """Counts of each pattern, in one pass over the texts."""
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(k).alias("severity"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p, k in LEAKS])
    found = table(spark, sf_dir, "documents").select(F.explode(hits).alias("h")).select("h.*").where("n > 0")
    return found.groupBy("pattern", "severity").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


@query(f"""with {FILES_SQL} select doc_id, path like 'src/src1%' or path like '%.java' as allowed, path like 'src/src0/%' as immutable from files""")
def glob_scope(spark, sf_dir):
    files = document_files(table(spark, sf_dir, "documents"))
    return files.select("doc_id", T.matches_any(F.col("path"), GLOBS).alias("allowed"), T.matches_any(F.col("path"), IMMUTABLE).alias("immutable"))


FORBIDDEN = ["k", "secret"]
NESTED_SQL = """n as (select event_id, case when event_id % 3 = 0 then '{"a": [{"secret": "x: \\"k\\": y"}, {"b": {"k": 1}}], "p": ' || coalesce(props, 'null') || '}' else props end as j from events)"""


@query(f"""with {NESTED_SQL}, s as (select event_id, regexp_extract_all(j, '"((?:[^"\\\\]|\\\\.)*)"(\\s*:)?', 1) as a, regexp_extract_all(j, '"((?:[^"\\\\]|\\\\.)*)"(\\s*:)?', 2) as b from n)
    select event_id, array_to_string(list_filter(a, lambda x, i: b[i] <> '' and x in ('k', 'secret')), ',') as keys from s where len(list_filter(a, lambda x, i: b[i] <> '' and x in ('k', 'secret'))) > 0""")
def forbidden_keys(spark, sf_dir):
    """Forbidden keys of the events' properties, at any depth, in order; texts that look like keys don't count."""
    e, deep = table(spark, sf_dir, "events"), '{"a": [{"secret": "x: \\"k\\": y"}, {"b": {"k": 1}}], "p": '
    j = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(deep), F.coalesce("props", F.lit("null")), F.lit("}"))).otherwise(F.col("props"))
    keys = F.filter(T.json_keys(j), lambda k: k.isin(FORBIDDEN))
    return e.select("event_id", keys.alias("_k")).where(F.size("_k") > 0).select("event_id", F.array_join("_k", ",").alias("keys"))


REQUEST_SQL = """r as (select o_orderkey as id, 1 + (o_orderkey % 7 = 0)::int as schema_version, case o_orderkey % 5 when 0 then 'explain' when 1 then 'edit' when 2 then 'test' else 'other' end as intent,
      case o_custkey % 3 when 0 then 'LEX' when 1 then 'CTX' else 'ANY' end as policy, o_orderkey % 4 as budget_tokens, case when o_custkey % 6 = 0 then '###' else o_orderpriority end as query,
      case o_orderkey % 6 when 0 then 'context' when 1 then 'references' when 2 then 'tests' when 3 then 'graph' end as evidence_wanted, case when o_custkey % 4 = 0 then (o_custkey % 130)::int end as reserve_pct from orders)"""


@query(f"""with {REQUEST_SQL} select id, array_to_string(list_filter([
      case when schema_version <> 1 then 'schema_version' end, case when intent not in ('explain', 'edit', 'test') then 'intent' end, case when policy not in ('LEX', 'CTX') then 'policy' end,
      case when budget_tokens <= 0 then 'budget_tokens' end, case when evidence_wanted not in ('context', 'references', 'tests') then 'evidence_wanted' end,
      case when reserve_pct > 100 then 'reserve_range' when reserve_pct > 0 and coalesce(evidence_wanted not in ('references', 'tests'), true) then 'reserve_needs_search' end,
      case when not regexp_matches(query, '[A-Za-z0-9_]') then 'no_terms' end], lambda x: x is not null), ',') as violations from r""")
def validate_requests(spark, sf_dir):
    from spanlake.operators.verify import request_violations

    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(
        k.alias("id"), F.when(k % 7 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 5 == 0, "explain").when(k % 5 == 1, "edit").when(k % 5 == 2, "test").otherwise("other").alias("intent"),
        F.when(c % 3 == 0, "LEX").when(c % 3 == 1, "CTX").otherwise("ANY").alias("policy"), (k % 4).alias("budget_tokens"), F.when(c % 6 == 0, "###").otherwise(F.col("o_orderpriority")).alias("query"),
        F.when(k % 6 == 0, "context").when(k % 6 == 1, "references").when(k % 6 == 2, "tests").when(k % 6 == 3, "graph").alias("evidence_wanted"), F.when(c % 4 == 0, (c % 130).cast("int")).alias("reserve_pct"),
    )
    return r.select("id", F.array_join(request_violations(), ",").alias("violations"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'stale' when o_custkey % 3 = 0 or o_orderpriority like '1%' then 'partial' else 'ok' end as state from orders")
def decide_state(spark, sf_dir):
    from spanlake.operators.verify import response_state

    return table(spark, sf_dir, "orders").select("o_orderkey", response_state(F.col("o_orderstatus") == "F", F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0), F.col("o_orderpriority").startswith("1")).alias("state"))
