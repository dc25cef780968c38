"""Queries whose rows come from files they have written: trees, JSON, stored snapshots, growing files, source code, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import extract as X
from spanlake.operators import index
from spanlake.operators import pack as P
from spanlake.plans.registry import FILES_SQL, query
from spanlake.sources import corpus as C
from spanlake.sources.corpus import document_files, fresh_path, table

FOLDERS = ["src/app", "src/lib", "docs", "target", "web/node_modules", "build/x"]


@query("""with d as (select ['src/app', 'src/lib', 'docs', 'target', 'web/node_modules', 'build/x'][1 + doc_id % 6] as folder, strlen(json_object('doc_id', doc_id, 'n_chars', n_chars)::varchar) + 1 as n from documents),
    f as (select folder, sum(n)::bigint as size from d group by 1)
    select folder, size, case when folder in ('target', 'web/node_modules', 'build/x') then 'excluded' when size > 4000 and folder = 'docs' or size > 1000000 then 'too_large' else 'kept' end as reason from f where folder <> 'docs' or size > 4000
    union all select folder, size, 'kept' from f where folder = 'docs' and size <= 4000""")
def file_tree(spark, sf_dir):
    """A tree of files on disk, walked with reasons; ``docs`` has a smaller limit than the others."""
    root, d = fresh_path(spark, "tree"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    for k, folder in enumerate(FOLDERS):
        d.where(F.col("doc_id") % len(FOLDERS) == k).coalesce(1).write.json(f"{root}/{folder}")
    found = C.files(spark, root, "*.json").withColumn("head", F.substring("body", 1, 8192))
    docs = F.col("path").startswith("docs/")
    seen = C.discover(found.where(~docs), max_bytes=1_000_000).unionByName(C.discover(found.where(docs), max_bytes=4000))
    return seen.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "size", "reason")


@query(f"""with {FILES_SQL}, s as (select doc_id % 4 as part, sum(size + 1) as size from files group by 1), l as (select doc_id % 4 as part, len(string_split(body, chr(10))) as n from files)
    select part, any_value(size)::bigint as bytes, sum(n)::bigint as lines from s join l using (part) where size <= (select max(size) from s) - 1 group by 1""")
def file_scan(spark, sf_dir):
    """Bytes and lines of the files below a size limit that the scan itself applies; the largest is never read."""
    root, d = fresh_path(spark, "scan"), table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = d.groupBy(F.col("doc_id") % 4).agg(F.sum(F.octet_length("text") + 1).alias("n")).agg(F.max("n")).first()[0]
    for k in range(4):
        d.where(F.col("doc_id") % 4 == k).select("text").coalesce(1).write.text(f"{root}/{k}")
    found = C.files(spark, root, "*.txt", max_bytes=sizes - 1)
    return found.select(F.regexp_extract("path", "^([0-9]+)/", 1).cast("long").alias("part"), F.col("size").alias("bytes"), F.size(T.lines(F.col("body"))).cast("long").alias("lines"))


@query("select doc_id, text, n_chars from documents")
def jsonl_source(spark, sf_dir):
    """JSON lines with blank, malformed and incomplete ones among them, which are skipped."""
    path = fresh_path(spark, "jsonl")
    good = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text", "n_chars"), {"ignoreNullFields": "false"}).alias("value"))
    bad = spark.createDataFrame([("",), ("{\"doc_id\": 1, ",), ("not json",)], "value string")
    good.unionByName(bad).write.text(path)
    return C.read_jsonl(spark, path, "doc_id long, text string, n_chars long")


@query("select doc_id, lang, n_chars from documents")
def json_documents(spark, sf_dir):
    """Documents of several lines each, one JSON value a file; they are written by the JSON sink."""
    path = fresh_path(spark, "json")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").groupBy((F.col("doc_id") % 8).alias("part")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "lang", "n_chars"))).alias("rows"))
    for k in range(8):
        C.write_json(d.where(F.col("part") == k).coalesce(1), f"{path}/{k}")
    return C.read_json(spark, f"{path}/*").select(F.explode("rows").alias("r")).select("r.doc_id", "r.lang", "r.n_chars")


@query(f"with {FILES_SQL} select path, sha256(body) as content_hash from files where doc_id % 5 <> 0")
def snapshot_reader(spark, sf_dir):
    """A stored snapshot with absolute paths and upper-case hashes, replaced once, read as relative paths and lower-case hashes."""
    files, path = document_files(table(spark, sf_dir, "documents")), fresh_path(spark, "snapshot")
    stored = index.snapshot(files.withColumn("path", F.concat(F.lit("/data/corpus/"), "path"))).withColumn("content_hash", F.upper("content_hash")).join(files.select(F.concat(F.lit("/data/corpus/"), "path").alias("path"), "doc_id"), "path")
    C.write_snapshot(stored.where("doc_id % 5 = 0"), path)
    C.write_snapshot(stored.where("doc_id % 5 <> 0"), path)
    return C.read_snapshot(spark, path).select(F.regexp_replace("path", "^/data/corpus/", "").alias("path"), F.lower("content_hash").alias("content_hash"))


@query(f"with {FILES_SQL} select path, sha256(body) as content_hash from files order by path")
def logical_dump(spark, sf_dir):
    """A stored snapshot's paths and hashes in order of the path."""
    path = fresh_path(spark, "dump")
    C.write_snapshot(index.snapshot(document_files(table(spark, sf_dir, "documents"))), path)
    return C.read_snapshot(spark, path).select("path", "content_hash").orderBy("path")


@query("select event_id, event_type from events where event_id % 50 = 0")
def jsonl_tail(spark, sf_dir):
    """A growing file followed by a stream from byte offset to byte offset: each line once, the incomplete last one not yet."""
    from spanlake.streaming.tail import follow

    rows = [r.value for r in table(spark, sf_dir, "events").where("event_id % 50 = 0").orderBy("event_id").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).collect()]  # a small file, written by the driver
    base = fresh_path(spark, "tail")
    half = len(rows) // 2
    C.put_text(spark, f"{base}/log.jsonl", "\n".join(rows[:half]) + "\n" + (rows[half][:5] if rows else ""))
    follow(spark, f"{base}/log.jsonl", f"{base}/out", f"{base}/state")
    C.put_text(spark, f"{base}/log.jsonl", "\n".join(rows) + "\n{\"event_id\": 1, \"ev")
    follow(spark, f"{base}/log.jsonl", f"{base}/out", f"{base}/state")
    found = spark.read.option("recursiveFileLookup", "true").schema("line string").parquet(f"{base}/out")
    return found.select(F.from_json("line", "event_id long, event_type string").alias("e")).select("e.*")


# -- source code

JAVA = """package p;

public class J%d {
    private static int
        unrelated = 1;
    public void go%d(int a) {
        if (a > 0) { other(a); }
    }
    private static final Object make%d(String s) throws Error {
        return new Thing(s, go%d (1)); // ignored(s)
    }
    native int size();
}
"""


def python_files(spark, sf_dir):
    """Small sources made from documents, some with a syntax error."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    py = F.format_string("class C%d:\n    def run_%d(self):\n        return helper(%d)\n\n\nasync def helper(x):\n    return x\n%s", i, i % 7, i, F.when(i % 5 == 0, "def (").otherwise(""))
    return d.select(F.format_string("m/f%d.py", i).alias("path"), py.alias("body"))


def java_files(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(F.format_string("m%d/F%d.java", i % 3, i).alias("path"), F.format_string(JAVA, i, i % 7, i % 5, i % 7).alias("body"))


@query("""select 'm/f' || doc_id || '.py' as path, kind, name, line::int as line from documents, lateral (values ('class', 'C' || doc_id, 1), ('function', 'run_' || (doc_id % 7), 2), ('function', 'helper', 6)) s(kind, name, line) where doc_id % 5 <> 0""")
def python_symbols(spark, sf_dir):
    return X.python_symbols(python_files(spark, sf_dir)).select("path", "kind", "name", "line")


@query("""select 'm' || (doc_id % 3) || '/F' || doc_id || '.java' as path, kind, name, line::int as line, confidence::double as confidence from documents,
    lateral (values ('class', 'J' || doc_id, 3, 1.0), ('method', 'go' || (doc_id % 7), 6, 0.9), ('method', 'make' || (doc_id % 5), 9, 0.9), ('method', 'size', 12, 0.9)) s(kind, name, line, confidence)""")
def pattern_symbols(spark, sf_dir):
    return X.pattern_symbols(java_files(spark, sf_dir)).select("path", "kind", "name", "line", "confidence")


CALL_SQL = """calls as (select 'm' || (doc_id % 3) || '/F' || doc_id || '.java' as path, line, caller, callee from documents,
    lateral (values (7, 'go' || (doc_id % 7), 'other'), (10, 'make' || (doc_id % 5), 'Thing'), (10, 'make' || (doc_id % 5), 'go' || (doc_id % 7))) s(line, caller, callee))"""


def call_edges(spark, sf_dir):
    """Calls with the last method declared at or before their line; a method's own name is no call."""
    files = java_files(spark, sf_dir)
    lines = C.line_scan(files, "path")
    methods = X.pattern_symbols(files).where("kind = 'method'").select("path", "line", "name")
    calls = X.calls(lines)
    of = P.enclosing(calls.select("path", "line").distinct(), methods, "path").where("name is not null")
    return calls.join(of, ["path", "line"]).where("name <> callee").select("path", "line", F.col("name").alias("caller"), "callee"), lines


@query(f"with {CALL_SQL} select path, line::int as line, caller, callee from calls")
def caller_asof(spark, sf_dir):
    return call_edges(spark, sf_dir)[0]


TREE_SQL = """tree as (select 'm' || (doc_id % 3) || '/F' || doc_id || '.java' as path, doc_id from documents),
    tl as (select path, unnest([3, 6, 7, 9, 10, 12]) as line, unnest(['J' || doc_id, 'go' || (doc_id % 7), 'other', 'make' || (doc_id % 5), 'Thing go' || (doc_id % 7), 'size']) as words from tree)"""


@query(f"""with {CALL_SQL}, {TREE_SQL}, e as (select *, row_number() over (order by caller, callee, path, line) as place from calls),
    rf as (select place, caller, callee, path as own, file, rl, row_number() over (partition by place order by file, rl) as r from (select e.place, e.caller, e.callee, e.path, t.path as file, t.line as rl from e join tl t on t.path <> e.path and contains(t.words, e.callee) where e.place <= 60)),
    two as (select place, callee, list(file order by r) as files, list(rl order by r) as ls from rf where r <= 2 group by 1, 2), ranked as (select *, row_number() over (order by place) as n from two)
    select 'C' as category, 'C-' || (place - 1) as id, caller || ' calls ' || callee as question, path || ':' || line as answer from e where place <= 10 union all select 'F', 'F-' || (place - 1), 'where is ' || caller, split_part(path, '/', 1) || ' ' || path from e where place <= 10
    union all select 'E', 'E-' || (n - 1), 'who calls ' || callee, files[1] || ':' || ls[1] from ranked where n <= 10 union all select 'G', 'G-' || (n - 1), 'what changes with ' || callee, array_to_string(files, ' ') from ranked where n <= 10""")
def call_questions(spark, sf_dir):
    """Ten questions of each kind on the first calls by name: where a call is, who calls, which folder, what a change touches."""
    from spanlake.operators.generate import call_questions as ask

    return ask(*call_edges(spark, sf_dir))


# -- markup

PAGE_SQL = """mk as (select doc_id, 'web/' || (doc_id % 4) || '/p' || doc_id || '.jsp' as path from documents)"""


@query(f"""with {PAGE_SQL}, want as (select path, 'page' as kind, 'p' || doc_id as name, 1 as line, 1.0::double as confidence, 'markup-file' as provenance, null::varchar as resolved, null::varchar as target from mk
      union all select path, 'include', 'p' || (doc_id + 4) || '.jsp', 1, null, null, null, 'web/' || (doc_id % 4) || '/p' || (doc_id + 4) || '.jsp' from mk union all select path, 'include', '../' || ((doc_id + 1) % 4) || '/p' || (doc_id + 1) || '.jsp', 2, null, null, null, 'web/' || ((doc_id + 1) % 4) || '/p' || (doc_id + 1) || '.jsp' from mk
      union all select path, 'include', '../../../out.jsp', 2, null, null, null, null from mk where doc_id % 3 = 0 union all select path, 'taglib', 'http://tags/' || (doc_id % 2), 3, 0.8, 'taglib', null, null from mk)
    select w.path, kind, name, line, coalesce(confidence, case when m.path is not null then 1.0 else 0.5 end) as confidence, coalesce(provenance, case when m.path is not null then 'include-exact' else 'include-unresolved' end) as provenance, m.path as resolved from want w left join mk m on m.path = w.target""")
def markup_includes(spark, sf_dir):
    """Pages made from documents, with includes in all three forms and tag libraries."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.format_string("<%%@ include file=\"p%d.jsp\" %%>\n<jsp:include page='../%d/p%d.jsp'/>%s\n<%%@taglib uri=\"http://tags/%d\"%%><p>%d</p>\n", i + 4, (i + 1) % 4, i + 1, F.when(i % 3 == 0, '<c:import url="../../../out.jsp"/>').otherwise(""), i % 2, i)
    files = d.select(F.format_string("web/%d/p%d.jsp", i % 4, i).alias("path"), body.alias("body"))
    return X.markup(files, C.line_scan(files, "path"))
