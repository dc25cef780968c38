"""Queries on lookups, verification and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import fulltext, index, lookup, verify
from spanlake.plans.registry import FILES_SQL, LINES_SQL, SYMBOLS_SQL, corpus, query
from spanlake.sources.corpus import document_files, fresh_path, table

NAMES = ["The", "Licensed", "All", "Zu", "no_such_name"]
NAMES_SQL = "(values ('The'), ('Licensed'), ('All'), ('Zu'), ('no_such_name')) n(needle)"


@query(f"with {SYMBOLS_SQL} select needle, name, file, line, provenance, confidence from symbols join {NAMES_SQL} on name = needle")
def find_symbol_exact(spark, sf_dir):
    return lookup.find_symbol(corpus(spark, sf_dir)[2], NAMES).select("needle", "name", "file", "line", "provenance", "confidence")


@query(f"with {SYMBOLS_SQL} select needle, name, file, line from symbols join (values ('zu'), ('RIGHT'), ('a_b')) n(needle) on contains(lower(name), lower(needle))")
def find_symbol_like(spark, sf_dir):
    return lookup.find_symbol(corpus(spark, sf_dir)[2], ["zu", "RIGHT", "a_b"], exact=False).select("needle", "name", "file", "line")


KIND_SQL = "case when line = 1 then 'class' else 'head' end"


@query(f"""with {SYMBOLS_SQL}, k as (select needle, name, file, line, {KIND_SQL} as kind from symbols join {NAMES_SQL} on name = needle)
    select * from k where kind = 'class' or needle not in (select needle from k where kind = 'class')""")
def find_definition(spark, sf_dir):
    """A document's first line counts as its class-like declaration."""
    symbols = corpus(spark, sf_dir)[2].withColumn("kind", F.when(F.col("line") == 1, "class").otherwise("head"))
    return lookup.find_definition(symbols, NAMES, ["class", "interface", "enum"]).select("needle", "name", "file", "line", "kind")


REFS = ["Licensed", "Released", "rights"]
REFS_SQL = f"{LINES_SQL}, refs as (select needle, doc_id, line, left(regexp_replace(text, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), 200) as excerpt, 0.7::double as confidence from lines join (values ('Licensed'), ('Released'), ('rights')) n(needle) on contains(text, needle))"


@query(f"with {REFS_SQL} select * from refs")
def find_references(spark, sf_dir):
    return lookup.find_references(corpus(spark, sf_dir)[1], REFS)


TOGETHER = ["Licensed", "Public", "under", "rights"]


@query(f"""with {LINES_SQL}, refs as (select needle, doc_id, line from lines join (values ('Licensed'), ('Public'), ('under'), ('rights')) n(needle) on contains(text, needle))
    select * from refs where doc_id in (select doc_id from refs group by 1 having count(distinct needle) > 1)""")
def refs_cooccur(spark, sf_dir):
    return lookup.cooccurring(lookup.find_references(corpus(spark, sf_dir)[1], TOGETHER)).select("needle", "doc_id", "line")


@query(f"""with {SYMBOLS_SQL}, q as (select distinct item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as token from benchmark)
    select item_id, token from q where token in (select name from symbols)""")
def known_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return lookup.known_tokens(t, corpus(spark, sf_dir)[2]).select("item_id", "token")


@query(f"""with {SYMBOLS_SQL}, s as (select name, file, (case when file % 11 = 0 then line + 100000 else line end)::int as line, case when file % 7 = 0 then 'x' else content_hash end as content_hash, file % 13 = 0 as gone from symbols),
    n as (select doc_id, count(*) as n_lines from lines group by 1), h as (select doc_id, sha256(body) as h from files where doc_id % 13 <> 0)
    select s.name || case when s.file % 5 = 0 then '?' else '' end as name, s.file, s.line, case when h.h is null then 'missing_file' when h.h <> s.content_hash then 'hash_changed' when s.line > n_lines then 'line_out_of_range'
      when not contains(l.text, s.name || case when s.file % 5 = 0 then '?' else '' end) then 'name_not_on_line' else 'ok' end as state
    from s left join h on h.doc_id = s.file left join n on n.doc_id = s.file left join lines l on l.doc_id = s.file and l.line = s.line""")
def verify_symbols(spark, sf_dir):
    """All symbols, with some of them spoilt in each way that verification tells apart."""
    files, lines, symbols = corpus(spark, sf_dir)
    f = F.col("file")
    spoilt = symbols.select(
        F.concat("name", F.when(f % 5 == 0, "?").otherwise("")).alias("name"), "file", F.when(f % 11 == 0, F.col("line") + 100000).otherwise(F.col("line")).alias("line"), F.when(f % 7 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash")
    )
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    disk = files.join(n, "doc_id", "left").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 13 != 0, T.content_hash(F.col("body"))).alias("current_hash"), "n_lines")
    return verify.verify_symbols(spoilt, disk, lines.withColumnRenamed("doc_id", "file"))


@query(f"""with {LINES_SQL}, n as (select doc_id, count(*) as n_lines from lines group by 1),
    d as (select f.path, case when doc_id % 13 <> 0 then sha256(body) end as current_hash, case when doc_id % 9 = 0 then 'old' when doc_id % 17 <> 0 then sha256(body) end as index_hash, n_lines from files f left join n using (doc_id)),
    r as (select doc_id as ref_id, (case when doc_id % 19 = 0 then '../' else '' end) || path as file, (doc_id % 4)::int as line, (doc_id % 4 + doc_id % 12)::int as end_line, case doc_id % 3 when 0 then upper(sha256(body)) when 1 then 'beef' end as hash from files),
    c as (select ref_id, length(file) > 0 and not starts_with(file, '/') and not regexp_matches(file, '(^|/)\\.\\.(/|$)') as inside_root, current_hash is not null as "exists", index_hash is not null as registered,
      case when current_hash is not null and index_hash is not null then current_hash = index_hash end as matches_index, case when current_hash is not null and hash is not null then current_hash = lower(hash) end as matches_given,
      case when current_hash is not null then line >= 1 and end_line >= line and end_line <= n_lines end as in_range from r left join d on r.file = d.path),
    v as (select *, array_to_string(list_filter([case when not inside_root then 'inside_root' end, case when not "exists" then 'exists' end, case when not registered then 'registered' end, case when not matches_index then 'matches_index' end,
      case when not matches_given then 'matches_given' end, case when not in_range then 'in_range' end], lambda x: x is not null), ',') as reasons from c)
    select *, reasons = '' as verified from v""")
def verify_refs(spark, sf_dir):
    files, lines, _ = corpus(spark, sf_dir)
    n, d, h = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")), F.col("doc_id"), T.content_hash(F.col("body"))
    disk = files.join(n, "doc_id", "left").select("path", F.when(d % 13 != 0, h).alias("current_hash"), F.when(d % 9 == 0, "old").when(d % 17 != 0, h).alias("index_hash"), "n_lines")
    refs = files.select(
        d.alias("ref_id"), F.concat(F.when(d % 19 == 0, "../").otherwise(""), "path").alias("file"), (d % 4).cast("int").alias("line"), (d % 4 + d % 12).cast("int").alias("end_line"), F.when(d % 3 == 0, F.upper(h)).when(d % 3 == 1, "beef").alias("hash")
    )
    return verify.verify_refs(refs, disk)


# An old and a new state of the documents: some are edited, some removed, some added.
STATES_SQL = f"""{FILES_SQL}, old as (select path, sha256(body) as content_hash, size from files where doc_id % 11 <> 5),
    new as (select path, sha256(body || case when doc_id % 7 = 0 then '!' else '' end) as content_hash, size + case when doc_id % 7 = 0 then 1 else 0 end as size from files where doc_id % 13 <> 4)"""


def states(spark, sf_dir):
    files, d = document_files(table(spark, sf_dir, "documents")), F.col("doc_id")
    old = index.snapshot(files.where(d % 11 != 5))
    return old, index.snapshot(files.where(d % 13 != 4).withColumn("body", F.concat("body", F.when(d % 7 == 0, "!").otherwise(""))))


DIFF_SQL = f"""{STATES_SQL}, diff as (select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'gone' when o.content_hash <> n.content_hash then 'changed' else 'skipped' end as state from old o full join new n on o.path = n.path)"""


@query(f"with {DIFF_SQL} select * from diff")
def incremental_diff(spark, sf_dir):
    return index.incremental_diff(*states(spark, sf_dir))


@query(f"with {STATES_SQL} select path, content_hash, size::bigint as size from new")
def incremental_apply(spark, sf_dir):
    """The twin is the rebuilt snapshot: applying the difference must give the same."""
    return index.incremental_apply(*states(spark, sf_dir))


@query(f"with {DIFF_SQL} select path from diff where state = 'gone'")
def pruned_files(spark, sf_dir):
    old, new = states(spark, sf_dir)
    return old.join(new, "path", "left_anti").select("path")


@query(f"""with {STATES_SQL}, l as (select path, path || '|' || content_hash || '|' || size as l, left(sha256(path), 4) as leaf from new),
    lf as (select leaf, left(leaf, 2) as b, count(*) as n, sha256(string_agg(l, chr(10) order by path)) as h from l group by 1, 2), br as (select b, sum(n) as n, sha256(string_agg(h, chr(10) order by leaf)) as h from lf group by 1)
    select sum(n)::bigint as n_files, sha256(string_agg(h, chr(10) order by b)) as generation from br""")
def generation_hash(spark, sf_dir):
    return index.generation_hash(index.incremental_apply(*states(spark, sf_dir)))


@query(f"""with {STATES_SQL} select case when n.path is null then 'only_left' when o.path is null then 'only_right' when o.content_hash = n.content_hash then 'common' else 'hash_diff' end as state, count(*) as n
    from old o full join new n on o.path = n.path group by 1""")
def corpus_equivalence(spark, sf_dir):
    return index.corpus_equivalence(*states(spark, sf_dir))


@query(f"with {LINES_SQL}, n as (select doc_id, count(*) as n from lines group by 1) select module, count(*) as files, coalesce(sum(n), 0)::bigint as lines, sum(size)::bigint as bytes from files left join n using (doc_id) group by 1")
def census(spark, sf_dir):
    files, lines, _ = corpus(spark, sf_dir)
    return index.census(files, lines)


@query(f"""with {SYMBOLS_SQL} select module, count(*) as files, count(*) filter (doc_id not in (select file from symbols)) as without,
    round(count(*) filter (doc_id not in (select file from symbols)) / count(*), 6) as rate from files group by 1""")
def unresolved_rate(spark, sf_dir):
    files, _, symbols = corpus(spark, sf_dir)
    return index.unresolved_rate(files, symbols)


DOCTOR_SQL = ", ".join(f"('{s}', {n}, {'null' if index.ADVICE[s] is None else repr(index.ADVICE[s])}, {s == 'ok'})" for s, n in (("ok", "(select count(*) from documents)"), ("missing", "null"), ("empty", "0"), ("corrupt", "null"), ("incompatible", "null")))


@query(f"select * from (values {DOCTOR_SQL}) d(state, n_files, advice, can_serve)")
def doctor(spark, sf_dir):
    """A stored snapshot in each state that can be told apart."""
    base, out = fresh_path(spark, "doctor"), None
    snap = index.snapshot(document_files(table(spark, sf_dir, "documents")))
    snap.write.parquet(f"{base}/ok")
    snap.where("false").write.parquet(f"{base}/empty")
    snap.select("path").write.parquet(f"{base}/incompatible")
    spark.createDataFrame([("no table",)], "value string").write.text(f"{base}/corrupt")
    for state in ("ok", "missing", "empty", "corrupt", "incompatible"):
        row = index.doctor(spark, f"{base}/{state}").select("state", "n_files", "advice", "can_serve")
        out = row if out is None else out.unionByName(row)
    return out


def fulltext_states(spark, sf_dir):
    """Documents before and after a change: some are edited, some removed, some added."""
    d, i = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    return d.where(i % 11 != 5), d.where(i % 13 != 4).withColumn("text", F.concat("text", F.when(i % 7 == 0, " edited word").otherwise("")))


@query("""with n as (select doc_id as doc, regexp_extract_all(lower(coalesce(text, '') || case when doc_id % 7 = 0 then ' edited word' else '' end), '[\\p{L}\\p{N}]+') as w from documents where doc_id % 13 <> 4)
    select term, doc, count(*) as tf, any_value(len(w))::int as dl from (select doc, w, unnest(w) as term from n) group by 1, 2 union all select '', doc, 1, len(w)::int from n""")
def index_maintained(spark, sf_dir):
    """The inverted index after a change, by difference; the twin builds it anew."""
    old, new = fulltext_states(spark, sf_dir)
    hashed = lambda df: df.select(F.col("doc_id").cast("string").alias("path"), T.content_hash(F.col("text")).alias("content_hash"))
    diff = index.incremental_diff(hashed(old), hashed(new)).where("state <> 'skipped'").select(F.col("path").cast("long").alias("doc_id"))
    before = fresh_path(spark, "fulltext")
    fulltext.write(fulltext.postings(old), before)
    return fulltext.maintained(spark.read.parquet(before), diff, new.join(diff, "doc_id", "left_semi"))
