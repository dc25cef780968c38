"""Queries on ranking, strategies and modules; every benchmark item is a query, all in one job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import fulltext
from spanlake.operators import retrieve as R
from spanlake.plans.registry import LINES_SQL, SYMBOLS_SQL, corpus, fulltext_index, query
from spanlake.sources.corpus import table, written

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
DF_SQL = f"""df as (select term, count(*) as df from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'))) as term from documents) where term not in ({STOP_SQL}) group by 1)"""
BAND_SQL = "case when df <= 1 then '1' when df <= 5 then '2-5' when df <= 20 then '6-20' when df <= 100 then '21-100' else '>100' end"


@query(f"with {DF_SQL} select * from df")
def doc_freq(spark, sf_dir):
    return R.document_frequency(table(spark, sf_dir, "documents"))


@query(f"with {DF_SQL} select {BAND_SQL} as stratum, count(*) as n_terms, sum(df)::bigint as n_postings from df group by 1")
def df_strata(spark, sf_dir):
    df = R.document_frequency(table(spark, sf_dir, "documents"))
    return df.groupBy(R.df_stratum(F.col("df")).alias("stratum")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))


@query(f"""with {DF_SQL}, s as (select {BAND_SQL} as stratum, term, df from df), r as (select *, row_number() over (partition by stratum order by term) - 1 as i, count(*) over (partition by stratum) as n from s)
    select stratum, term, df from r where n <= 6 or list_contains(list_transform(range(6), lambda x: round_even(x * (n - 1) / 5.0, 0)::int), i::int)""")
def evenly_spaced(spark, sf_dir):
    """Six terms of each band, as the feature is a sample."""
    df = R.document_frequency(table(spark, sf_dir, "documents")).withColumn("stratum", R.df_stratum(F.col("df")))
    return R.evenly_spaced(df, "stratum", "term", 6).select("stratum", "term", "df")


BM25_SQL = """w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
    dl as (select doc_id, len(w) as dl from w), st as (select count(*) as n, avg(dl) as av from dl),
    qt as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark),
    post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(w) as term from w) where term in (select term from qt) group by 1, 2),
    idf as (select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, av from post, st group by term, n, av),
    sc as (select item_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) as score from post join idf using (term) join dl using (doc_id) join qt using (term) group by 1, 2),
    bm as (select *, row_number() over (partition by item_id order by score, doc_id) as rank from sc)"""


def item_terms(spark, sf_dir):
    return R.query_terms(table(spark, sf_dir, "benchmark"), key="item_id")


def ranked(spark, sf_dir, k=20):
    return fulltext.search(fulltext_index(spark, sf_dir), item_terms(spark, sf_dir), k, key="item_id")


@query(f"with {BM25_SQL} select item_id, doc_id, score, rank::int as rank from bm where rank <= 20")
def bm25_topk(spark, sf_dir):
    """The flagship: the 20 best documents for every item."""
    return ranked(spark, sf_dir).select("item_id", "doc_id", "score", "rank")


@query("""with qw as (select item_id, regexp_extract_all(text, '[A-Za-z0-9]+') as q from benchmark), rq as (select item_id, [lower(q[2]) || ' ' || lower(q[3]), lower(q[5]) || ' ' || lower(q[6]) || ' ' || lower(q[7]), lower(q[1])] as q from qw where len(q) >= 7),
    w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents), st as (select count(*) as n, avg(len(w)) as av from w), qt as (select distinct item_id, unnest(q) as term from rq), wp as (select doc_id, unnest(w) as t, unnest(range(len(w))) as i, len(w) as dl from w), gr as (select doc_id, dl, t, lead(t) over x as t2, lead(t, 2) over x as t3 from wp window x as (partition by doc_id order by i)),
    gs as (select doc_id, dl, t as term from gr union all select doc_id, dl, t || ' ' || t2 from gr union all select doc_id, dl, t || ' ' || t2 || ' ' || t3 from gr), hit as (select term, doc_id, dl, count(*) as tf from gs where term in (select term from qt) group by 1, 2, 3),
    idf as (select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, av from hit, st group by term, n, av),
    sc as (select item_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) as score from hit join idf using (term) join qt using (term) group by 1, 2)
    select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score, doc_id)::int as rank from sc) where rank <= 20""")
def bm25_phrases(spark, sf_dir):
    """Requests of identifiers: an underscore joins words that must stand side by side."""
    docs = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("q")).where(F.size("q") >= 7)
    part = lambda *at: F.concat_ws("_", *[F.get("q", k - 1) for k in at])
    terms = fulltext.asked_terms(q.select("item_id", F.concat_ws(" ", part(2, 3), part(5, 6, 7), part(1)).alias("text")), key="item_id")
    return fulltext.search(fulltext.with_phrases(fulltext_index(spark, sf_dir), docs, terms), terms, 20, key="item_id").select("item_id", "doc_id", "score", "rank")


@query()
def bm25_topk_porter(spark, sf_dir):
    docs = R.porter_terms(table(spark, sf_dir, "documents"))
    items = R.porter_terms(table(spark, sf_dir, "benchmark"), keep=("item_id",)).select("item_id", F.explode(F.array_distinct("terms")).alias("term"))
    return R.bm25(docs, items, 20, key="item_id", tokens=F.col("terms"))


CONT_SQL = "gt as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def truth(spark, sf_dir):
    """(item_id, doc_id): documents that contain an item's passage."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return fulltext.containing(fulltext_index(spark, sf_dir), items, table(spark, sf_dir, "documents"), key="item_id")


@query(f"""with {LINES_SQL}, {BM25_SQL}, top as (select item_id, doc_id from bm where rank <= 8),
    hd as (select t.item_id, t.doc_id, regexp_extract(l.text, '^[ \\t]*([A-Za-z_][A-Za-z0-9_]*)', 1) as name from top t join lines l on l.doc_id = t.doc_id and l.line = 1),
    h as (select h.item_id, h.doc_id as seed, s.doc_id, s.line, row_number() over (partition by h.item_id, h.doc_id order by s.doc_id, s.line) as r
      from hd h join (select doc_id, line, regexp_extract(text, '^[ \\t]*([A-Za-z_][A-Za-z0-9_]*)', 1) as name from lines) s on s.name = h.name and s.doc_id <> h.doc_id where h.name <> '')
    select item_id, seed, doc_id, line from h where r <= 5""")
def expand_1hop(spark, sf_dir):
    """For the 8 best documents of an item, up to 5 lines elsewhere that begin with the document's first word."""
    top = fulltext.small(written(ranked(spark, sf_dir, 8).select("item_id", F.col("doc_id").alias("seed")), "top"))
    symbols = corpus(spark, sf_dir)[2].select("name", "file", "line")
    head = written(symbols.where("line = 1").select(F.col("file").alias("seed"), "name").join(top, "seed"), "heads")
    hops = head.join(R.first_places(symbols.join(fulltext.small(head.select("name").distinct()), "name", "left_semi"), 5), "name").where("file <> seed")
    w = Window.partitionBy("item_id", "seed").orderBy("file", "line")
    return hops.withColumn("_r", F.row_number().over(w)).where("_r <= 5").select("item_id", "seed", F.col("file").alias("doc_id"), "line")


@query("select source as module, count(*) as n_docs, array_to_string(list_sort(list(doc_id))[1:20], ',') as first_docs from documents group by 1")
def module_map(spark, sf_dir):
    """Modules with their number of documents and the first 20; the list is of a report's size."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), "doc_id")
    n = d.groupBy("module").agg(F.count("*").alias("n_docs"))
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy("module").orderBy("doc_id"))).where("_r <= 20").groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_docs"))
    first = first.withColumnRenamed("module", "_m")
    return n.join(first, F.col("module").eqNullSafe(F.col("_m"))).select("module", "n_docs", "first_docs")


@query(f"""with {BM25_SQL}, seed as (select item_id, source, rank from bm join documents using (doc_id) where rank <= 20),
    m as (select item_id, source, min(rank) as best from seed group by 1, 2), pick as (select item_id, source from (select *, row_number() over (partition by item_id order by best, source) as r from m) where r <= 2),
    c as (select item_id, p.source as module, b.doc_id, row_number() over (partition by item_id, p.source order by b.rank) as r from pick p join (select bm.*, source from bm join documents using (doc_id) where rank <= 20) b using (item_id, source))
    select item_id, module, doc_id, r::int as position from c""")
def module_select(spark, sf_dir):
    """The two modules that hold an item's best documents, and those documents."""
    top = ranked(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("module")), "doc_id").where("module is not null")
    best = top.groupBy("item_id", "module").agg(F.min("rank").alias("best"))
    pick = best.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("best", "module"))).where("_r <= 2").select("item_id", "module")
    inside = top.join(pick, ["item_id", "module"])
    return inside.select("item_id", "module", "doc_id", F.row_number().over(Window.partitionBy("item_id", "module").orderBy("rank")).alias("position"))


@query(f"""with {BM25_SQL}, c as (select item_id, item_id as doc_id, 0 as source, 1 as p from benchmark union all select item_id, doc_id, 1, rank from bm where rank <= 20),
    o as (select *, row_number() over (partition by item_id, doc_id order by source, p) as r from c)
    select item_id, doc_id, source, row_number() over (partition by item_id order by source, p, doc_id)::int as position from o where r = 1""")
def candidate_order(spark, sf_dir):
    """The document of an item's number counts as its known reference."""
    known = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("doc_id"), F.lit(1).alias("position"))
    return R.candidate_order(known, ranked(spark, sf_dir), "item_id").select("item_id", "doc_id", "source", "position")
