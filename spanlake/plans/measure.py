"""Queries on graphs, markup and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import graph as G
from spanlake.operators import measure as M
from spanlake.plans.registry import query
from spanlake.plans.retrieve import BM25_SQL, CONT_SQL, ranked, truth
from spanlake.sources.corpus import table, written

EDGE_SQL = """edges as (select distinct 'c' || o_custkey as src, 'p' || l_partkey as dst from orders join lineitem on o_orderkey = l_orderkey
    union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem union select distinct 's' || s_suppkey, 'n' || s_nationkey from supplier)"""
PAIR_SQL = "pairs(src, dst) as (values ('c1', 'n3'), ('c1', 's5'), ('c7', 'p20'), ('p3', 'n1'), ('p3', 'c1'), ('n1', 'n1'))"
PAIRS = [("c1", "n3"), ("c1", "s5"), ("c7", "p20"), ("p3", "n1"), ("p3", "c1"), ("n1", "n1")]


def edges(spark, sf_dir):
    """Customer to part, part to supplier, supplier to nation."""
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("src"), name("p", "l_partkey").alias("dst"))
    b = li.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    return a.union(b).union(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).distinct()


@query(f"""with {EDGE_SQL}, t as (select distinct x.src as a, x.dst as b, y.dst as c from edges x join edges y on x.dst = y.src where y.dst <> x.src), r as (select *, row_number() over (partition by a order by b, c) as r from t)
    select a, b, c from r where r <= 8""")
def two_hop(spark, sf_dir):
    return G.two_hop(edges(spark, sf_dir))


@query(f"""with recursive {EDGE_SQL}, {PAIR_SQL}, w as (select src as start, src as node, [src] as path from (select distinct src from pairs)
      union all select start, dst, list_append(path, dst) from w join edges on node = edges.src where len(path) <= 4 and not list_contains(path, dst)),
    h as (select p.src, p.dst, path, row_number() over (partition by p.src, p.dst order by len(path), path) as r from w join pairs p on p.src = w.start and p.dst = w.node where len(path) > 1)
    select src, dst, array_to_string(path, '>') as path, (len(path) - 1)::int as hops from h where r = 1""")
def trace_bfs(spark, sf_dir):
    spark_pairs = spark.createDataFrame(PAIRS, "src string, dst string")
    return G.shortest_paths(edges(spark, sf_dir), spark_pairs).select("src", "dst", F.array_join("path", ">").alias("path"), "hops")


@query(f"""with recursive {EDGE_SQL}, {PAIR_SQL}, w as (select src, dst, [src] as path from pairs
      union all select w.src, w.dst, list_append(path, e.dst) from w join edges e on path[len(path)] = e.src where len(path) <= 3 and path[len(path)] <> w.dst or len(path) = 1 and path[1] = e.src),
    s as (select distinct * from w where len(path) > 1 and len(list_distinct(path)) = len(path) and path[len(path)] = dst)
    select src, dst, array_to_string(path, '>') as path from s""")
def simple_paths(spark, sf_dir):
    p = G.simple_paths(edges(spark, sf_dir), spark.createDataFrame(PAIRS, "src string, dst string"))
    return p.select("src", "dst", F.array_join("path", ">").alias("path"))


@query("""with f as (select 'm/src/main/java/x/C' || doc_id || '.java' as path from documents where doc_id % 3 <> 0 union all select 'm/src/test/java/x/C' || doc_id || 'Test.java' from documents where doc_id % 2 = 0)
    select t.path as test_path, m.path as main_path, 0.9::double as confidence from f t join f m on m.path = replace(replace(t.path, '/src/test/', '/src/main/'), 'Test.java', '.java') where t.path like '%Test.java'""")
def test_links(spark, sf_dir):
    """Tests and the files they mirror, where both exist; paths are made from document numbers."""
    d = table(spark, sf_dir, "documents")
    name = lambda a, b: F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)).alias("path")
    f = d.where("doc_id % 3 <> 0").select(name("m/src/main/java/x/C", ".java")).union(d.where("doc_id % 2 = 0").select(name("m/src/test/java/x/C", "Test.java")))
    mirrored = F.regexp_replace(F.regexp_replace("path", "/src/test/", "/src/main/"), r"Test\.java$", ".java")
    t = f.where(F.col("path").endswith("Test.java")).select(F.col("path").alias("test_path"), mirrored.alias("main_path"))
    return t.join(f.select(F.col("path").alias("main_path")), "main_path").select("test_path", "main_path", F.lit(0.9).alias("confidence"))


@query("""with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as target from pages), u as (select distinct regexp_replace(url, '^[a-z]+://[^/]*', '') as path from pages)
    select page_id, target, count(*) as n, bool_or(path is not null) as resolved, max(case when path is not null then 1.0 else 0.5 end)::double as confidence from h left join u on path = target group by 1, 2""")
def page_includes(spark, sf_dir):
    """Links of every page; those to another page's path are resolved."""
    p = table(spark, sf_dir, "pages")
    h = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))
    u = p.select(F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("target")).distinct().withColumn("_r", F.lit(True))
    return h.join(u, "target", "left").select("page_id", "target", "n", F.col("_r").isNotNull().alias("resolved"), F.when(F.col("_r"), 1.0).otherwise(0.5).alias("confidence"))


TIME_SQL = "t as (select o_orderkey as run, (case when o_orderkey % 9 = 0 then '?' else floor(o_totalprice)::bigint::varchar end) || ' ' || (case when o_custkey % 7 = 0 then 'N/A' else o_custkey::varchar end) || ' ' || length(o_orderpriority) as line from orders)"


@query(f"with {TIME_SQL} select run, try_cast(split_part(line, ' ', 1) as double) as wall_s, try_cast(split_part(line, ' ', 2) as double) as max_rss, try_cast(split_part(line, ' ', 3) as double) as faults from t")
def parse_time_line(spark, sf_dir):
    """Timing lines made from orders; ``?`` and ``N/A`` are null."""
    o = table(spark, sf_dir, "orders")
    wall = F.when(F.col("o_orderkey") % 9 == 0, "?").otherwise(F.floor("o_totalprice").cast("string"))
    rss = F.when(F.col("o_custkey") % 7 == 0, "N/A").otherwise(F.col("o_custkey").cast("string"))
    line = F.concat_ws(" ", wall, rss, F.length("o_orderpriority").cast("string"))
    part = lambda k: F.expr(f"try_cast(split_part(line, ' ', {k}) as double)")
    return o.select(F.col("o_orderkey").alias("run"), line.alias("line")).select("run", part(1).alias("wall_s"), part(2).alias("max_rss"), part(3).alias("faults"))


@query("""select 'py' as impl, c_custkey as id, c_acctbal::double as declared_tokens, null::bigint as declared_bytes, c_nationkey::bigint as units from customer
    union all select 'rs', s_suppkey, s_acctbal, length(s_name), null from supplier""")
def normalise_envelopes(spark, sf_dir):
    """Two shapes of envelopes in one schema; what a shape lacks is null, never 0."""
    a = table(spark, sf_dir, "customer").select(F.lit("py").alias("impl"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("declared_tokens"), F.col("c_nationkey").cast("long").alias("units"))
    b = table(spark, sf_dir, "supplier").select(F.lit("rs").alias("impl"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("declared_tokens"), F.length("s_name").cast("long").alias("declared_bytes"))
    return a.unionByName(b, allowMissingColumns=True).select("impl", "id", "declared_tokens", "declared_bytes", "units")


SCALES = [1, 10, 30, 100]


@query("""select n::int as scale, c::int as copy, count(*) as files, sum(n_chars)::bigint as chars, min('copy' || c || '/' || doc_id) as first_path from documents, (values (1), (10), (30), (100)) s(n), lateral (select unnest(range(n)) as c) x group by 1, 2""")
def scale_copies(spark, sf_dir):
    """The corpus 1, 10, 30 and 100 times under different prefixes; each row is repeated by its task, nothing is joined."""
    each = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(F.lit(n).alias("scale"), c.alias("copy")))
    copies = F.flatten(F.array(*[each(n) for n in SCALES]))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(copies).alias("x")).select("doc_id", "n_chars", "x.*")
    return d.groupBy("scale", "copy").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.min(F.concat(F.lit("copy"), F.col("copy").cast("string"), F.lit("/"), F.col("doc_id").cast("string"))).alias("first_path"))


@query("select l_returnflag as grp, l_linestatus as impl, count(l_extendedprice) as n, min(l_extendedprice) as min, median(l_extendedprice) as p50, quantile_disc(l_extendedprice, 0.95) as p95, max(l_extendedprice) as max, round(avg(l_extendedprice), 6) as mean from lineitem group by 1, 2")
def summarize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("impl"), F.col("l_extendedprice").alias("v"))
    return M.summarize(li, ["grp", "impl"], "v")


@query("select l_suppkey, quantile_disc(l_quantity, 0.5) as p50, quantile_disc(l_quantity, 0.9) as p90, quantile_disc(l_quantity, 0.99) as p99, median(l_quantity) as med from lineitem group by 1")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(M.nearest_rank("l_quantity", 0.5).alias("p50"), M.nearest_rank("l_quantity", 0.9).alias("p90"), M.nearest_rank("l_quantity", 0.99).alias("p99"), F.median("l_quantity").alias("med"))


@query("select l_suppkey, l_quantity as value from (select *, count(*) over (partition by l_suppkey) as n, row_number() over (partition by l_suppkey order by l_quantity) as r from lineitem) where r = least(n - 1, floor(n * 0.95)) + 1")
def quantile_floor_index(spark, sf_dir):
    return M.floor_index(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 0.95)


@query("""with m as (select l_returnflag, l_suppkey, median(l_extendedprice) filter (l_linestatus = 'F') as a, median(l_extendedprice) filter (l_linestatus = 'O') as b from lineitem group by 1, 2)
    select l_returnflag, l_suppkey, a, b, round(a / b, 6) as ratio from m where a is not null and b <> 0""")
def paired_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_linestatus", "l_extendedprice")
    return M.paired_ratio(li, ["l_returnflag", "l_suppkey"], "l_linestatus", ("F", "O"), "l_extendedprice")


@query("""select l_linestatus as impl, count(*) as runs, median(floor(l_extendedprice / nullif(l_quantity, 0) * 10000) / 10000) as ratio_p50, max(floor(l_extendedprice / nullif(l_quantity, 0) * 10000) / 10000) as ratio_max, count(*) filter (l_quantity > 45) as over_limit from lineitem group by 1""")
def budget_fidelity(spark, sf_dir):
    """The ratio is taken run by run and then summarised."""
    r = F.floor(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0)) * 10000) / 10000
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("impl"), r.alias("r"), "l_quantity")
    return li.groupBy("impl").agg(F.count("*").alias("runs"), F.median("r").alias("ratio_p50"), F.max("r").alias("ratio_max"), F.count_if(F.col("l_quantity") > 45).alias("over_limit"))


@query(f"""with {BM25_SQL}, {CONT_SQL}, bg(budget) as (values (500), (1000), (2000), (4000), (8000)),
    r as (select item_id, doc_id, sum(greatest(1, n_chars // 4)) over (partition by item_id order by rank) as used from bm join documents using (doc_id) where rank <= 20),
    q as (select budget, b.item_id, coalesce(max(r.used) filter (r.used <= budget), 0) as used, count(gt.doc_id) filter (r.used <= budget) > 0 as hit from bg cross join (select distinct item_id from gt) b join r on r.item_id = b.item_id left join gt on gt.item_id = r.item_id and gt.doc_id = r.doc_id group by 1, 2)
    select budget, count(*) as queries, round(avg(hit::int), 6) as hit_rate, round(avg(used), 6) as avg_used from q group by 1""")
def budget_curve(spark, sf_dir):
    """Share of items whose passage is delivered, by budget."""
    from pyspark.sql import Window

    t = truth(spark, sf_dir).withColumn("_t", F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("cost"))
    r = ranked(spark, sf_dir).join(d, "doc_id").withColumn("used", F.sum("cost").over(Window.partitionBy("item_id").orderBy("rank")))
    r = r.join(t.select("item_id").distinct(), "item_id", "left_semi").join(t, ["item_id", "doc_id"], "left")
    each = r.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (500, 1000, 2000, 4000, 8000)])))
    fits = F.col("used") <= F.col("budget")
    q = each.groupBy("budget", "item_id").agg(F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("used"), (F.count(F.when(fits, F.col("_t"))) > 0).alias("hit"))
    return q.groupBy("budget").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg("used"), 6).alias("avg_used"))


def scored_sql(delivered: str) -> str:
    return f"""d as (select distinct item_id, doc_id from ({delivered})), fo as (select coalesce(d.item_id, g.item_id) as item_id, d.doc_id as dd, g.doc_id as gg from d full join gt g on d.item_id = g.item_id and d.doc_id = g.doc_id),
    score as (select item_id, count(dd) as n_delivered, count(gg) as n_expected, count(case when dd is not null and gg is not null then 1 end) as n_common from fo group by 1),
    sd as (select *, case when n_expected > 0 then n_common > 0 end as hit, round(n_common / nullif(n_expected, 0), 6) as recall, round(n_common / nullif(n_delivered, 0), 6) as precision from score)"""


TOP_SQL = "select item_id, doc_id from bm where rank <= 20"


@query(f"with {BM25_SQL}, {CONT_SQL}, {scored_sql(TOP_SQL)} select * from sd")
def score_delivery(spark, sf_dir):
    return M.score_delivery(ranked(spark, sf_dir), truth(spark, sf_dir))


@query(f"""with {BM25_SQL}, {CONT_SQL}, gv as (select item_id, min(doc_id) as doc_id from gt group by 1), ex as (select gt.* from gt anti join gv using (item_id, doc_id)),
    nv as (select item_id, doc_id from bm anti join gv using (item_id, doc_id) where rank <= 20), k as (select item_id from bm where rank <= 20 union select item_id from gt),
    s as (select k.item_id, (select count(*) from nv where nv.item_id = k.item_id) as novel, (select count(*) from ex where ex.item_id = k.item_id) as expected, (select count(*) from nv join ex using (item_id, doc_id) where nv.item_id = k.item_id) as found from k)
    select *, round(found / nullif(expected, 0), 6) as recall, case when expected = 0 then novel = 0 end as abstained from s""")
def score_additional(spark, sf_dir):
    """The first document with the passage counts as given."""
    t, top = written(truth(spark, sf_dir), "truth"), written(ranked(spark, sf_dir).select("item_id", "doc_id"), "top")
    given = t.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return M.score_additional(top, t.join(given, ["item_id", "doc_id"], "left_anti"), given)


@query(f"with {BM25_SQL}, {CONT_SQL}, {scored_sql(TOP_SQL)} select count(*) as queries, count(recall) as measured, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision from sd")
def macro_scores(spark, sf_dir):
    s = M.score_delivery(ranked(spark, sf_dir), truth(spark, sf_dir))
    return s.agg(F.count("*").alias("queries"), F.count("recall").alias("measured"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))


@query("select o_orderstatus as state, o_orderpriority as category, count(*) as n from orders group by rollup(1, 2)")
def state_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@query("""select l_returnflag as grp, max(p50) filter (impl = 'F') as f_p50, max(p50) filter (impl = 'O') as o_p50 from (select l_returnflag, l_linestatus as impl, median(l_quantity) as p50 from lineitem group by 1, 2) group by 1""")
def report_pivot(spark, sf_dir):
    """The report's table: groups down, implementations across."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).pivot("l_linestatus", ["F", "O"]).agg(F.median("l_quantity"))
    return p.select("grp", F.col("F").alias("f_p50"), F.col("O").alias("o_p50"))
