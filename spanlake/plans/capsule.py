"""Queries on strategies, their cascade, and capsules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import capsule as C
from spanlake.operators import fulltext
from spanlake.operators import retrieve as R
from spanlake.plans.registry import SYMBOLS_SQL, corpus, query
from spanlake.plans.retrieve import BM25_SQL, CONT_SQL, ranked, truth
from spanlake.sources.corpus import stored, table, written

BUDGET = 2000
EXCERPT_SQL = "left(regexp_replace({}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), 200)"
WORD_SQL = "list_filter(list_distinct(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(w, '^[?,.]+|[?,.]+$', '', 'g'))), lambda w: w <> '')"
# A document's first line counts as its class-like declaration.
STRUCT_SQL = f"""{SYMBOLS_SQL}, asked as (select item_id, unnest({WORD_SQL}) as word from benchmark), sy as (select name, case when line = 1 then 'class' else 'head' end as kind, file, line from symbols),
    nm as (select item_id, name, kind, file, line from asked join sy on name = word), ex as (select * from (select *, row_number() over (partition by item_id, name order by file, line) as r from nm) where r <= 3),
    hd as (select distinct item_id, name from nm where kind = 'class'), st2 as (select item_id, file as doc_id from nm where kind = 'class' or (item_id, name) not in (select (item_id, name) from hd) union select item_id, file from ex)"""


def items(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """The requests, or some of them."""
    b = table(spark, sf_dir, "benchmark")
    return b if only is None else b.join(only, "item_id", "left_semi")


def asked(spark, sf_dir, only=None) -> DataFrame:
    return items(spark, sf_dir, only).select("item_id", F.explode(C.words(F.col("text"))).alias("word"))


def symbols(spark, sf_dir) -> DataFrame:
    """The stored table of the documents' names, sorted by name."""
    found = corpus(spark, sf_dir)[2].select("name", F.when(F.col("line") == 1, "class").otherwise("head").alias("kind"), "file", "line")
    return stored(spark, "symbols", f"{sf_dir}/documents.parquet", lambda path: found.repartitionByRange("name", "file").sortWithinPartitions("name").write.parquet(path))


def structural(spark, sf_dir) -> DataFrame:
    return C.structural(symbols(spark, sf_dir), asked(spark, sf_dir), "item_id").select("item_id", F.col("file").alias("doc_id"))


def lexical(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir).select("item_id", "doc_id")


@query(f"""with t as (select item_id, {WORD_SQL.replace("list_distinct(", "(")} as l from benchmark) select item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as words from t""")
def query_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(C.words(F.col("text")), " ").alias("words"))


@query(f"with {STRUCT_SQL} select * from st2")
def s_structural(spark, sf_dir):
    return structural(spark, sf_dir)


def hybrid(spark, sf_dir) -> DataFrame:
    return R.union_distinct(structural(spark, sf_dir), lexical(spark, sf_dir))


@query(f"with {STRUCT_SQL}, {BM25_SQL} select item_id, doc_id from st2 union select item_id, doc_id from bm where rank <= 20")
def s_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir)


SYMBOL_RANK_SQL = """yd as (select distinct name, file from symbols), yw as (select name, file, regexp_extract_all(lower(name || ' head ' || file), '[\\p{L}\\p{N}]+') as w from yd), ys as (select count(*) as n, avg(len(w)) as av from yw),
    yq as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark), yp as (select term, name, file, len(w) as dl, count(*) as tf from (select name, file, w, unnest(w) as term from yw) where term in (select term from yq) group by all),
    yi as (select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, av from yp, ys group by term, n, av),
    yc as (select item_id, name, file, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) as score from yp join yi using (term) join yq using (term) group by all),
    yr as (select *, row_number() over (partition by item_id order by score, name || '#' || file)::int as rank from yc),
    scored as (select item_id, name, case when line = 1 then 'class' else 'head' end as kind, file, line, score, rank from yr join symbols using (name, file) where rank <= 20)"""


def scored_names(spark, sf_dir, only=None) -> DataFrame:
    """Names ranked as texts of name, kind and file, from a stored index of them, with all their places."""
    doc = F.concat_ws("#", "name", F.col("file").cast("string")).alias("doc")

    def write(path):
        named = symbols(spark, sf_dir).select("name", "file").distinct()
        fulltext.write(fulltext.postings(named.select(doc, F.concat_ws(" ", "name", F.lit("head"), F.col("file").cast("string")).alias("text")), "doc"), path)

    index = stored(spark, "names", f"{sf_dir}/documents.parquet", write)
    top = fulltext.search(index, R.query_terms(items(spark, sf_dir, only), key="item_id"), 20, doc="doc", key="item_id")
    return top.join(symbols(spark, sf_dir).select("*", doc), "doc").select("item_id", "name", "kind", "file", "line", "score", "rank")


@query(f"with {SYMBOLS_SQL}, {SYMBOL_RANK_SQL} select item_id, name, file, line, score, rank from scored")
def bm25_symbols(spark, sf_dir):
    """A name several times in a file gives several rows."""
    return scored_names(spark, sf_dir).select("item_id", "name", "file", "line", "score", "rank")


def mentions(spark, sf_dir):
    """The lines and the stored index of the documents' identifiers; a frequent one is spread over many files."""
    lines = corpus(spark, sf_dir)[1]
    index = stored(spark, "identifiers", f"{sf_dir}/documents.parquet", lambda path: C.identifiers(lines).repartitionByRange("token", "doc").sortWithinPartitions("token").write.parquet(path))
    return index, lines


CAPSULE_SQL = f"""{STRUCT_SQL}, {SYMBOL_RANK_SQL}, code as (select * from asked where regexp_matches(word, '[A-Z_]') or length(word) > 8),
    mn as (select c.word, l.doc_id as doc, l.line from (select word from asked union select name from scored) c join lines l on contains(l.text, c.word)), fm as (select *, row_number() over (partition by word order by doc, line) as r from mn), md as (select distinct word, doc from mn),
    rf as (select c.item_id, c.word, fm.doc, fm.line from fm join code c using (word) where r <= 30), hl as (select distinct rf.item_id, rf.doc, md.word from rf join code c using (item_id) join md on md.word = c.word and md.doc = rf.doc), hn as (select item_id, doc, count(*) as held from hl group by 1, 2),
    cn as (select item_id, count(*) as total from code group by 1), co as (select rf.* from rf join hn using (item_id, doc) join cn using (item_id) where total = 1 or held > 1),
    b0 as (select item_id, name, kind, file, line, 1 as tier, score, 0 as p from scored union all select item_id, name, kind, file, line, 0, -1.0::double, 1 from ex union all select item_id, word, 'ref', doc, line, 0, 0.0::double, 2 from co),
    b1 as (select * exclude (r) from (select *, row_number() over (partition by item_id, name, file, line order by p) as r from b0) where r = 1),
    b2 as (select * exclude (p) from b1 union all select distinct a.item_id, word, 'ref', doc, line, 0, 0.0::double from fm join asked a using (word) where r <= 10 and a.item_id not in (select item_id from b1)),
    r1 as (select *, row_number() over (partition by item_id order by tier, score, file, line, name) as rank from b2), best as (select distinct item_id, name from r1 where rank <= 8),
    hop as (select best.item_id, best.name, fm.doc as file, fm.line from fm join best on fm.word = best.name anti join b2 on b2.item_id = best.item_id and b2.name = best.name and b2.file = fm.doc and b2.line = fm.line where fm.r <= 5),
    caps as (select *, row_number() over (partition by item_id order by tier, score, file, line, name)::int as rank from (select item_id, name, kind, file, line, tier, score from b2 union all select item_id, name, 'ref', file, line, 1, 0.0::double from hop))"""


def capsule(spark, sf_dir, only=None) -> DataFrame:
    index, lines = mentions(spark, sf_dir)
    find = lambda words: C.mentions(index, lines, words)
    first = lambda words, most: C.progressive(index, lines, words, most)
    inside = lambda df, docs, key: df.join(docs.select(F.col("doc").alias(key)), key, "left_semi")
    within = lambda words, docs: C.mentions(inside(index, fulltext.small(docs), "doc"), inside(lines, fulltext.small(docs), "doc_id"), words)
    return C.rank(asked(spark, sf_dir, only), symbols(spark, sf_dir), scored_names(spark, sf_dir, only), find, "item_id", first, within)


@query(f"with {CAPSULE_SQL} select item_id, name, kind, file, line, tier, score, rank from caps")
def capsule_rank(spark, sf_dir):
    """Exact names, mentions of code-like words that occur together, ranked names, and mentions of the best candidates' names."""
    return capsule(spark, sf_dir).select("item_id", "name", "kind", "file", "line", "tier", "score", "rank")


COST_SQL = "greatest(1, length(file || ':' || {line} || ' ' || {kind} || ' ' || {name} || ' :: ' || {text}) // 4)::int"
PACK_SQL = f"""{CAPSULE_SQL}, tx as (select doc_id as file, line, {EXCERPT_SQL.format("text")} as text from lines), ct as (select c.*, tx.text from caps c join tx using (file, line) where kind not in ('class', 'interface', 'enum') or contains(tx.text, c.name)),
    cd as (select ct.*, sy.line as dl, sy.kind as dk, sy.name as dn from ct asof left join (select file, line, max(kind) as kind, max(name) as name from sy group by 1, 2) sy on ct.file = sy.file and ct.line >= sy.line),
    ce as (select cd.*, {COST_SQL.format(line="cd.line", kind="kind", name="name", text="cd.text").replace("(file ||", "(cd.file ||")} as cost, case when contains(td.text, dn) then {COST_SQL.format(line="dl", kind="dk", name="dn", text="td.text").replace("(file ||", "(cd.file ||")} end as dcost from cd left join tx td on td.file = cd.file and td.line = cd.dl),
    pk as (select item_id, row_number() over (partition by item_id order by rank)::int as p, file::varchar as f, file || ':' || line as here, cost, file || ':' || dl as decl, dcost from ce),
    g as (select item_id, policy, 0 as p, 0 as used, []::varchar[] as kept, []::varchar[] as files, 0 as over from (select distinct item_id from pk), (values ('one_per_file'), ('multi'), ('expanded')) v(policy)
      union all select g.item_id, policy, pk.p, case when room then u2 + dcost else u2 end, case when room then list_append(k2, decl) else k2 end, case when fits then list_append(files, f) else files end, over + (wanted and not fits)::int + (more and not room)::int
        from g join pk on pk.item_id = g.item_id and pk.p = g.p + 1, lateral (select not list_contains(kept, here) and (policy <> 'one_per_file' or not list_contains(files, f)) as wanted) x,
        lateral (select wanted and used + cost <= {BUDGET} as fits) y, lateral (select case when fits then used + cost else used end as u2, case when fits then list_append(kept, here) else kept end as k2, coalesce(policy = 'expanded' and fits and dcost is not null and decl <> here and not list_contains(kept, decl), false) as more) z,
        lateral (select coalesce(more and u2 + dcost <= {BUDGET}, false) as room) q),
    packed as (select item_id, policy, used, kept, over from g where p = (select max(p) from pk where pk.item_id = g.item_id))"""


def candidates(spark, sf_dir, only=None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), T.lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return written(C.with_text(written(capsule(spark, sf_dir, only), "capsule"), docs, symbols(spark, sf_dir), "item_id"), "capsule")


@query(f"with recursive {PACK_SQL} select policy, item_id, used, array_to_string(kept, ' ') as kept, over from packed")
def capsule_pack(spark, sf_dir):
    """The three policies over the same candidates."""
    cands, out = candidates(spark, sf_dir), None
    for policy in ("one_per_file", "multi", "expanded"):
        rows = C.pack(cands, BUDGET, policy, "item_id").select(F.lit(policy).alias("policy"), "item_id", "used", F.array_join("kept", " ").alias("kept"), "over")
        out = rows if out is None else out.unionByName(rows)
    return out


def hybrid_refs(spark, sf_dir, only=None) -> DataFrame:
    """Files of the packed capsule."""
    kept = C.pack(candidates(spark, sf_dir, only), BUDGET, "multi", "item_id")
    return kept.select("item_id", F.explode("kept").alias("k")).select("item_id", F.split_part("k", F.lit(":"), F.lit(1)).cast("long").alias("doc_id")).distinct()


REFS_SQL = f"{PACK_SQL}, hr as (select distinct item_id, split_part(k, ':', 1)::bigint as doc_id from (select item_id, unnest(kept) as k from packed where policy = 'multi'))"


@query(f"with recursive {REFS_SQL} select * from hr")
def s_hybrid_refs(spark, sf_dir):
    return hybrid_refs(spark, sf_dir)


ROUTER_SQL = f"""{REFS_SQL}, {BM25_SQL}, lv as (select item_id, doc_id, 0 as l from st2 union all select item_id, doc_id, 1 from bm where rank <= 20), seen as (select item_id, doc_id, min(l) as l from lv group by 1, 2),
    per as (select item_id, count(*) filter (l = 0) as n0, count(*) as n1 from seen group by 1),
    router as (select item_id, doc_id, l as level from seen join per using (item_id) where n0 >= 3 and l = 0 or n0 < 3 and n1 >= 3
      union all select item_id, doc_id, 2 from hr where item_id not in (select item_id from per where n0 >= 3 or n1 >= 3))"""


def router(spark, sf_dir) -> DataFrame:
    return R.cascade(items(spark, sf_dir), [structural(spark, sf_dir), lexical(spark, sf_dir)], lambda rest: hybrid_refs(spark, sf_dir, rest), "item_id")


@query(f"with recursive {ROUTER_SQL} select * from router")
def s_router(spark, sf_dir):
    """Structural results; where they are fewer than three also ranked ones; where these are too few, the capsule's files instead."""
    return router(spark, sf_dir)


#: Strategies by name: each gives (item_id, doc_id).
STRATEGIES = {"lexical": lexical, "structural": structural, "hybrid": hybrid, "hybrid_refs": hybrid_refs, "router": lambda spark, d: router(spark, d).select("item_id", "doc_id")}


def bake_sql(name: str, rows: str) -> str:
    return f"select '{name}' as strategy, count(*) as items, count(*) filter (x.item_id is not null) as hits from (select distinct item_id from gt) g left join (select distinct gt.item_id from gt join ({rows}) d on d.item_id = gt.item_id and d.doc_id = gt.doc_id) x on x.item_id = g.item_id"


BAKE = {"lexical": "select item_id, doc_id from bm where rank <= 20", "structural": "select * from st2", "hybrid": "select * from st2 union select item_id, doc_id from bm where rank <= 20", "hybrid_refs": "select * from hr", "router": "select item_id, doc_id from router"}


@query(f"with recursive {ROUTER_SQL}, {CONT_SQL} select strategy, items, hits, round(hits / items, 6) as hit_rate from (" + " union all ".join(bake_sql(k, v) for k, v in BAKE.items()) + ")")
def bakeoff(spark, sf_dir):
    """Hit rates of the strategies over items whose passage stands in some document; what several strategies share is found once."""
    t = written(truth(spark, sf_dir), "truth")
    items, out = t.select("item_id").distinct(), None
    ways = {"lexical": written(lexical(spark, sf_dir), "lexical"), "structural": written(structural(spark, sf_dir), "structural"), "hybrid_refs": written(hybrid_refs(spark, sf_dir), "refs")}
    ways["hybrid"] = R.union_distinct(ways["structural"], ways["lexical"])
    ways["router"] = R.cascade(table(spark, sf_dir, "benchmark"), [ways["structural"], ways["lexical"]], lambda rest: ways["hybrid_refs"].join(rest, "item_id", "left_semi"), "item_id").select("item_id", "doc_id")
    for name in STRATEGIES:
        hit = t.join(ways[name], ["item_id", "doc_id"]).select("item_id").distinct().withColumn("_h", F.lit(1))
        row = items.join(hit, "item_id", "left").agg(F.count("*").alias("items"), F.count("_h").alias("hits")).select(F.lit(name).alias("strategy"), "items", "hits")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.col("items"), 6))


@query(f"""with {STRUCT_SQL}, {BM25_SQL}, f as (select b.item_id, (select count(*) from st2 s where s.item_id = b.item_id) as seeds, (select count(*) from bm x where x.item_id = b.item_id and rank <= 20) as lexical,
      (select min(score) from bm x where x.item_id = b.item_id) as top from benchmark b)
    select *, case when seeds = 0 and lexical = 0 then 'abstain' when seeds = 0 or lexical = 0 or top > -1 then 'uncertain' else 'answer' end as decision from f""")
def abstain_gate(spark, sf_dir):
    s = structural(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("seeds"))
    x = ranked(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("lexical"), F.min("score").alias("top"))
    b = table(spark, sf_dir, "benchmark").select("item_id").join(s, "item_id", "left").join(x, "item_id", "left").fillna(0, ["seeds", "lexical"])
    return b.withColumn("decision", R.abstain(F.col("seeds"), F.col("lexical"), F.col("top")))


