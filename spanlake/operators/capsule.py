"""Capsules: candidates of many queries ranked together, and their packing under a budget.

Candidates of a query are names it holds exactly, places that mention its
code-like words, and names found by full-text ranking.  Mentions come from a stored
index of identifiers: a word can only stand in a line one of whose identifiers
contains it, so words are compared with the vocabulary and not with every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators.index import first_of
from spanlake.operators.lookup import MAX_NEEDLES
from spanlake.sources.corpus import written

#: Kinds that define, and how many candidates each step takes.
DEFINING = ["class", "interface", "enum"]
EXACT, MENTIONS, FALLBACK, EXPANDED, HOPS = 3, 30, 10, 8, 5


def words(c: Column) -> Column:
    """Words between blanks without ``?``, ``,`` and ``.`` at their ends, each once."""
    parts = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[?,.]+|[?,.]+$", ""))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def code_like(word: Column) -> Column:
    return word.rlike("[A-Z_]") | (F.length(word) > 8)


def identifiers(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, doc, line): the identifiers of every line; stored sorted by token, it serves all requests."""
    return lines.select(F.explode(T.tokens(F.col("text"))).alias("token"), F.col(key).alias("doc"), "line")


def mentions(index: DataFrame, lines: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, doc, line): every line that contains a word literally.

    ``words`` (with ``word``) are a request's, bounded and checked.  A word's longest
    run of identifier characters is looked for within identifiers; words with other
    characters are then compared with the lines found, and words without any such run
    with all lines.
    """
    runs = F.regexp_extract_all(F.col("word"), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    asked = words.select("word", F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit("")).alias("run")).distinct()
    asked = written(asked, "words")
    n = asked.agg(F.count("*").alias("n"), F.count_if(F.col("run") != F.col("word")).alias("mixed"), F.count_if(F.col("run") == "").alias("none")).first()
    if n["n"] > MAX_NEEDLES:
        raise ValueError(f"more than {MAX_NEEDLES} words at once; split the request")
    asked = F.broadcast(asked)
    found = index.select("token").distinct().join(asked.where("run <> ''"), F.contains(F.col("token"), F.col("run"))).select("token", "word", "run")
    hits = index.join(found, "token").select("word", "run", "doc", "line").distinct()
    out = hits.where("word = run").select("word", "doc", "line")
    texts = lines.select(F.col(key).alias("doc"), "line", "text")
    if n["mixed"]:
        out = out.unionByName(hits.where("word <> run").join(texts, ["doc", "line"]).where(F.contains(F.col("text"), F.col("word"))).select("word", "doc", "line"))
    if n["none"]:
        out = out.unionByName(texts.join(asked.where("run = ''"), F.contains(F.col("text"), F.col("word"))).select("word", "doc", "line"))
    return out


def first_mentions(found: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("word").orderBy("doc", "line")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def progressive(index: DataFrame, lines: DataFrame, words: DataFrame, most: int, key: str = "doc_id", shares: tuple[float, ...] = (1 / 4096, 1 / 64)) -> DataFrame:
    """``first_mentions`` of ``mentions``, without those of a frequent word beyond its first.

    Places come in the order of documents (numbers), so a word that has ``most``
    among the first documents needs no others; only the rest go on to more of them.
    """
    left, out = written(words.select("word").distinct(), "words"), None
    edges = lines.agg(F.percentile_approx(key, list(shares), 10_000)).first()[0] or []
    for edge in [*edges, None]:
        part = (index, lines) if edge is None else (index.where(F.col("doc") <= edge), lines.where(F.col(key) <= edge))
        found = written(first_mentions(mentions(*part, left, key), most), "mentions")
        done = found.groupBy("word").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("word")
        if edge is not None:
            found = found.join(done, "word", "left_semi")
            left = written(left.join(done, "word", "left_anti"), "words")
        out = found if out is None else out.unionByName(found)
    return out


def structural(symbols: DataFrame, asked: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, file): files of the first exact names of each word, and of its definitions; without a definition all of that name."""
    named = symbols.select("name", "kind", "file", "line").join(asked.select(key, F.col("word").alias("name")), "name")
    defines = F.col("kind").isin(DEFINING)
    has = named.where(defines).select(key, "name").distinct().withColumn("_has", F.lit(True))
    return named.join(has, [key, "name"], "left").where(defines | F.col("_has").isNull()).select(key, "file").unionByName(exact(symbols, asked, key).select(key, "file")).distinct()


def exact(symbols: DataFrame, asked: DataFrame, key: str = "query_id", most: int = EXACT) -> DataFrame:
    """The first names by file and line that equal a word of the query."""
    w = Window.partitionBy(key, "name").orderBy("file", "line")
    j = symbols.select("name", "kind", "file", "line").join(asked.select(key, F.col("word").alias("name")), "name")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(key, "name", "kind", "file", "line")


def rank(asked: DataFrame, symbols: DataFrame, scored: DataFrame, find, key: str = "query_id", first=None, within=None) -> DataFrame:
    """Candidates of each query in order: key, name, kind, file, line, tier, score, rank.

    ``asked`` has (key, word); ``scored`` the names found by full-text ranking (key,
    name, kind, file, line, score); ``find(words)`` gives ``mentions``, and where
    there are cheaper ways ``first(words, most)`` gives the first of each word and
    ``within(words, docs)`` those in some documents.  Tier 0 are
    exact names and mentions of code-like words in files that hold another such word
    of the query; tier 1 ranked names and, for the best candidates, mentions of their
    names.  A query without any candidate gets the first mentions of all its words.
    """
    first = first or (lambda words, most: first_mentions(find(words), most))
    within = within or (lambda words, docs: find(words).join(docs, "doc", "left_semi"))
    cols = [key, "name", "kind", "file", "line", "tier", "score"]
    put = lambda df, tier, score, kind=None: df.select(key, "name", (F.lit(kind) if kind else F.col("kind")).alias("kind"), "file", "line", F.lit(tier).alias("tier"), score.alias("score"))
    named = exact(symbols, asked, key)
    code = asked.where(code_like(F.col("word"))).select(key, "word").distinct()
    found = written(first(code.select("word").distinct(), MENTIONS), "mentions")
    refs = found.join(code, "word")
    files = written(found.select("doc").distinct(), "files")
    holds = within(code.select("word").distinct(), files).select("word", "doc").distinct()
    # code-like words of the query that the file holds: the mentioned one and at least another, if the query has another
    held = refs.select(key, "doc").distinct().join(code, key).join(holds, ["word", "doc"]).groupBy(key, "doc").agg(F.count("*").alias("_held"))
    total = code.groupBy(key).agg(F.count("*").alias("_total"))
    refs = refs.join(held, [key, "doc"]).join(total, key).where("_total = 1 or _held > 1")
    refs = refs.select(key, F.col("word").alias("name"), F.col("doc").alias("file"), "line")
    both = put(scored, 1, F.col("score")).unionByName(put(named, 0, F.lit(-1.0))).unionByName(put(refs, 0, F.lit(0.0), "ref"))
    # a place that ranking found keeps its tier and score
    place = [key, "name", "file", "line"]
    both = written(first_of(both, place, [F.when(F.col("tier") == 1, 0).when(F.col("kind") != "ref", 1).otherwise(2)]), "named")
    bare = asked.join(both.select(key).distinct(), key, "left_anti")
    lost = first(bare.select("word").distinct(), FALLBACK).join(bare, "word").select(key, F.col("word").alias("name"), F.col("doc").alias("file"), "line")
    both = written(both.select(cols).unionByName(put(lost.distinct(), 0, F.lit(0.0), "ref")), "candidates")
    order = ["tier", "score", "file", "line", "name"]
    numbered = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    best = numbered(both).where(F.col("rank") <= EXPANDED).select(key, "name").distinct()
    hops = first(best.select(F.col("name").alias("word")).distinct(), HOPS).join(best.withColumnRenamed("name", "word"), "word")
    hops = hops.select(key, F.col("word").alias("name"), F.col("doc").alias("file"), "line").join(both.select(*place), place, "left_anti")
    return numbered(both.select(cols).unionByName(put(hops, 1, F.lit(0.0), "ref")))


def item_cost(file: Column, line: Column, kind: Column, name: Column, text: Column) -> Column:
    return T.token_estimate(F.concat(file.cast("string"), F.lit(":"), line.cast("string"), F.lit(" "), kind, F.lit(" "), name, F.lit(" :: "), text))


def with_text(ranked: DataFrame, docs: DataFrame, declarations: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """Adds each candidate's excerpt, whether it can be delivered, its cost and its enclosing declaration.

    ``docs`` has file and lines; ``declarations`` file, line, kind, name of which the
    last at or before a place encloses it.
    """
    j = ranked.join(docs.select("file", "lines"), "file")
    at = lambda line: T.excerpt(F.get("lines", line - 1))
    j = j.withColumn("text", at(F.col("line"))).where("text is not null")
    if declarations is not None:
        d = F.struct(F.col("line").alias("at"), F.col("kind").alias("what"), F.col("name").alias("who"))
        own = declarations.groupBy("file").agg(F.sort_array(F.collect_list(d)).alias("_d"))  # the declarations of one file
        j = j.join(own, "file", "left").withColumn("decl", F.try_element_at(F.filter("_d", lambda x: x["at"] <= F.col("line")), F.lit(-1))).drop("_d")
        j = j.withColumn("decl_text", at(F.col("decl.at")))
        j = j.withColumn("decl_cost", F.when(F.contains(F.col("decl_text"), F.col("decl.who")), item_cost(F.col("file"), F.col("decl.at"), F.col("decl.what"), F.col("decl.who"), F.col("decl_text"))))
    else:
        j = j.withColumn("decl", F.lit(None).cast("struct<at: int, what: string, who: string>")).withColumn("decl_cost", F.lit(None).cast("int"))
    ok = F.contains(F.col("text"), F.col("name")) | ~F.col("kind").isin(DEFINING)
    return j.where(ok).withColumn("cost", item_cost(F.col("file"), F.col("line"), F.col("kind"), F.col("name"), F.col("text"))).drop("lines")


def pack(cands: DataFrame, budget: int, policy: str = "multi", key: str = "query_id") -> DataFrame:
    """Per query ``used``, the places ``kept`` (file:line, in order) and how many are ``over`` budget.

    Candidates are taken in order; one that doesn't fit is passed over and later ones
    may fit.  A place is kept once.  ``one_per_file`` keeps the first that fits of
    each file; ``expanded`` adds the enclosing declaration of what is kept, if that
    fits too.  An ordered fold over the query's bounded candidates.
    """
    if policy not in ("one_per_file", "multi", "expanded"):
        raise ValueError(policy)
    items = F.sort_array(F.collect_list(F.struct("rank", "file", "line", "cost", F.col("decl.at").alias("decl_line"), "decl_cost")))
    place = lambda file, line: F.concat(file.cast("string"), F.lit(":"), line.cast("string"))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("kept"), F.expr("cast(array() as array<string>)").alias("files"), F.lit(0).alias("over"))

    def step(s, x):
        file, here = x["file"].cast("string"), place(x["file"], x["line"])
        wanted = ~F.array_contains(s["kept"], here)
        if policy == "one_per_file":
            wanted = wanted & ~F.array_contains(s["files"], file)
        fits = wanted & (s["used"] + x["cost"] <= budget)
        used = s["used"] + F.when(fits, x["cost"]).otherwise(0)
        kept = F.when(fits, F.concat(s["kept"], F.array(here))).otherwise(s["kept"])
        over = s["over"] + F.when(wanted & ~fits, 1).otherwise(0)
        if policy == "expanded":
            decl = place(x["file"], x["decl_line"])
            more = fits & x["decl_cost"].isNotNull() & (decl != here) & ~F.array_contains(s["kept"], decl)
            room = more & (used + x["decl_cost"] <= budget)
            used, kept, over = used + F.when(room, x["decl_cost"]).otherwise(0), F.when(room, F.concat(kept, F.array(decl))).otherwise(kept), over + F.when(more & ~room, 1).otherwise(0)
        return F.struct(used.alias("used"), kept.alias("kept"), F.when(fits, F.concat(s["files"], F.array(file))).otherwise(s["files"]).alias("files"), over.alias("over"))

    return cands.groupBy(key).agg(items.alias("_i")).select(key, F.aggregate("_i", start, step).alias("s")).select(key, "s.used", "s.kept", "s.over")
