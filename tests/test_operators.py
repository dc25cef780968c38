"""Small cases with known results, invariants, and plans that must keep their shape."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.functions.porter import stem
from spanlake.operators import accounting as A
from spanlake.operators import evaluate as E
from spanlake.operators import graph as G
from spanlake.operators import history as H
from spanlake.operators import index as I
from spanlake.operators import measure as M
from spanlake.operators import pack as P
from spanlake.operators import retrieve as R
from spanlake.sources import corpus as C


def one(spark, *exprs):
    return tuple(spark.range(1).select(*exprs).first())


def test_text_primitives(spark):
    lit = F.lit
    assert one(spark, T.tokens(lit("a.b.c")), T.tokens(lit("###")), T.tokens(lit("_x1")), T.tokens(lit("dup dup other"))) == (["a", "b", "c"], [], ["_x1"], ["dup", "other"])
    assert one(spark, T.lines(lit("a\r\nb\n")), T.lines(lit("")), T.lines(lit("x\n\ny"))) == (["a", "b"], [], ["x", "", "y"])
    assert one(spark, T.focus_terms(lit("Sign Motion, with-password?"))) == (["motion", "password", "sign", "with"],)
    assert one(spark, T.content_hash(lit("abc")))[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, T.language(lit("x.PY")), T.language(lit("Makefile")), T.language(lit("a/b.yml")), T.language(lit("a.b/c"))) == ("python", None, "yaml", None)
    assert one(spark, T.ascii_lower(lit("AÉ")), T.excerpt(lit("\t a b \n")), T.token_estimate(lit("")), T.byte_estimate(lit("éé"))) == ("aÉ", "a b", 1, 1)
    assert one(spark, T.path_safe(lit("a/b")), T.path_safe(lit("/a")), T.path_safe(lit("a/../b")), T.path_safe(lit("a..b"))) == (True, False, False, True)
    ref = one(spark, T.parsed_ref(lit("a:b.c:12@sha256:ABC")), T.parsed_ref(lit("a.c:3")), T.parsed_ref(lit("a.c")))
    assert tuple(ref[0]) == ("a:b.c", 12, "abc") and tuple(ref[1]) == ("a.c", 3, None) and tuple(ref[2]) == (None, None, None)
    assert one(spark, T.case_counts(lit("1/2 passed\n2/3 passed")), T.case_counts(lit("none"))) == ((2, 3), (None, None))
    assert one(spark, T.matches_any(lit("a/b/c.java"), ["a/*.java"]), T.matches_any(lit("b/c.java"), ["a/*"])) == (True, False)
    assert one(spark, T.patch_paths(lit("diff --git a/x b/y\nrename to z\ndiff --git a/y b/y\n"))) == (["y", "z"],)


def test_porter():
    cases = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "été": "été"}
    assert {w: stem(w) for w in cases} == cases


def test_bm25_equals_full_text_engine(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table d using fts5(text, tokenize=\"unicode61 remove_diacritics 0\")")
    con.executemany("insert into d(rowid, text) values (?, ?)", [(r.doc_id + 1, r.text) for r in docs.collect()])
    q = spark.createDataFrame([(1, "licensed under the license"), (2, "zu und die"), (3, "nothing_here xyzzy")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, R.query_terms(q), k=10_000).collect()}
    want = {}
    for k, words in ((1, ["licensed", "under", "the", "license"]), (2, ["zu", "und", "die"]), (3, ["nothing", "here", "xyzzy"])):
        for rowid, score in con.execute("select rowid, bm25(d) from d where d match ?", (" OR ".join(f'"{w}"' for w in words),)):
            want[k, rowid - 1] = score
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_spans(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 3)], "doc_id string, n_lines int")
    lines = lambda rows: spark.createDataFrame(rows, "doc_id string, line int")
    spans = lambda rows, ctx: sorted((r.doc_id, r.start, r.end) for r in P.match_spans(lines(rows), sizes, ["doc_id"], ctx=ctx).collect())
    assert spans([("a", 10), ("a", 12)], 2) == [("a", 8, 14)]
    assert spans([("b", 1)], 6) == [("b", 1, 3)]
    assert spans([("a", 10), ("a", 100)], 2) == [("a", 8, 12), ("a", 98, 100)]
    assert spans([("a", 10), ("a", 15)], 2) == [("a", 8, 17)] and spans([("a", 10), ("a", 16)], 2) == [("a", 8, 12), ("a", 14, 18)]
    s = spark.createDataFrame([("a", 1, 130)], "doc_id string, start int, end int")
    assert sorted((r.start, r.end) for r in P.sliced(s, ["doc_id"]).collect()) == [(1, 60), (61, 120), (121, 130)]
    cover = spark.createDataFrame([("a", 1, 5), ("a", 50, 60), ("a", 129, 200)], "doc_id string, start int, end int")
    assert sorted((r.start, r.end) for r in P.subtract_covered(s, cover, ["doc_id"]).collect()) == [(6, 49), (61, 128)]
    assert P.overlaps(s, cover, ["doc_id"]).count() == 3


@pytest.mark.parametrize("budget", [0, 500, 1000, 2000, 8000])
def test_budgets_hold(spark, budget):
    units = spark.createDataFrame([(q, k, (k * 37 + q * 11) % 700, k % 2 == 0) for q in range(5) for k in range(1, 12)], "q int, position int, cost int, lexical boolean")
    costs = {(r.q, r.position): r.cost for r in units.collect()}
    for r in P.greedy_pack(units, "q", budget).collect():
        used, kept, over = 0, [], []
        for k in range(1, 12):
            (kept if used + costs[r.q, k] <= budget else over).append(k)
            used += costs[r.q, k] if kept and kept[-1] == k else 0
        assert (r.used, r.kept, r.over) == (used, kept, over) and r.used <= budget
    for r in P.prefix_budget(units, "q", budget).collect():
        assert r.used == sum(costs[r.q, k] for k in range(1, r.position + 1)) <= budget
    for r in P.evidence_reserve(units, "q", budget, 40).collect():
        assert r.used <= budget and r.used_plain <= budget * 60 // 100


def test_incremental_equals_rebuild(spark):
    f = lambda rows: I.snapshot(spark.createDataFrame(rows, "path string, body string"))
    old, new = f([("a", "1"), ("b", "2"), ("c", "3")]), f([("a", "1"), ("b", "2!"), ("d", "3")])
    assert {(r.path, r.state) for r in I.incremental_diff(old, new).collect()} == {("a", "skipped"), ("b", "changed"), ("c", "gone"), ("d", "new")}
    assert I.generation_hash(I.incremental_apply(old, new)).first() == I.generation_hash(new).first()
    assert I.generation_hash(old).first() != I.generation_hash(new).first()


def test_files_and_discovery(spark, tmp_path):
    (tmp_path / "target").mkdir()
    for name, content in {"ok.py": b"x = 1\n", "bin.py": b"a\0b", "x.unknown": b"?", "big.java": b"y" * 4096, "target/t.py": b"z", "bad.md": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(content)
    found = C.files(spark, str(tmp_path)).withColumn("head", F.substring("body", 1, 8192))
    got = {r.path: r.reason for r in C.discover(found, include=["python", "java"], max_bytes=1024).collect()}
    assert got == {"ok.py": "kept", "bin.py": "binary", "x.unknown": "unsupported", "big.java": "too_large", "target/t.py": "excluded", "bad.md": "excluded_by_filter"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\n{"a": broken\n{"a": 2}\n')
    assert sorted(r.a for r in C.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int").collect()) == [1, 2]
    df = spark.createDataFrame([(1, None)], "b int, a string")
    C.write_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":null,"b":1}'
    for body in ("x", "y"):  # the second replaces the first
        C.write_snapshot(I.snapshot(spark.createDataFrame([("p", body)], "path string, body string")), f"file://{tmp_path}/s")
    assert [r.content_hash for r in C.read_snapshot(spark, f"file://{tmp_path}/s").collect()] == [one(spark, T.content_hash(F.lit("y")))[0]]
    assert I.doctor(spark, str(tmp_path / "s" / "version-*")).first().state == "ok" and I.doctor(spark, str(tmp_path / "none")).first().state == "missing"
    assert "| b | a |" in C.markdown(df)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")], "src string, dst string")
    p = spark.createDataFrame([("a", "d"), ("a", "f"), ("b", "e"), ("a", "a"), ("f", "a")], "src string, dst string")
    got = {(r.src, r.dst): r.path for r in G.shortest_paths(e, p, 4).collect()}
    assert got == {("a", "d"): ["a", "c", "d"], ("a", "f"): ["a", "c", "d", "e", "f"], ("b", "e"): ["b", "c", "d", "e"]}
    assert {tuple(r.path) for r in G.simple_paths(e, p, 3).collect()} == {("a", "c", "d"), ("a", "b", "c", "d"), ("b", "c", "d", "e")}
    assert {tuple(r) for r in G.two_hop(e).where("a = 'a'").collect()} == {("a", "b", "c"), ("a", "c", "d")}
    hub = spark.createDataFrame([("x", "h"), ("y", "h")] + [("h", f"n{k:02d}") for k in range(30)] + [("h", "x")], "src string, dst string")
    assert [r.c for r in G.two_hop(hub, 3).where("a = 'x'").orderBy("c").collect()] == ["n00", "n01", "n02"]


def test_scores(spark):
    pair = lambda rows: spark.createDataFrame(rows, "item_id int, doc_id string")
    r = M.score_delivery(pair([(1, "a"), (2, "a"), (2, "b"), (2, "x"), (2, "y"), (3, "q")]), pair([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"), (2, "b")]))
    got = {x.item_id: (x.hit, x.recall, x.precision) for x in r.collect()}
    assert got == {1: (True, 0.25, 1.0), 2: (True, 1.0, 0.5), 3: (None, None, 0.0)}
    s = M.score_additional(pair([(1, "g"), (1, "a"), (2, "g")]), pair([(1, "a")]), pair([(1, "g"), (2, "g")]))
    assert {x.item_id: (x.novel, x.recall, x.abstained) for x in s.collect()} == {1: (1, 1.0, None), 2: (0, None, True)}
    v = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "k int, v double")
    assert tuple(M.summarize(v, ["k"], "v").first())[3:5] == (2.5, 4.0) and M.floor_index(v, ["k"], "v", 0.5).first().value == 3.0
    gate = {(0, 0, None): "abstain", (0, 18, 0.0): "uncertain", (2, 20, -15.0): "answer", (0, 20, -4.5): "uncertain"}
    rows = spark.createDataFrame([(*k, w) for k, w in gate.items()], "s int, l int, t double, want string")
    assert rows.where(R.abstain(F.col("s"), F.col("l"), F.col("t")) != F.col("want")).count() == 0


def test_cascade_is_per_query(spark):
    level = lambda rows: spark.createDataFrame(rows, "q int, d int")
    last = level([(1, 0), (3, 4), (4, 6)])
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "q int")
    out = R.cascade(queries, [level([(1, 1), (1, 2), (1, 3), (2, 9), (3, 1)]), level([(1, 7), (2, 8), (2, 5), (3, 2)])], lambda rest: last.join(rest, "q", "left_semi"), "q")
    assert {(r.q, r.d, r.level) for r in out.collect()} == {(1, 1, 0), (1, 2, 0), (1, 3, 0), (2, 9, 0), (2, 8, 1), (2, 5, 1), (3, 4, 2), (4, 6, 2)}


def event(i, kind, attempt=1, source="executor", tool=None, request=None, status="ok", error=None, reason=None, tokens=None, latency=None, cost=None, size=None):
    t = dict.fromkeys(A.TOKENS) | (tokens or {})
    return (attempt, i, float(i), source, kind, tool, request, status, error, reason, tuple(t[x] for x in A.TOKENS), latency, cost, size)


#: 2 model calls (1 ok, 1 error), 105 input tokens, latency 1150 in all and 900 at most, one price, one retry, one tool call of 42 bytes, one turn.
GOLDEN = [
    event(1, "model_call", request="r1", tokens={"input": 100.0, "output": 20.0}, latency=250.0, cost=(0.02, "USD")), event(2, "model_call", request="r2", status="error", error="timeout", tokens={"input": 5.0}, latency=900.0),
    event(3, "retry"), event(4, "tool_call", tool="shell", size=42), event(5, "turn"),
]
#: A repeated request, events of the shim, violating ones (one with a request id that a valid call has later), one without a source, two currencies, an unknown kind.
ODD = [
    event(1, "model_call", 2, request="r1", tokens={"input": 100.0}, cost=(0.02, "USD")), event(2, "model_call", 2, request="r1", tokens={"input": 999.0}, cost=(9.0, "EUR")), event(3, "model_call", 2, request=" ", tokens={"input": 5.0}),
    event(4, "model_call", 2, source="shim", request="r9", tokens={"input": 7.0}), event(5, "tool_call", 2, source="shim", tool="shell"), event(6, "opened", 2), event(7, "model_call", 2, tool="reader", request="r2", tokens={"input": 50.0}),
    event(8, "model_call", 2, request="r2", tokens={"input": 1.0}, cost=(1.0, "EUR")), event(9, "turn", 2, source=None), event(10, "opened", 2, source=None), event(11, "error", 2, error=""), event(12, "strange", 2), event(13, "stop", 2, reason="done"),
    event(14, "stop", 2, reason="budget"), event(15, "stop", 2, reason=" "), event(16, "opened", 3), event(17, "tool_call", 3, tool="reader"), event(18, "tool_call", 4, source="shim"), event(19, "turn", 5, source=None),
]


def test_accounting(spark, tmp_path):
    df = spark.createDataFrame(GOLDEN + ODD, A.EVENT)
    r = {x.attempt: x.asDict() for x in A.account(df).collect()}
    want = {"events": 5, "model_calls": 2, "calls_ok": 1, "calls_error": 1, "errors": 1, "error_classes": "timeout=1", "retries": 1, "input_tokens": 105.0, "output_tokens": 20.0, "cache_read_tokens": None, "reasoning_tokens": None, "latency_total": 1150.0, "latency_max": 900.0, "latency_n": 2, "cost": 0.02, "currency": "USD", "calls_with_cost": 1, "calls_without_cost": 1, "tool_calls": 1, "tools": "shell=1", "delivered_bytes": 42, "turns": 1, "violations": 0, "stop_reason": None, "duplicates": 0}
    assert {k: r[1][k] for k in want} == want
    want = {"events": 10, "unattributed": 1, "model_calls": 3, "calls_ok": 3, "input_tokens": 106.0, "cost": 1.02, "currency": "USD", "calls_with_cost": 2, "calls_without_cost": 1, "tool_calls": 0, "delivered_bytes": None, "tools": "", "turns": 1, "errors": 1, "error_classes": "unclassed=1", "stop_reason": "budget", "stop_reasons": "budget=1,done=1", "duplicates": 1, "violations": 5}
    assert {k: r[2][k] for k in want} == want
    assert (r[3]["violations"], r[3]["events"], r[3]["tool_calls"], r[3]["tools"], r[3]["model_calls"], r[3]["turns"]) == (2, 0, None, "", None, None)
    assert (r[4]["events"], r[4]["tool_calls"], r[4]["violations"]) == (0, None, 0) and (r[5]["unattributed"], r[5]["turns"], r[5]["errors"]) == (1, 1, None)
    from spanlake.streaming import accounting as S

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    live = {k: v for k, v in r.items() if k != 4}  # the stream keeps a row for the shim's attempt too
    for part in (df.where("event_id <= 7"), df.where("event_id > 7")):  # the state carries over from run to run
        part.coalesce(1).write.mode("append").json(folder)
        S.run_available(S.accounted(S.event_stream(spark, folder)), out, str(tmp_path / "state"), "update")
    got = {x.attempt: x.asDict() for x in S.latest(spark, out).collect()}
    assert {k: got[k] for k in live} == live and got[4]["events"] == 0
    batch = {(x.attempt, x.event_id, x.reason) for x in A.ceiling_hit(df, 6.5, 0, 9).collect()}
    S.run_available(S.ceilings(S.event_stream(spark, folder), 6.5, 0, 9), str(tmp_path / "stops"), str(tmp_path / "state2"))
    stops = {tuple(x) for x in spark.read.parquet(str(tmp_path / "stops")).select("attempt", "event_id", "reason").collect()}
    assert batch == stops and (1, 4, "tool_calls") in batch and (2, 5, "tool_calls") in batch


def test_price_lists_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([event(1, "model_call", tool="m", tokens={"input": 1e6, "output": 5e5}), event(2, "model_call", tool="m", source="shim", tokens={"input": 1e6})], A.EVENT)
    prices = spark.createDataFrame([("m", "input", 2.0), ("m", "output", 4.0)], "model string, field string, per_million double")
    assert tuple(A.call_cost(df, prices).first()) == (1, 4.0, 0)
    assert tuple(A.call_cost(df, prices.where("field = 'input'")).first()) == (1, None, 1)
    monkeypatch.setattr(A, "MOST_PRICES", 1)
    with pytest.raises(ValueError):
        A.call_cost(df, prices)


def test_stored_products_follow_their_table(spark, tmp_path):
    import shutil

    made, source = [], f"file://{tmp_path}/t"

    def write(path):
        made.append(path)
        spark.read.parquet(source).groupBy("k").count().write.parquet(path)

    rows = lambda: sorted(map(tuple, C.stored(spark, "count", source, write).collect()))
    spark.createDataFrame([(1,), (1,)], "k int").write.parquet(source)
    assert rows() == rows() == [(1, 2)] and len(made) == 1
    spark.createDataFrame([(2,)], "k int").write.mode("append").parquet(source)  # another state of the table
    assert rows() == [(1, 2), (2, 1)] and len(made) == 2
    shutil.rmtree(made[-1].removeprefix("file:").replace("///", "/"))  # a cleared folder
    assert rows() == [(1, 2), (2, 1)] and len(made) == 3


def test_tail_takes_whole_lines_once(spark, tmp_path):
    from spanlake.streaming.tail import TailReader, follow

    path = f"file://{tmp_path}/log.jsonl"
    seen = []
    for text in ("a\nb", "a\nb\nlonger line\n", "a\nb\nlonger line\nx\ny"):
        C.put_text(spark, path, text)
        follow(spark, path, str(tmp_path / "out"), str(tmp_path / "state"))
        seen.append(sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [["a"], ["a", "b", "longer line"], ["a", "b", "longer line", "x"]]
    r, at, lines = TailReader(path, 2), {"at": 0}, []
    while True:
        got, end = r.read(at)
        if end == at:
            break
        assert [*r.readBetweenOffsets(at, end)] == (some := [*got])
        lines, at = lines + [x[0] for x in some], end
    assert lines == ["a", "b", "longer line", "x"]


def test_delivered_sizes_are_those_of_the_answer(spark):
    """Budgets of all sizes against a plain search that serialises every prefix."""
    import json

    lines = ["é" * (k % 7) + f' "line" {k}\t' for k in range(12)]
    units = [(q, p, f"f{p}", 1, 4 + p % 3, "ab" * 32, "\n".join(lines[: 4 + p % 3]), "tokens=x", f"rank {p}") for q in (1, 2) for p in range(1, 6 + q)]
    u = spark.createDataFrame(units, "q int, position int, file string, start int, end int, digest string, text string, evidence string, reason string")
    base = spark.createDataFrame([(1, 0, [], [], False), (2, 2, ["stale_source"], ["expand: g"], True), (3, 0, [], [], False)], "q int, dropped long, reasons array<string>, hints array<string>, stale boolean")
    unit = lambda r, text, end, cut: {"file": r[2], "line": r[3], "end_line": end, "hash": r[5], "text": text, "evidence": r[7], "reason": r[8], "truncated": cut}

    def answer(b, kept, rest, omitted, extra, tokens, most):
        reasons = sorted(set(b[2] + extra))
        state = "stale" if b[4] else "partial" if omitted or reasons or any(x["truncated"] for x in kept) else "ok"
        hints = (b[3] + [f"expand: {r[2]}" for r in rest])[:5]
        if not hints and not b[2] and not [r for r in units if r[0] == b[0]]:
            hints = ["no match: widen the query"]
        used = 0
        while True:
            doc = {"schema": "context/1", "state": state, "units": kept, "budget": {"requested_tokens": tokens, "max_bytes": most, "used_tokens": used // 4, "used_bytes": used}, "omitted": {"n": omitted, "reasons": reasons}, "hints": hints}
            n = len(json.dumps(doc, separators=(",", ":"), ensure_ascii=False).encode())
            if n == used:
                return state, len(kept), n, n // 4, omitted, ",".join(reasons), " | ".join(hints), next((x["end_line"] for x in kept if x["truncated"]), None)
            used = n

    for tokens, most in ((60, 9000), (100, 9000), (250, 1000), (2000, 1300), (300, 9000), (390, 9000), (450, 1790), (9000, 9000)):
        got = {r.q: tuple(r)[1:] for r in P.deliver(u, base, "q", tokens, most).collect()}
        for b in base.collect():
            mine = [r for r in units if r[0] == b.q]
            fits = lambda a: a[2] <= most and a[3] <= tokens
            tries = [answer(b, [unit(r, r[6], r[4], False) for r in mine[:k]], mine[k:], b.dropped + len(mine) - k, ["budget"] if k < len(mine) else [], tokens, most) for k in range(len(mine) + 1)]
            best = max((k for k, a in enumerate(tries) if fits(a)), default=None)
            if best is None:
                assert got[b.q][1] == 0 and "envelope_too_large" in got[b.q][5]
                continue
            want = tries[best]
            if best < len(mine):
                r, text = mine[best], mine[best][6].split("\n")
                for keep in (len(text) * 3 // 4, len(text) // 2, len(text) // 4):
                    if 0 < keep < len(text):
                        cut = answer(b, [unit(x, x[6], x[4], False) for x in mine[:best]] + [unit(r, "\n".join(text[:keep]), r[3] + keep - 1, True)], mine[best + 1 :], b.dropped + len(mine) - best - 1, ["budget"], tokens, most)
                        if fits(cut):
                            want = cut
                            break
            assert got[b.q] == want, (tokens, most, b.q)


def test_capsule(spark):
    from spanlake.operators import capsule as K

    texts = {1: "class Motion\n  uses Sign_Key here\n  and Motion", 2: "class Sign_Key\n  Motion of it", 3: "nothing\n  über-wort steht", 4: "class Other\n  Sign_Key alone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lines = C.line_scan(docs.withColumnRenamed("text", "body"))
    symbols = spark.createDataFrame([("Motion", "class", 1, 1), ("Sign_Key", "class", 2, 1), ("Other", "class", 4, 1)], "name string, kind string, file long, line int")
    words = spark.createDataFrame([(1, "Motion"), (1, "Sign_Key"), (2, "Sign_Key"), (3, "über-wort"), (4, "xyzzy")], "query_id int, word string")
    find = lambda w: K.mentions(K.identifiers(lines), lines, w)
    got = {(r.word, r.doc, r.line) for r in find(words.select("word").distinct()).collect()}
    assert got == {(w, d, k + 1) for w in ("Motion", "Sign_Key", "über-wort") for d, t in texts.items() for k, x in enumerate(t.split("\n")) if w in x}
    scored = spark.createDataFrame([(4, "Other", "class", 4, 1, -0.5)], "query_id int, name string, kind string, file long, line int, score double")
    ranked = K.rank(words, symbols, scored, find)
    places = lambda q: [(r.name, r.file, r.line, r.tier) for r in ranked.where(f"query_id = {q}").orderBy("rank").collect()]
    assert places(1) == [("Motion", 1, 1, 0), ("Sign_Key", 2, 1, 0), ("Sign_Key", 1, 2, 0), ("Motion", 1, 3, 0), ("Motion", 2, 2, 0), ("Sign_Key", 4, 2, 1)]
    assert places(2) == [("Sign_Key", 2, 1, 0), ("Sign_Key", 1, 2, 0), ("Sign_Key", 4, 2, 0)]  # one word only: no other must stand beside it
    assert places(3) == [("über-wort", 3, 2, 0)] and places(4) == [("Other", 4, 1, 1)]
    files = docs.select(F.col("doc_id").alias("file"), T.lines(F.col("text")).alias("lines"))
    cands = K.with_text(ranked, files, symbols)
    pack = lambda budget, policy: {r.query_id: (r.used, r.kept, r.over) for r in K.pack(cands, budget, policy).collect()}
    cost = lambda f, k, kind, name, t: max(1, len(f"{f}:{k} {kind} {name} :: {t}") // 4)
    c = [cost(1, 1, "class", "Motion", "class Motion"), cost(2, 1, "class", "Sign_Key", "class Sign_Key"), cost(1, 2, "ref", "Sign_Key", "uses Sign_Key here")]
    assert pack(10**6, "multi")[1][1] == ["1:1", "2:1", "1:2", "1:3", "2:2", "4:2"] and pack(10**6, "one_per_file")[1][1] == ["1:1", "2:1", "4:2"]
    assert pack(10**6, "expanded")[1][1] == ["1:1", "2:1", "1:2", "1:3", "2:2", "4:2", "4:1"]
    late = cost(2, 2, "ref", "Motion", "Motion of it")  # smaller than the first of its file, which doesn't fit and so doesn't count as kept
    assert late < c[1] and pack(c[0] + c[1] - 1, "one_per_file")[1] == (c[0] + late, ["1:1", "2:2"], 2)
    assert pack(c[0] + c[2], "multi")[1][1][0] == "1:1" and pack(0, "multi")[2] == (0, [], 3)


def test_evaluation_rules(spark):
    schema = "item_id int, mechanical string, scored boolean, first_kind string, first_verdict string, second_verdict string, adjudication string, sampled boolean"
    cases = [
        (1, "accepted", False, None, None, None, None, False), (2, "rejected", True, "human", "accepted", None, None, False), (3, "accepted", True, "llm", "accepted", None, None, False), (4, "accepted", True, "human", "rejected", None, None, False),
        (5, "accepted", True, "human", "accepted", None, None, True), (6, "accepted", True, "human", "accepted", "rejected", None, False), (7, "accepted", True, "human", "accepted", "rejected", "accepted", False), (8, "accepted", True, "human", "accepted", None, None, False),
    ]
    got = {r.item_id: (r.status, r.state) for r in E.adjudicate(spark.createDataFrame(cases, schema)).collect()}
    assert got == {1: ("no_score", "undetermined"), 2: ("mechanical_fail", "rejected"), 3: ("llm_triage", "undetermined"), 4: ("second_reviewer_missing", "undetermined"), 5: ("second_reviewer_missing", "undetermined"), 6: ("disputed", "undetermined"), 7: ("adjudicated", "accepted"), 8: ("judged", "accepted")}


def test_unblind_where_opaque_ids_repeat(spark, tmp_path):
    import duckdb

    from spanlake.plans import ORACLE, QUERIES

    same, con = (15237, 872831), duckdb.connect()
    assert len({r[0] for r in spark.createDataFrame([(k,) for k in same], "k long").select(T.opaque_id("n2", F.col("k"))).collect()}) == 1
    con.sql(f"copy (select * replace (case row_number() over () when 1 then {same[0]} else {same[1]} end as o_orderkey, row_number() over () as o_custkey) from '/root/testdata/sf0.001/orders.parquet' limit 2) to '{tmp_path}/orders.parquet'")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = QUERIES["unblind"](spark, str(tmp_path))
    want = con.sql(ORACLE["unblind"]).fetchall()
    assert len(want) == 2 and sorted(map(tuple, got.select("item_id", "condition", "task", "state").collect())) == sorted(want)


def test_history(spark):
    rows = [(1, k, r, "x" * 400) for k, r in enumerate(["system", "user", "assistant", "user", "assistant", "user", "assistant"])] + [(2, 0, "user", "hi")]
    m = H.messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    turns = lambda df: sorted((r.conv_id, r.turn) for r in df.collect())
    assert turns(H.tail(m, 3)) == [(1, 0), (1, 3), (1, 4), (1, 5), (1, 6), (2, 0)]
    assert turns(H.tail(m, 2)) == [(1, 0), (1, 5), (1, 6), (2, 0)]
    c = H.cliff(m, 300, 1, 2)
    assert turns(c) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 5), (1, 6), (2, 0)]
    assert [(r.turn, r.text) for r in c.where("role = 'marker'").collect()] == [(3, "[2 left out]")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    from spanlake.plans import QUERIES

    refs = plan(QUERIES["find_references"](spark, data))
    assert "BroadcastNestedLoopJoin" in refs and "CartesianProduct" not in refs and "ReadSchema: struct<doc_id:bigint,text:string" in refs
    assert "WindowGroupLimit" in plan(QUERIES["topk_per_key"](spark, data))
    top = plan(QUERIES["bm25_topk"](spark, data))
    assert "WindowGroupLimit" in top and "Python" not in top and "documents.parquet" not in top  # the texts aren't read again
    assert "n_chars" not in plan(QUERIES["doc_freq"](spark, data))


def test_search_moves_postings_once(spark, data, monkeypatch):
    from spanlake.operators import fulltext
    from spanlake.plans import QUERIES

    assert "hashpartitioning(item_id" not in plan(QUERIES["bm25_topk"](spark, data))  # pairs of item and document aren't dealt out
    texts = ["a b a", "b", "a b a", "c a b", "", None, "b c", "a b a"]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    terms = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("z", "none"), (None, "b")], "query_id string, term string")
    index = fulltext.postings(docs)
    assert sorted((r.term, r.tf, r.dl) for r in index.where("doc = 'd0'").collect()) == [("", 1, 3), ("a", 2, 3), ("b", 1, 3)] and index.where("term = ''").count() == 8
    find = lambda k: sorted(map(str, map(tuple, fulltext.search(index, terms, k).collect())))
    monkeypatch.setattr(fulltext, "CELLS", 6)  # slices of two documents
    monkeypatch.setattr(fulltext, "BLOCK", 2)
    dense = [find(k) for k in (1, 2, 100)]
    monkeypatch.setattr(fulltext, "MOST_BROADCAST", 0)
    assert dense == [find(k) for k in (1, 2, 100)] and len(dense[0]) == 3


def test_phrases_are_counted_where_texts_are(spark):
    from spanlake.operators import fulltext

    docs = spark.createDataFrame([(1, "A a a b"), (2, "a b a b"), (3, "b"), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a a"), (1, "a b"), (2, "b a b"), (2, "a"), (3, "b z")], "query_id int, term string")
    got = fulltext.with_phrases(fulltext.postings(docs), docs, terms).where("term like '% %'")
    assert sorted(map(tuple, got.collect())) == [("a a", 1, 2, 4), ("a b", 1, 1, 4), ("a b", 2, 2, 4), ("b a b", 2, 1, 4)]
    assert "slice" not in plan(got) and "Join" not in plan(got)  # counted once and stored, not for each pair of phrase and document


def test_first_places(spark):
    places = [("n", f, k) for f in range(9) for k in range(1, 1 + f % 3 * 40)] + [("m", 1, 1)]
    df = spark.createDataFrame(places, "name string, file long, line int")
    got = sorted(map(tuple, R.first_places(df, 5).collect()))
    assert len(got) <= 31
    for own in range(9):
        assert [x for x in got if x[0] == "n" and x[1] != own][:5] == [x for x in sorted(places) if x[0] == "n" and x[1] != own][:5]


def test_first_mentions_are_looked_for_in_few_documents_first(spark):
    from spanlake.operators import capsule as K

    lines = spark.createDataFrame([(d, k, "the The_x" if d % 7 else "the rare") for d in range(60) for k in (1, 2)], "doc_id long, line int, text string")
    words = spark.createDataFrame([("the",), ("The",), ("rare",), ("none",), ("e r",)], "word string")
    index = K.identifiers(lines)
    rows = lambda df: sorted((r.word, r.doc, r.line) for r in df.collect())
    want = rows(K.first_mentions(K.mentions(index, lines, words), 5))
    assert rows(K.progressive(index, lines, words, 5, shares=(0.05, 0.3))) == want and len(want) == 20


def test_ranking_is_done_once(spark, data, monkeypatch):
    from spanlake.plans import QUERIES, capsule

    for name in ("hit_rules", "score_additional"):
        assert "MapInArrow" not in plan(QUERIES[name](spark, data)) and "hashpartitioning(term" not in plan(QUERIES[name](spark, data))
    calls, real = [], capsule.candidates
    monkeypatch.setattr(capsule, "candidates", lambda *a, **k: calls.append(a) or real(*a, **k))
    QUERIES["bakeoff"](spark, data)
    assert len(calls) == 1


def test_context_and_expansion_read_texts_once(spark, data, monkeypatch):
    from spanlake.plans import pack

    read, table = [], pack.table
    monkeypatch.setattr(pack, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    pack.context(spark, data)
    assert read.count("documents") == 1  # hashes come with the candidates
    read.clear()
    pack.expansion(spark, data, pack.BYTES, 30)
    assert read.count("documents") == 1


def test_postings_in_the_order_of_the_index(spark, monkeypatch):
    from collections import Counter

    from spanlake.operators import fulltext

    texts = [(3, "b a b ñu"), (1, "a"), (None, "c a"), (1, "a a"), (2, ""), (4, None), (0, "Z z 中 é")]
    want = sorted(((t, d is not None, d or 0, n, len(w)) for d, x in texts for w in [(x or "").lower().split()] for t, n in [("", 1), *Counter(w).items()]), key=lambda r: (r[0].encode(), *r[1:]))
    monkeypatch.setattr(fulltext, "PIECE", 2)
    rows = fulltext.postings(spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)).collect()
    at = [(r.term.encode(), r.doc is not None, r.doc or 0) for r in rows]
    assert at == sorted(at)  # sorting only merges batches
    assert sorted(((r.term, r.doc is not None, r.doc or 0, r.tf, r.dl) for r in rows), key=lambda r: (r[0].encode(), *r[1:])) == want
    assert fulltext.postings(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_search_reads_the_index_once(spark, tmp_path):
    from spanlake.operators import fulltext

    docs = spark.createDataFrame([(k, "a b" if k % 2 else "b c") for k in range(20)], "doc_id int, text string")
    fulltext.write(fulltext.postings(docs), f"{tmp_path}/stored")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, term string")
    found = fulltext.search(spark.read.parquet(f"{tmp_path}/stored"), terms, 3)
    scans = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in x and "stored" in x]
    assert len(scans) == 1  # statistics; postings were read before
    assert [(r.query_id, r.doc_id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 3), (1, 5), (2, 0), (2, 2), (2, 4)]
