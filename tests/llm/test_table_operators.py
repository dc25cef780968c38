"""Mixing, archives, vectors and the pipeline against brute force."""

import base64
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.llm import components, hnsw, knn, mixing, warc
from spanlake.llm.queries import ORACLE, QUERIES
from tests.conftest import rows

# -- mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [mixing.CYCLE[k % 3] for k in range(len(sizes))]
    goal = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert sum(goal) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * n + 1e-6 for g, n in zip(goal, sizes, strict=True))
    free = [g / w for g, w, n in zip(goal, weights, sizes, strict=True) if g < 2 * n - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))
    for g, n in zip(goal, sizes, strict=True):
        slots, last = mixing.slots_needed(g, n, 64)
        whole, rest = divmod(slots - 1, -(-n // 64)) if slots else (0, 0)
        assert not slots or whole * n + rest * 64 + last == round(g)


def test_mix(spark, data, odd, empty):
    for df in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        mixed, plan = mixing.mix(df, block=16)
        got = mixed.collect()
        size = {(r.doc_id, r.source): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()}
        assert len(got) == df.count() and all(r.taken <= 2 * r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault(r._source_no, [r.source_size, r.target, 0])[2] += r.taken
        names = sorted({s for _, s in size}, key=lambda s: (s is None, s or ""))
        total = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect() if r.source == s) for s in names}
        assert [by[k][0] for k in range(len(names))] == [total[s] for s in names]
        assert all(abs(taken - target) <= 1 for _, target, taken in by.values())
        again = mixing.mix(df, block=16)[0].collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
        slots = plan.collect()
        assert len({(r.source_no, r["rank"]) for r in slots}) == len(slots)
        first = [r.source_no for r in sorted(slots, key=lambda r: r.slot)][: len(slots) // 2]
        share = sum(x[1] for x in by.values())
        assert all(abs(first.count(k) / len(first) - x[1] / share) < 0.1 for k, x in by.items())
    assert mixing.mix(empty)[0].count() == 0
    none = mixing.mix(odd.where("text is null"))[0].collect()
    assert [(r["size"], r.target, r.taken) for r in none] == [(0, 0.0, 0)]
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and mixing.mixed(empty).count() == 0


def test_mix_of_equal_and_keyless_rows(spark):
    rows = [(None, "a b c d e", "s")] * 500 + [(7, "x y", "s")] * 3 + [(7, "other text", "t"), (None, None, "t"), (8, "w " * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, block=16)[0].collect()
    assert len(got) == len(rows)
    words = {"s": 2506, "t": 2, None: 300}
    goal = dict(zip(("s", "t", None), mixing.targets(list(words.values()), [5.0, 2.0, 1.0], 1.5 * 2808, 2), strict=True))
    for k, name in enumerate(("s", "t", None)):
        mine = [r for r in got if r._source_no == k]
        assert {(r.source_size, r.target) for r in mine} == {(words[name], goal[name])}
        assert abs(sum(r.taken for r in mine) - goal[name]) <= 1 and all(r.taken <= 2 * r["size"] for r in mine)
    copies = [r.taken for r in got if r.doc_id is None and r["size"] == 5]
    assert len(copies) == 500 and max(copies) - min(copies) <= 1
    assert sorted(map(repr, mixing.mix(df, block=16)[0].collect())) == sorted(map(repr, got))


def slow_mix(df, block, per_bucket=2000):
    """(doc_id, source, size, taken) by plain loops over slots and words; hashes come from the engine."""
    from bisect import bisect_right
    from collections import Counter

    tie = F.xxhash64("text")
    rows = df.select("doc_id", "source", "text", F.xxhash64(F.col("doc_id").cast("string"), tie, F.lit("mix")).alias("order"), tie.alias("tie")).collect()
    entries = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.order, r.tie) for r in rows)
    names = sorted({e[1] for e in entries}, key=lambda x: (x is None, x or ""))
    buckets = max(8, len(entries) // per_bucket)
    tapes = [sorted((e for e in entries if e[1] == x), key=lambda e: (((e[3] % 2**64) >> 20) % buckets, e[3], e[4])) for x in names]
    sizes = [sum(e[2] * entries[e] for e in t) for t in tapes]
    goals = mixing.targets(sizes, [mixing.CYCLE[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
    words = [[e for e in t for _ in range(e[2] * entries[e])] for t in tapes]  # the entry of every word of a tape
    taken, cumulative = Counter(), np.cumsum(goals) / sum(goals)
    left, rank = [round(g) for g in goals], [0] * len(names)

    def take(s):
        if left[s] > 0:
            length = -(-sizes[s] // block)
            low = rank[s] % length * block
            some = words[s][low : low + block][: left[s]]
            taken.update(some)
            left[s] -= len(some)
        rank[s] += 1

    for slot in range(-(-round(sum(goals)) // block)):
        take(min(bisect_right(cumulative.tolist(), slot * mixing.GOLDEN % 1.0), len(names) - 1))
    for s in range(len(names)):
        while left[s] > 0:
            take(s)
    out = []
    for e, copies in entries.items():
        share, more = divmod(taken[e], copies)
        out += [(e[0], e[1], e[2], share + (k < more)) for k in range(copies)]
    return sorted(out, key=repr), names


@pytest.mark.parametrize("block", [5, 64])
def test_mix_equals_plain_loops(spark, data, odd, block):
    for df in (spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000"), odd.where("length(text) < 1000 or text is null")):
        want, names = slow_mix(df, block)
        got = [(r.doc_id, names[r._source_no], r["size"], r.taken) for r in mixing.mix(df, block=block)[0].collect()]
        assert sorted(got, key=repr) == want


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(k, "a b", f"s{k}") for k in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(df)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert mixing.mix(df.limit(3))[0].count() == 3


# -- archives


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://b.example.com/x?q=1#f", "<p>same</p>"), (2, "https://A.example.com:80/y", "<p>same</p>"), (3, None, None), (4, "", ""), (4, "", ""), (5, "not a url", "é😀" * 50_000), (6, "http://u@h.example/ a\nb", "x"), (None, "http://n.example/", "<p>same</p>"), (1, "http://b.example.com/x?q=1#f", "other")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def expected(pages, min_bytes=0):
    least, out = {}, []
    for r in pages:
        h = (r.html or "").encode()
        least[h] = min([x for x in (r.page_id, least.get(h)) if x is not None], default=None)
    for r in pages:
        h = (r.html or "").encode()
        to = least[h] if len(h) >= min_bytes and r.page_id is not None and r.page_id > least[h] else None
        out.append((r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives(spark, pages, min_bytes):
    got = warc.write_and_read(spark, pages, min_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(pages.collect(), min_bytes)
    assert warc.write_and_read(spark, pages.where("false")).count() == 0


def test_archives_over_a_table(spark, data, duck):
    got = QUERIES["op8_warc"](spark, data).toArrow()
    assert rows(got) == rows(duck.sql(ORACLE["op8_warc"]).to_arrow_table())


def test_index_file():
    captures = sorted((f"com,h{k % 37})/{k % 11}", k // 3, "d", "a", k, 1) for k in range(2000))
    f = warc.IndexFile(warc.IndexFile.pack(captures, per_block=7))
    for key, page, *_ in captures[::13]:
        assert sorted(x[1] for x in f.find(key, page)) == sorted(c[4] for c in captures if c[:2] == (key, page))
    assert f.find("com,h1)/0", 10**6) == [] and f.find("", 0) == [] and f.find("zzz", 1) == []


def test_records():
    r = warc.record(7, "http://x/ \r\ny", b"abc\r\n\r\ndef", 10, warc.digest_name(hashlib.sha1(b"abc\r\n\r\ndef").hexdigest()), None)
    assert warc.parse(r)["payload"] == b"abc\r\n\r\ndef" and warc.parse(r)["page_id"] == 7
    with pytest.raises(ValueError):
        warc.parse(r.replace(b"def", b"deg"))
    assert warc.url_key("https://u@Www.Example.com:8080/a?b#c") == "com,example,www)/a?b"


# -- vectors


def vectors(spark, n=400, dim=16, seed=5, copies=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n - 4, 10):  # near copies, a chain of them, and exact copies
        x[k + 1] = x[k] + 0.05 * rng.normal(size=dim)
        x[k + 2] = x[k + 1] + 0.2 * rng.normal(size=dim)
        x[k + 3] = x[k] * 2
        x[k + 4] = x[k]
    rows = [(i, v.astype(np.float32).tolist(), i // 5 % 3 if i % 17 else None, "clash") for i, v in enumerate(x)]
    bad = [(n + 1, None, 1, ""), (n + 2, [0.0] * dim, 1, ""), (n + 3, [float("nan")] * dim, 1, ""), (n + 4, [None, *[1.0] * (dim - 1)], 1, ""), (n + 5, [1.0, 2.0], 1, ""), (n + 6, [float("inf")] * dim, 1, ""), (n + 7, [], 1, ""), (None, [1.0] * dim, 1, "")]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, rank string").repartition(4)


def usable(r):
    return r.vec_id is not None and r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)


def test_nearest_equals_brute_force(spark):
    df = vectors(spark)
    every = [r for r in df.collect() if usable(r)]
    want = set()
    for q in every:
        if q.vec_id % 20 == 0:
            same = [r for r in every if r.vec_id != q.vec_id and len(r.embedding) == len(q.embedding)]
            if same:
                s = knn.cosines(np.repeat(np.array([q.embedding], float), len(same), 0), np.array([r.embedding for r in same], float))
                best = sorted(zip((-s).tolist(), [r.vec_id for r in same], strict=True))[:5]
                want |= {(q.vec_id, k + 1, v, -m) for k, (m, v) in enumerate(best)}
    got = knn.nearest(df, F.col("vec_id") % 20 == 0, tile_rows=60, tile_queries=7)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert knn.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = knn.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_a_repeated_query_row_asks_once(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(0, [0.5, 0.0])] + [(k, [1.0, float(k)]) for k in range(1, 9)]
    got = knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k, k) for k in range(1, 6)]


def test_nearest_equals_sql(spark, data, duck):
    assert rows(QUERIES["op5_knn"](spark, data).toArrow()) == rows(duck.sql(ORACLE["op5_knn"]).to_arrow_table())


def test_error_bounds_hold():
    x = knn.directions(np.random.default_rng(1).normal(size=(200, 64))).astype(float)
    q, s, e = knn.codes(x)
    assert q.dtype == np.int8
    got = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(got - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e + 1e-9).all()


@pytest.mark.parametrize(("shard_rows", "slice_shards"), [(16384, 16), (40, 16), (20, 2)])
def test_embedding_near_duplicates(spark, monkeypatch, shard_rows, slice_shards):
    monkeypatch.setattr(hnsw, "SLICE", slice_shards)
    df = vectors(spark)
    every = df.collect()
    ok = [r for r in every if usable(r) and r.label is not None]
    links = {r.vec_id: set() for r in every}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a.label == b.label and len(a.embedding) == len(b.embedding) and knn.cosines(np.array([a.embedding], float), np.array([b.embedding], float))[0] >= 0.93:
                links[a.vec_id].add(b.vec_id)
                links[b.vec_id].add(a.vec_id)
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard_rows=shard_rows).collect()}
    assert len(got) == len(every)
    total = sum(map(len, links.values()))
    assert all(got[k].n_links <= len(v) for k, v in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * total > 0
    for k, v in links.items():
        assert not v or got[k].component_id <= k
        assert got[k].kept == (got[k].component_id == k)
    if sum(r.n_links for r in got.values()) == total:
        for k, v in links.items():
            assert all(got[k].component_id == got[x].component_id for x in v)
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_graph_recall_and_wide_clusters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[:700] = x[0] + 0.05 * rng.normal(size=(700, 32))
    x = hnsw.directions(x)
    g = hnsw.Graph(x)
    beam = g.audited_beam(0.93, 0.98, 16)
    r, c = g.within(x, 0.93, beam)
    true = x @ x.T >= 0.93
    assert true[r, c].all() and len(set(zip(r.tolist(), c.tolist(), strict=True))) == len(r) >= 0.98 * true.sum()


@pytest.mark.parametrize("groups", [0, 1, 60])
def test_audit_sees_small_groups_beside_a_cluster(groups):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    if groups != 1:
        x[:900] = x[0] + 0.05 * rng.normal(size=(900, 32))
    pairs = np.arange(1000, 1000 + 2 * groups)
    x[pairs[1::2]] = x[pairs[::2]] + 0.01 * rng.normal(size=(groups, 32))
    g = hnsw.Graph(x := hnsw.directions(x))
    for table in g.links:  # the graph has lost the pairs
        table[np.isin(table, pairs)] = -1
        table[pairs] = -1
    r, c = g.within(x, 0.93, g.audited_beam(0.93, 0.98, 48))
    true = x @ x.T >= 0.93
    recall = np.bincount(r, minlength=len(x)) / true.sum(1)
    assert recall[true.sum(1) > 1].min(initial=1) > 0.9 and (not groups or (recall[pairs] == 1).all())


@pytest.mark.parametrize("shard_rows", [16384, 40])
def test_pairs_found_from_one_end_count_for_both(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 16))
    x[60:] = x[:60] + 0.01 * rng.normal(size=(60, 16))
    x[1] = x[0] * 2  # not equal, but alike
    within = hnsw.Graph.within

    def one_way(self, q, limit, beam, batch=256):
        r, c = within(self, q, limit, beam, batch)
        keep = q[r, 0] <= self.x[c, 0]
        return r[keep], c[keep]

    df = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(1) - 1
    monkeypatch.setattr(hnsw.Graph, "within", one_way)
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(df, shard_rows=shard_rows).collect()}
    assert [got[k] for k in range(len(x))] == want.tolist()


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7)]
    up = {x: x for ab in links for x in ab}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    alone = {x for x in up if not any(a != b and x in (a, b) for a, b in links)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if x not in alone}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- pipeline


def test_pipeline(spark, data, odd, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (docs, odd, empty):
        for name, stage in p.STAGES[:-1]:
            before = df
            df = stage(spark, df, data)
            assert df.columns == before.columns, name
            df = spark.createDataFrame(df.collect(), before.schema)
        out = p.STAGES[-1][1](spark, df, data)
        assert out.count() == df.count()
    rows = p.run(spark, data).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(sum(r.doc_id == x for r in rows) <= 2 for x in {r.doc_id for r in rows})


def test_pipeline_equals_plain_stages(spark, data):
    """The whole run against its stages done one text at a time: brute-force duplicates, plain loops for the mix, the tokenizers library."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from spanlake.llm import langid, pii
    from spanlake.llm.queries import vocabulary
    from tests.llm.test_text_operators import components_by_brute_force, slow_fingerprint

    docs = spark.read.parquet(f"{data}/documents.parquet")
    scorer = langid.Scorer(models := langid.train(docs))
    rows = [r for r in docs.collect() if not models.decide(*scorer.texts([r.text or ""]))[3][0]]
    component, kept = components_by_brute_force([slow_fingerprint(r.text or "") for r in rows]), {}
    for r, c in sorted(zip(rows, component, strict=True), key=lambda x: x[0].doc_id):
        kept.setdefault(c, r)
    kept = spark.createDataFrame(list(kept.values()), docs.schema)
    field = pii.train(kept)
    masked = []
    for r in kept.collect():
        base, more = field.find([r.text or ""])[0]
        masked.append((r.doc_id, pii.masked(r.text, base + more), r.source))
    df = spark.createDataFrame(masked, "doc_id long, text string, source string")
    taken, _ = slow_mix(df, 64)
    text, library, want = {r.doc_id: (r.text, r.source) for r in df.collect()}, Tokenizer.from_str(vocabulary("byte_bpe_50k.json")), []
    for doc_id, source, size, n in taken:
        times = int(n / max(size, 1) + 0.5)
        want += [(doc_id, source, library.encode(text[doc_id][0], add_special_tokens=False).ids)] * times
    got = [(r.doc_id, r.source, list(r.ids)) for r in p.run(spark, data).collect()]
    assert sorted(got) == sorted(want) and len({x[0] for x in got}) > 100


def test_pipeline_of_a_few_rows(spark, data, tmp_path):
    """Tables of one text, of equal texts and of none go through every stage."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "a text with some words that stand here for the only document of its table"
    for k, (rows, n) in enumerate([([(1, long, "en", "a", 70)], 1), ([(i, long, "en", "a", 70) for i in range(20)], 1), ([], 0), ([(None, long, "en", None, 70), (3, None, None, "a", None)], 1)]):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        got = p.run(spark, str(tmp_path / f"{k}")).select("doc_id").distinct().count()
        assert got == n
