"""Operators on texts against libraries, brute force and round trips."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlake.llm import bpe, langid, license, pii, simhash, wavelet
from spanlake.llm.queries import QUERIES, vocabulary

TEXT = st.text(st.one_of(st.sampled_from("ab .!'s\n 1é<|>@+-()"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_str(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids_of(library, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def all_rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- BPE


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_bpe_equals_library_and_round_trips(byte_bpe, libraries, texts):
    got = byte_bpe.encode(texts)
    assert got == ids_of(libraries["byte_bpe_50k.json"], texts)
    assert [byte_bpe.decode(x) for x in got] == texts


def test_bpe_runs_and_special_tokens(byte_bpe, libraries):
    texts = ["a" * n for n in range(1, 70)] + ["<|endoftext|>", "x<|endoftext|><|endoftext|>y", "", " \n\n  a", "0" * 3000]
    assert byte_bpe.encode(texts) == ids_of(libraries["byte_bpe_50k.json"], texts)


def test_bpe_query(spark, odd, empty, libraries):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, vocabulary("byte_bpe_50k.json")).collect()}
    want = set()
    for r in odd.collect():
        ids = ids_of(libraries["byte_bpe_50k.json"], [r.text or ""])[0]
        want.add((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    back = bpe.decode(bpe.encode(odd, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json"))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())


# -- wavelet matrix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400))
def test_wavelet_matrix(ids):
    w = wavelet.WaveletMatrix(wavelet.pack([7], [len(ids)], np.array(ids, np.uint32), 9))
    assert w.ids().tolist() == ids and w.keys == [7]
    for i in range(0, len(ids), 37):
        assert w.access(i) == ids[i] and w.rank(ids[i], i) == ids[:i].count(ids[i])
    for t in set(ids[:5]) | {511, 600}:
        assert w.count(t) == ids.count(t) and w.occurrences(t) == [k for k, x in enumerate(ids) if x == t]


def test_wavelet_over_blocks():
    ids = np.random.default_rng(1).integers(0, 5, 200_000).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.pack([0], [len(ids)], ids, 3))
    assert (w.ids() == ids).all() and w.access(70_001) == ids[70_001] and w.count(4) == int((ids == 4).sum())
    assert w.occurrences(2)[-1] == int(np.flatnonzero(ids == 2)[-1])


def test_a_stored_shard_is_read_in_ranges(tmp_path, monkeypatch):
    ids = np.random.default_rng(3).integers(0, 50_000, 600_000).astype(np.uint32)
    uri, read = f"file://{tmp_path}/a.wm", []
    wavelet.put(uri, wavelet.pack([1, 2], [400_000, 200_000], ids, 16))
    whole = wavelet.get
    monkeypatch.setattr(wavelet, "get", lambda uri, ranges: [read.append(len(x)) or x for x in whole(uri, ranges)])
    w = wavelet.WaveletMatrix.stored(uri)
    assert w.access(123_456) == ids[123_456] and w.keys == [1, 2]
    assert sum(read) < 0.3 * (tmp_path / "a.wm").stat().st_size  # a block of each plane and the head
    assert w.rank(int(ids[5]), 300_000) == int((ids[:300_000] == ids[5]).sum()) and (w.ids() == ids).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_chunks_equal_library(libraries, texts):
    e = test_chunks_equal_library.encoder
    ids, size = e.encode(pa.array(texts), 2)
    end = np.cumsum(size)
    assert [ids[b - n : b - 1].tobytes() for b, n in zip(end, size, strict=True)] == ids_of(libraries["word_bpe_49k.json"], texts)


test_chunks_equal_library.encoder = wavelet.ChunkEncoder(vocabulary("word_bpe_49k.json"), cache_words=50)


def test_encoders_equal_libraries_over_code_points(byte_bpe, libraries):
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1{chr(c)}  A{chr(c)}. É.{chr(c)}" for c in range(1, 0x3100)]
    assert byte_bpe.encode(texts) == ids_of(libraries["byte_bpe_50k.json"], texts)
    ids, size = test_chunks_equal_library.encoder.encode(pa.array(texts))
    end = np.cumsum(size)
    assert [ids[b - n : b].tobytes() for b, n in zip(end, size, strict=True)] == ids_of(libraries["word_bpe_49k.json"], texts)


def test_token_files(spark, odd, empty, libraries):
    got = [tuple(r) for r in wavelet.write_and_read(spark, odd, vocabulary("word_bpe_49k.json"), 2).orderBy("start").collect()]
    docs = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in docs:
        ids = ids_of(libraries["word_bpe_49k.json"], [r.text or ""])[0] + b"\2\0\0\0"
        want.append((r.doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert wavelet.write_and_read(spark, empty, vocabulary("word_bpe_49k.json"), 2).count() == 0


# -- language


def test_kneser_ney_sums_to_one():
    words = ["abba", "cab", "bac", "a", "caba"]
    m = langid.Models.fit({"x": (words, np.array([3, 1, 2, 5, 1]))})
    hashes, logs = m.grams[0]
    context = langid.symbols(["ab"])[0]
    total = 0.0
    for letter in "abc":
        s = [np.array([ord(letter)], np.uint64), context[1][1:2], context[2][1:2], context[3][1:2]]
        total += float(np.exp(score_one(m, s)))
    total += float(np.exp(score_one(m, [np.array([0], np.uint64), context[1][1:2], context[2][1:2], context[3][1:2]])))
    unseen = float(np.exp(m.rare)) * np.exp(sum(float(m.contexts[k][1][langid.seek(m.contexts[k][0], langid.keyed([x for x in s[1 : k + 1]][::-1]) if k else np.zeros(1, np.uint64))[0], 0][0]) for k in range(4)))
    assert abs(total + unseen - 1) < 1e-3  # 4 symbols seen of an alphabet of 6: two unseen


def score_one(m, s):
    total = 0.0
    for k in range(langid.ORDER, 0, -1):
        part = s[:k]
        at, there = langid.seek(m.grams[k - 1][0], langid.keyed(part[::-1]))
        if there[0]:
            return total + float(m.grams[k - 1][1][at[0], 0])
        key = langid.keyed(part[1:][::-1]) if k > 1 else np.zeros(1, np.uint64)
        at, there = langid.seek(m.contexts[k - 1][0], key)
        total += float(m.contexts[k - 1][1][at[0], 0]) if there[0] else 0.0
    return total + float(m.rare)


def test_language_held_out_accuracy(spark, data):
    got = {r.doc_id: r for r in QUERIES["op1_language"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert sum(got[r.doc_id].rejected for r in docs) < 0.01 * len(docs)
    assert all(0 <= g.score <= 1 for g in got.values())


def slow_kneser_ney(words, order=4):
    """Probability of a symbol after a context, by the textbook recursion over plain dictionaries."""
    from collections import Counter, defaultdict

    grams = [Counter() for _ in range(order + 1)]
    for w, times in words.items():
        s = "\0" * (order - 1) + w + "\0"
        for k in range(order - 1, len(s)):
            first = max(k - order + 1, order - 2)  # before a word there is one border
            grams[order][s[first : k + 1].rjust(order, "\0")] += times
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    tables = []
    for k in range(1, order + 1):
        by = defaultdict(dict)
        for g, n in grams[k].items():
            by[g[:-1]][g[-1]] = n
        once, twice = (sum(v == x for v in grams[k].values()) for x in (1, 2))
        tables.append((by, min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5))
    alphabet = 2 + len(grams[1])

    def p(symbol, context):
        if not context and symbol is None:
            return 1 / alphabet
        value = 1 / alphabet
        for k in range(1, order + 1):
            by, d = tables[k - 1]
            seen = by.get(context[len(context) - k + 1 :] if k > 1 else "")
            if seen:
                total = sum(seen.values())
                value = max(seen.get(symbol, 0) - d, 0) / total + d * len(seen) / total * value
        return value

    return p


def test_kneser_ney_equals_textbook():
    words = {"abba": 3, "cab": 1, "bac": 2, "a": 5, "caba": 1, "cc": 2, "abc": 1}
    m = langid.Models.fit({"x": (list(words), np.array(list(words.values())))})
    p = slow_kneser_ney(words)
    for w in ["abba", "a", "cabba", "ccc", "bbbb", "abd", "zz"]:
        s, want = "\0\0\0" + w + "\0", 0.0
        for k in range(3, len(s)):
            want += np.log(p(s[k], s[k - 3 : k]))
        sums, n = m.score([w])
        assert n[0] == len(w) + 1 and abs(sums[0, 0] - want) < 1e-4


def test_junk_is_rejected_and_labelled_text_is_not(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    m = langid.train(docs)
    rng = np.random.default_rng(12)
    letters, every = list("abcdefghijklmnopqrstuvwxyz"), list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    kinds = [
        lambda: " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(40)),
        lambda: "".join(rng.choice(every, 400)),
        lambda: " ".join("".join(rng.choice(list("qwxzkjv"), 5)) for _ in range(30)),
        lambda: "".join(chr(c) for c in rng.integers(0x410, 0x450, 200)),
        lambda: str(rng.choice(letters)) * 300,
    ]
    junk = spark.createDataFrame([(k, kinds[k % 5]()) for k in range(200)], "doc_id long, text string")
    assert langid.known(junk, m).count() < 0.1 * 200
    assert langid.known(docs, m).count() > 0.99 * docs.count()


def test_marks_alone_are_no_letters(spark, data):
    words, n = langid.Models([]).score(["\u0301\u0302", "e\u0301a", "\u0301e", "x-\u0301"])
    assert n.tolist() == [0, 4, 2, 2]
    m = langid.train(spark.read.parquet(f"{data}/documents.parquet"))
    got = langid.identify(spark.createDataFrame([(1, "\u0301 \u0302\u0303")], "doc_id long, text string"), m).first()
    assert got.lang_pred == "und" and got.score == 0 and got.rejected


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = [(None, "the same row again and again", "en")] * 3000 + [(k, f"other words of number {'abcdefghij'[k % 10]} here", "en") for k in range(200)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_chars=2000, tune_chars=500)
    assert m.langs == ["en"] and np.exp(m.score(["again"])[0][0, 0]) < 0.2


def test_language_odd_input(spark, odd, empty, data):
    m = langid.train(spark.read.parquet(f"{data}/documents.parquet"))
    got = {(r.doc_id, r.text): r for r in langid.identify(odd, m).collect()}
    assert {k[0] for k, r in got.items() if r.lang_pred == "und"} == {0, 1, 2, 5}
    assert all(r.rejected and r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert langid.identify(empty, m).count() == 0
    assert not langid.train(empty).langs
    bare = {r.doc_id: r for r in langid.identify(odd, langid.Models([])).collect()}
    assert bare[3].lang_pred == "und" and not bare[3].rejected and bare[1].rejected
    left = langid.known(odd, m)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} >= {3, 4}
    junk = spark.createDataFrame([(1, "xzqvw kkqjx jjxwq qzzk zzxkq wvwqj xkcdq qqqqz " * 5)], "doc_id long, text string")
    assert langid.known(junk, m).count() == 0


def test_every_labelled_language_is_learned(spark):
    words = {"en": "the cat and a dog ran over the hill ", "de": "der hund und die katze liefen weit ", "fr": "le chien et le chat dans les bois "}
    rows = [(k, words["en"] * 3, "en") for k in range(200)]
    few = [(f"{name}{k}", words[name] * (3 if name == "fr" else 300), name) for name, n in (("de", 3), ("fr", 1)) for k in range(40) if zlib.crc32(f"{name}{k}".encode()) % 4 != 2]
    for seed in range(12):  # whichever documents a language has
        of = lambda name, n: [x for x in few if x[2] == name][seed : seed + n]
        docs = spark.createDataFrame([(str(k), t, x) for k, t, x in rows + of("de", 3) + of("fr", 1)], "doc_id string, text string, lang string")
        m = langid.train(docs, train_chars=2000, tune_chars=1000)
        assert m.langs == ["de", "en", "fr"] and set(m.limits) == {"de", "en"}


def test_limits_are_each_language_s_own():
    rng = np.random.default_rng(9)
    words = {"en": ["the", "cat", "and", "dog", "ran", "over", "hill", "quick", "brown", "fox"], "zh": ["".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 3)) for _ in range(2000)]}
    m = langid.Models.fit({k: (w, np.full(len(w), 20)) for k, w in words.items()})
    scorer = langid.Scorer(m)
    texts = [(k, " ".join(rng.choice(w, 60))) for k, w in words.items() for _ in range(400)] + [("zh", "qqx zzv " * 30)]  # one odd labelled text
    m.tune(np.array([k for k, _ in texts]), *scorer.texts([t for _, t in texts]))
    junk = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300))
    name, _, entropy, rejected = m.decide(*scorer.texts([junk, "the quick brown fox ran over the hill and the dog"]))
    assert rejected.tolist() == [True, False] and name[1] == "en"
    low = m.decide(np.array([300]), np.array([[3.6, 9.0]]))  # worse than a uniform choice of a-z
    assert low[3].tolist() == [True]


# -- personal data


def slow_spans(text):
    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                found.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+- ()0459%_x\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_skip_chain_adds_repeats_only():
    counts = pii.Counter()
    for t in ["call +1 (736) 555-2678 now", "card 4041894974608795 ok", "mail bo.42@mail8.example.com x", "host 10.20.30.40 up", "in 1999 we had 12 of 4500 at 30"] * 20:
        counts.update(pii.tally(t))
    f = pii.Field.fit(counts)
    text = "Call +1 (736) 555-2678. " + "word " * 500 + "again 736-555-2678, not 736-555-9999"
    base, more = f.find([text])[0]
    assert [text[a:b] for _, a, b in base] == ["+1 (736) 555-2678"] and [text[a:b] for _, a, b in more] == ["736-555-2678"]
    assert pii.masked(text, base + more).count("<phone>") == 2
    assert f.find(["in 1999 we had 12 of 736-555-9999", ""]) == [([], []), ([], [])]


def test_any_number_of_bare_repeats_is_found(spark):
    def text(n, phone):
        return f"Call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}. " + f"word {phone[:3]}-{phone[3:6]}-{phone[6:]} then " * n

    learn = [text(5, str(7365550000 + 37 * k)) + "card 4041894974608795, mail bo.42@mail8.example.com, host 10.20.30.40, in 1999 we had 12 of 4500 at 30" for k in range(40)]
    f = pii.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"))
    for n in (1, 5, 100):
        t = text(n, "2125552678")
        base, more = f.find([t])[0]
        assert len(base) == 1 and [t[a:b] for _, a, b in more] == ["212-555-2678"] * n and {k for k, _, _ in more} == {"phone"}


@pytest.fixture(scope="module")
def field(spark, data):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


REPEATS = {
    "phone": ("+1 (736) 555-2678", ["736-555-2678", "7365552678", "555-2678", "(736) 555-2678", "17365552678", "736.555.2678", "736-555-2679"]),
    "card": ("4041894974608795", ["404189497460879", "4041.8949.7460.8795", "4041/8949/7460/8795", "4041894974608796"]),
    "ip": ("10.20.30.40", ["10-20-30-40", "10 20 30 40"]),
    "email": ("bo.42@mail8.example.com", ["bo.42@", "bo.42@mail8"]),
}


@pytest.mark.parametrize("kind", REPEATS)
def test_repeats_and_similar_tokens_are_found_and_others_not(field, kind):
    base, ways = REPEATS[kind]
    rng = np.random.default_rng(3)
    for way in ways:
        for n in (1, 7):
            text = f"First {base} here. " + "some words in between " * 40 + f"then {way} again. " * n
            found, more = field.find([text])[0]
            assert [(k, text[a:b]) for k, a, b in found] == [(kind, base)]
            assert len(more) == n and all(k == kind and text[a:b].strip("()") in way for k, a, b in more)
        for _ in range(20):  # another number or name of the same form, with and without a base span
            other = "".join(str(rng.integers(10)) if c.isdigit() else chr(rng.integers(97, 123)) if c.isalpha() else c for c in way)
            if kind == "ip" or not pii.base_spans(other):
                text = f"First {base} here. " + "some words in between " * 40 + f"then {other} again."
                assert field.find([text, f"then {other} again."])[0][1] == [] == field.find([f"then {other} again."])[0][1]


def test_clean_documents_get_no_spans_and_slices_do_not_matter(field, spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    together = field.find(texts)
    assert together == [field.find([t])[0] for t in texts]
    assert sum(len(more) for _, more in together) <= 0.01 * sum(len(base) for base, _ in together)


def test_pii_counts_and_spans_equal_brute_force(spark, field, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.detect(docs, field).collect():
        base = slow_spans(text[r.doc_id]) if len(text[r.doc_id]) < 20_000 else pii.base_spans(text[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))


def test_message_passing_reaches_the_end_of_a_chain():
    pair = np.where(np.eye(5) > 0, 0.0, -6.0)
    f = pii.Field(np.zeros((pii.N_FEATURES + 1, 5)), pair, pair)
    n = 60
    links = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    got = f.beliefs(np.zeros(n, np.int64), np.array([4] + [-1] * (n - 1)), links, links[:0])
    keep = 1 / (1 + 4 * np.exp(-6))  # each hop keeps a label with this probability, exactly
    move = np.full((5, 5), (1 - keep) / 4) + (keep - (1 - keep) / 4) * np.eye(5)
    assert np.allclose(got[-1], np.linalg.matrix_power(move, n - 1)[4], atol=1e-3)


def test_message_passing_equals_enumeration():
    rng = np.random.default_rng(3)
    f = pii.Field(rng.normal(size=(pii.N_FEATURES + 1, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    shapes, given_ = np.array([1, 6, 24]), np.array([-1, 2, -1])
    got = f.beliefs(shapes, given_, np.array([[0, 1]]), np.array([[1, 2]]), rounds=200)
    z = f.design(shapes) @ f.weights
    p = np.exp(z)[:, None, None, :].transpose(0, 3, 1, 2)[:, :, 0, 0]
    p[1] = np.eye(5)[2]
    joint = p[0][:, None, None] * p[1][None, :, None] * p[2][None, None, :] * np.exp(f.chain)[:, :, None] * np.exp(f.skip)[None, :, :]
    joint /= joint.sum()
    assert np.allclose(got[0], joint.sum((1, 2)), atol=1e-3) and np.allclose(got[2], joint.sum((0, 1)), atol=1e-3)


def test_pii_query(spark, odd, empty):
    f = pii.train(odd)
    got = {(r.doc_id, r.n_email, r.base_sha256) for r in pii.detect(odd, f).collect()}
    want = {(r.doc_id, sum(s[0] == "email" for s in slow_spans(r.text or "")), hashlib.sha256(pii.joined(slow_spans(r.text or "")).encode()).hexdigest()) for r in odd.collect()}
    assert got == want
    assert pii.detect(empty, pii.train(empty)).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(odd, f).collect()}
    assert masked[0] is None and masked[8] == "<|endoftext|> mail <email> <|startoftext|>" and pii.redact(odd, f).columns == odd.columns


# -- licenses


def slow_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["CC", "by", "cc-by", "General", "public", "license", "All rights", "reserved", ".", "é", "ccé", "x9", "\n", "İ", "licensed under the Apache License, Version 2.0"]), max_size=25).map(" ".join))
def test_base_phrases_equal_brute_force(text):
    n, nb, first, last, base, every, score, matches = test_base_phrases_equal_brute_force.scanner.scan(text)
    assert (n, nb, first, last, ",".join(base)) == slow_license(text)
    assert set(base) <= set(every) and 0 <= score <= 1


test_base_phrases_equal_brute_force.scanner = license.Scanner()


def test_templates():
    scan = license.Scanner().scan
    label = lambda t: scan(t)[5]
    assert label("Licensed under the Apache License, Version 2.0.") == label("licensed under the terms of the Apache License 2.0") == ["apache-2.0"]
    assert label("licensed under the apache licence version 2.0") == []
    assert label("Released under the MIT License.") == ["mit"]
    assert label("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files") == ["mit-grant"]
    assert "gpl-3" in label("This work is licensed under the GNU General Public License, version 3.")
    a = license.Automaton("a [[b [[c]]]] {{x:1-2}} d")
    for words, end in (("a x d", 3), ("a b c x y d", 6), ("a c x d", 4), ("a b x y z d", -1), ("a d", -1), ("a b x d d", 5)):
        assert a.match(words.split(), 0) == end


def slow_ends(tokens, words, at):
    """Every place where a match of the template's tokens from ``at`` can end, by backtracking."""
    if not tokens:
        return {at}
    t = tokens[0]
    if t == "[[":
        depth, end = 1, 1
        while depth:
            depth += (tokens[end] == "[[") - (tokens[end] == "]]")
            end += 1
        out = slow_ends(tokens[end:], words, at)
        return out.union(*(slow_ends(tokens[end:], words, x) for x in slow_ends(tokens[1 : end - 1], words, at)))
    if t.startswith("{{"):
        low, high = map(int, t[2:-2].rpartition(":")[2].split("-"))
        return set().union(*(slow_ends(tokens[1:], words, at + n) for n in range(low, high + 1) if at + n <= len(words)))
    return slow_ends(tokens[1:], words, at + 1) if at < len(words) and words[at] == t else set()


def slow_matches(template, words):
    tokens, out, at = re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[a-z0-9]+", template), [], 0
    while at < len(words):
        end = max(slow_ends(tokens, words, at), default=-1)
        out += [(at, end)] if end > at else []
        at = end if end > at else at + 1
    return out


TOY = {"one": "a [[b [[c]]]] {{x:1-2}} dd", "two": "[[ee]] {{x:0-2}} ee", "three": "[[bb]] a {{y:0-1}} [[bb a]] bb"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd", "ee", "bb", "x"]), max_size=30))
def test_template_matches_equal_backtracking(words):
    got = license.Scanner(TOY).scan(" ".join(words))[7]
    assert sorted(got) == sorted((label, a, b) for label, t in TOY.items() for a, b in slow_matches(t, words))


MIT = """The MIT License (MIT)

Copyright (c) 2024 Some One <some@one.example>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses():
    scan = license.Scanner().scan
    for before in ("", "words before " * 500):
        n, *_, every, score, matches = scan(before + MIT + " words after")
        assert {"mit-text", "mit-grant"} <= set(every) and score > 0.999
        assert ("mit-text", n - 2 - len(license.WORD.findall(license.lowered(MIT))), n - 2) in matches
    assert "mit-text" not in scan(MIT.replace("NONINFRINGEMENT", "INFRINGEMENT"))[5]  # mandatory wording must match exactly
    for label, template in license.TEMPLATES.items():  # a template's own mandatory words, with replaceable regions filled
        words = []
        for t in license.Automaton._tokens(re.sub(r"\[\[[^\[\]]*\]\]", "", re.sub(r"\[\[[^\[\]]*\]\]", "", re.sub(r"\[\[[^\[\]]*\]\]", "", template)))):
            words += [t] if t[0].isalnum() else ["filler"] * int(t[2:-2].rpartition(":")[2].split("-")[0])
        found = scan("zz " + " ".join(words) + " zz")
        assert label in found[5] and found[6] >= 1 - 2 ** (-len([t for t in words if t != "filler"]) / 3) - 1e-9
    assert 0 < scan("cc by")[6] < scan("licensed under the gnu general public license")[6] < 1 and scan("x")[6] == 0


def test_license_query(spark, odd, empty):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.scan(odd).collect()}
    assert got == {(r.doc_id, *slow_license(r.text or "")) for r in odd.collect()}
    assert license.scan(empty).count() == 0


# -- SimHash


def slow_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def joined_by_links(keys, values):
    """Smallest key that links reach, by brute force over all pairs."""
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        least[root(i)] = min([x for x in (k, least.get(root(i))) if x is not None], default=None)
    return [least[root(i)] for i in range(len(keys))]


def test_near_duplicates(spark, odd, empty, data):
    for df in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        fps = [slow_fingerprint(r.text or "") if len(r.text or "") < 10_000 else simhash.fingerprint(r.text) for r in rows]
        want = sorted(zip([r.doc_id for r in rows], fps, joined_by_links([r.doc_id for r in rows], fps), strict=True), key=repr)
        got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
        assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(4) == 0 and ids.count(3) == 1 and ids.count(None) == 1


def slow_representatives(rows):
    """(doc_id, text) of the rows kept, by brute force: one row of each component, the smallest id, ids that are null last."""
    fps = [slow_fingerprint(r[1] or "") for r in rows]
    out = []
    component = components_by_brute_force(fps)
    for root in sorted(set(component)):
        mine = [r for r, c in zip(rows, component, strict=True) if c == root]
        least = min((r[0] for r in mine if r[0] is not None), default=None)
        out.append((least, {r[1] for r in mine if r[0] == least}))
    return out


def components_by_brute_force(fps):
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root_of(up, i), root_of(up, j)
                up[max(a, b)] = min(a, b)
    return [root_of(up, i) for i in range(len(fps))]


def root_of(up, i):
    while up[i] != i:
        i = up[i]
    return i


A, B = "one text that stands here with some words of its own", "quite another text which shares nothing at all with the first one"
TABLES = {
    "one row": [(1, A)],
    "equal texts": [(k, A) for k in range(20)],
    "repeated and null keys": [(3, A), (5, A), (5, B), (None, A), (None, "a third text without an id that stands alone in this table"), (None, None), (5, B), (3, A)],
    "null keys only": [(None, A), (None, B), (None, A)],
    "letterless": [(2, ""), (1, None), (None, " ")],
}


@pytest.mark.parametrize(("name", "parts"), [*((n, p) for n in TABLES for p in (1, 8)), ("one row", 211), ("repeated and null keys", 211)])
def test_representatives_equal_brute_force(spark, name, parts):
    df = spark.createDataFrame([(*r, "clash") for r in TABLES[name]], "doc_id long, text string, fp string").repartition(parts)
    kept = [(r.doc_id, r.text) for r in simhash.representatives(df).collect()]
    want = slow_representatives(TABLES[name])
    assert len(kept) == len(want)
    for least, texts in want:
        assert sum(k == least and t in texts for k, t in kept) == 1 or least is None and any(k is None and t in texts for k, t in kept)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(TABLES[name])


def test_hot_roots_are_cut_and_lose_no_link(spark):
    rng = np.random.default_rng(10)
    x = int(rng.integers(0, 2**62))
    near = {x} | {x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))} | {int(v) for v in rng.integers(0, 2**62, 100)}
    df = spark.createDataFrame([(v,) for v in sorted(near)], "fp long")
    up = {v: v for v in near}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    values = sorted(near)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    want = {v: root(v) for v in values}
    for per_task in (8192, 50):
        links = simhash.near_links(df, per_task=per_task)
        from spanlake.llm.components import components

        got = {r.node: r.root for r in components(links).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 150, dtype=np.uint64)
    for k in range(1, 6):
        y = x[:150].copy()
        for _ in range(k):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        x = np.concatenate([x, y])
    x = np.unique(x)
    want = {(int(a), int(b)) for k, a in enumerate(x) for b in x[k + 1 :][np.bitwise_count(x[k + 1 :] ^ a) <= 4]}
    for n in (len(x), 10**7, 10**10):
        bits, choices = simhash.block_plan(n, 4)
        found = set()
        for c in choices:
            top = [b for p in c for b in bits[p]]
            below = [b for b in range(64) if b not in top]
            turned = np.zeros(len(x), np.uint64)
            for b in (*top, *below):
                turned = turned << np.uint64(1) | x >> np.uint64(b) & np.uint64(1)
            at = np.argsort(turned)
            for i, j in simhash.trie_links(x[at], turned[at] >> np.uint64(len(below)), 4, below, frontier=32):
                found |= {(min(a, b), max(a, b)) for a, b in zip(x[at][i].tolist(), x[at][j].tolist(), strict=True)}
        assert found == want
