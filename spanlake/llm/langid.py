"""Language identification with interpolated Kneser-Ney character models.

A text is a sequence of words (runs of letters and of marks after a letter,
lower-cased); each word's symbols and its end are predicted from up to three
symbols before them.  The models of
all languages share sorted arrays of n-gram hashes; a row holds the interpolated
log-probability of the n-gram under each language, so one binary search serves
every language.  An n-gram that no language has falls back to the next shorter
one, times each language's back-off weight of its context.

The language with the lowest cross-entropy per symbol wins.  A text is rejected
when that cross-entropy is above what labelled texts of its length have shown
(calibration), or when it has no letters.

Training is a bounded sample of labelled rows, whole texts in the order of a hash:
for each language one at least and about ``train_chars`` characters (up to 80 % of
them) for the counts, and those that follow, ``tune_chars``, for the calibration,
at any size of input.  Rows that repeat key (or have none) and text are one row of
the sample.  Prediction covers all rows and whole texts.

Results for odd input: null, empty or letterless text (marks alone too) gives ``und``, score 0 and
is rejected; without any labelled row every text gives ``und`` and only
letterless ones are rejected.  Ties between languages go to the first by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import slices, texts_of

ORDER = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The symbols to predict with those before them (nearest first), and each one's word.

    Symbol 0 is the end of a word; before its start all symbols are 0.
    """
    if not words:
        return [np.zeros(0, np.uint64)] * ORDER, np.zeros(0, np.int64)
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(code, return_inverse=True)
    kind = np.array([unicodedata.category(chr(c))[0] if c < 0x110000 else "C" for c in kinds.tolist()])[at]
    place = np.arange(len(code))
    broken = np.maximum.accumulate(np.where((kind == "L") | (kind == "M"), -1, place))
    letter = (kind == "L") | (kind == "M") & (np.maximum.accumulate(np.where(kind == "L", place, -1)) > broken)
    word = np.cumsum(code == 10) - 1
    s = np.where(letter, code, 0).astype(np.uint64)
    told = np.zeros(len(s), bool)
    told[1:] = (s[1:] != 0) | (s[:-1] != 0)  # letters, and the place after the last of a run
    out = [s]
    for k in range(1, ORDER):
        back = np.zeros(len(s), np.uint64)
        back[k:] = s[:-k]
        if k > 1:
            back[out[-1] == 0] = 0
        out.append(back)
    end = told & (s == 0)
    word = np.where(end, np.concatenate([[0], word[:-1]]), word)  # an end belongs to the word before it
    return [x[told] for x in out], word[told]


def keyed(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of symbols, the farthest first."""
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = (h ^ (h >> np.uint64(29))) * MIX + x + np.uint64(1)
    return h


def seek(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Models:
    """``fit`` makes it from the words of each language and their counts."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # by order from 1: hashes, log-probabilities
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []  # hashes, log back-off weights
        self.sharpness, self.limits, self.uniform = 1.0, {}, np.zeros(0)

    @classmethod
    def fit(cls, counts: dict[str, tuple[list[str], np.ndarray]]) -> Models:
        out = cls(sorted(counts))
        # the distinct n-grams of each order and language, with counts (highest order) or numbers of symbols before them
        tables: list[dict[str, tuple]] = [{} for _ in range(ORDER + 1)]
        for lang, (words, times) in counts.items():
            grams, word = symbols(words)
            value = times[word].astype(np.float64)
            for k in range(ORDER, 0, -1):
                key = keyed(grams[:k][::-1])
                hashes, first, at = np.unique(key, return_index=True, return_inverse=True)
                value = np.bincount(at, value, len(hashes))
                grams = [x[first] for x in grams[:k]]
                context = keyed(grams[1:k][::-1]) if k > 1 else np.zeros(len(hashes), np.uint64)
                once, twice = (value == 1).sum(), (value == 2).sum()
                discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
                tables[k][lang] = (hashes, value, grams, context, discount)
                value = np.ones(len(hashes))
        alphabet = 2 + len(np.unique(np.concatenate([t[0] for t in tables[1].values()]))) if tables[1] else 2
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(1, ORDER + 1):
            merged = np.concatenate([t[0] for t in tables[k].values()])
            parts = [np.concatenate([t[2][d] for t in tables[k].values()]) for d in range(k)]
            context = np.concatenate([t[3] for t in tables[k].values()])
            hashes, first = np.unique(merged, return_index=True)
            parts, context = [p[first] for p in parts], context[first]
            contexts = np.unique(context)
            if lower is None:
                below = np.full((len(hashes), len(out.langs)), 1 / alphabet)
            else:
                below = lower[1][seek(lower[0], keyed(parts[: k - 1][::-1]))[0]]
            p, back = np.empty((len(hashes), len(out.langs))), np.ones((len(contexts), len(out.langs)))
            for c, lang in enumerate(out.langs):
                own, value, _, own_context, discount = tables[k][lang]
                names, at = np.unique(own_context, return_inverse=True)
                total, followers = np.bincount(at, value, len(names)), np.bincount(at, minlength=len(names))
                i, there = seek(names, contexts)
                back[:, c] = np.where(there, discount * followers[i] / total[i], 1.0)
                i, there = seek(own, hashes)
                n = np.where(there, value[i], 0)
                i, there = seek(names, context)
                weight = discount * followers[i] / total[i]
                p[:, c] = np.where(there, np.maximum(n - discount, 0) / total[i] + weight * below[:, c], below[:, c])
            out.grams.append((hashes, np.log(p).astype(np.float32)))
            out.contexts.append((contexts, np.log(back).astype(np.float32)))
            lower = (hashes, p)
        out.rare = np.float32(-np.log(alphabet))
        out.uniform = np.array([np.log(2 + len(tables[1][x][0])) for x in out.langs])
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities under each language, and number of symbols, for each word."""
        s, word = symbols(words)
        if not self.langs:
            return np.zeros((len(words), 0)), np.bincount(word, minlength=len(words))
        total = np.zeros((len(word), len(self.langs)), np.float32)
        left = np.arange(len(word))
        for k in range(ORDER, 0, -1):
            part = [x[left] for x in s[:k]]
            hashes, logs = self.grams[k - 1]
            at, there = seek(hashes, keyed(part[::-1]))
            total[left[there]] += logs[at[there]]
            left = left[~there]
            if not len(left):
                break
            contexts, logs = self.contexts[k - 1]
            key = keyed([x[~there] for x in part[1:]][::-1]) if k > 1 else np.zeros(len(left), np.uint64)
            at, there = seek(contexts, key)
            total[left[there]] += logs[at[there]]
        else:
            total[left] += self.rare
        sums = np.stack([np.bincount(word, total[:, c], len(words)) for c in range(len(self.langs))], 1)
        return sums, np.bincount(word, minlength=len(words))

    def tune(self, lang: np.ndarray, n: np.ndarray, entropy: np.ndarray) -> None:
        """Sharpness of the score and, by language, the highest usual cross-entropy, from labelled texts.

        For texts of n symbols the limit is the mean plus ``far`` times
        sqrt(spread**2 + noise**2 / n), where ``far`` is 1.5 times the quantile
        0.995 of the language's own labelled texts, 6 at least.  It stays between
        the middle from the mean to what a uniform choice from the language's own
        alphabet has, so that mixed texts are kept, and that uniform level with
        its noise, above which the model explains nothing.
        """
        own = np.array([self.langs.index(x) for x in lang], np.int64)
        gap = entropy - entropy.min(1, keepdims=True)
        best = np.inf
        for b in 2.0 ** np.arange(-6, 7):
            z = -b * gap * np.sqrt(n)[:, None]
            loss = -np.mean(z[np.arange(len(own)), own] - np.log(np.exp(z).sum(1)))
            if loss < best - 1e-9:
                best, self.sharpness = loss, float(b)
        for c, name in enumerate(self.langs):
            h, m = entropy[own == c, c], n[own == c]
            if len(h):
                mean = float(np.average(h, weights=np.minimum(m, 1000)))
                noise = float(np.median(np.abs(h - mean) * np.sqrt(m))) * 1.5 + 1e-6
                spread = float(np.median(np.abs(h - mean))) * 1.5 + 1e-6
                z = (h - mean) / np.sqrt(spread**2 + noise**2 / m)
                self.limits[name] = (mean, spread, noise, 1.5 * max(float(np.quantile(z, 0.995)), 4.0))

    def decide(self, n: np.ndarray, entropy: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy of that language and rejection for each text."""
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), n == 0
        best = entropy.argmin(1)
        low = entropy.min(1)
        score = 1 / np.exp(-self.sharpness * (entropy - low[:, None]) * np.sqrt(n)[:, None]).sum(1)
        limit = np.full(len(n), np.inf)
        for c, name in enumerate(self.langs):
            if name in self.limits:
                mean, spread, noise, far = self.limits[name]
                mine = best == c
                usual = mean + far * np.sqrt(spread**2 + noise**2 / np.maximum(n[mine], 1))
                limit[mine] = np.clip(usual, (mean + self.uniform[c]) / 2, self.uniform[c] + 2 * noise / np.sqrt(np.maximum(n[mine], 1)))
        none = n == 0
        lang = ["und" if z else self.langs[b] for b, z in zip(best.tolist(), none.tolist(), strict=True)]
        return lang, np.where(none, 0.0, score), np.where(none, 0.0, low), none | (low > limit)


class Scorer:
    """Cross-entropies of whole texts; each distinct word is scored once while it is held."""

    def __init__(self, models: Models, hold: int = 300_000):
        self.models, self.hold = models, hold
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.models.langs)), np.float32)
        self.sizes = np.zeros(0, np.int32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and cross-entropy per symbol under each language, for each text."""
        if len(self.at) > self.hold:
            self.clear()
        words = [t.split() for t in texts]
        new: set[str] = set()
        for w in words:
            new.update(w)
        fresh = sorted(new.difference(self.at))
        for low in range(0, len(fresh), 50_000):
            some = fresh[low : low + 50_000]
            sums, sizes = self.models.score(some)
            self.at.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some)), strict=True))
            self.sums = np.concatenate([self.sums, sums.astype(np.float32)])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        n, h = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.models.langs)))
        get = self.at.__getitem__
        for k, w in enumerate(words):
            if w:
                i = np.fromiter(map(get, w), np.int64, len(w))
                n[k] = self.sizes[i].sum()
                h[k] = -self.sums[i].sum(0, dtype=np.float64) / max(n[k], 1)
        return n, h


def held_out(key: str):
    """Rows kept from training: those whose key's CRC-32, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_chars: int = 2_000_000, tune_chars: int = 1_000_000) -> Models:
    """Models from a bounded sample of the labelled rows that aren't held out.

    Of each language whole texts are taken in the order of a hash of key and text:
    the first and those up to ``train_chars`` characters or 80 % of the language's
    for training, the following up to ``tune_chars`` for the calibration.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(text).alias("__spanlake_text"), F.col(lang).alias("_lang"), F.col(key).cast("string").alias("_key"))
    rows = rows.where("__spanlake_text <> ''").withColumn("_at", F.shiftrightunsigned(F.xxhash64("_key", "__spanlake_text"), 1)).drop("_key")
    # characters by the hash's number of bits: which power of two holds enough of a language, also if training ends with its longest text
    bits = F.length(F.bin("_at"))
    sizes: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("_lang", bits.alias("bits")).agg(F.sum(F.length("__spanlake_text")).alias("n"), F.max(F.length("__spanlake_text")).alias("most")).collect():
        sizes.setdefault(r["_lang"], {})[r["bits"]] = (r["n"], r["most"])
    if not sizes:
        return Models([])
    of = lambda x: F.create_map(*[F.lit(v) for item in x.items() for v in item])[F.col("_lang")]
    held = lambda by, w: sum(n for b, (n, _) in by.items() if b <= w) - max((x for b, (_, x) in by.items() if b <= w), default=0)
    enough = {k: next((w for w in range(64) if held(by, w) >= train_chars + tune_chars), 64) for k, by in sizes.items()}
    light = rows.where(bits <= of(enough)).groupBy("_lang", "_at").agg(F.max(F.length("__spanlake_text")).alias("n"))
    order = Window.partitionBy("_lang").orderBy("_at")
    light = light.withColumn("_end", F.sum("n").over(order)).withColumn("_start", F.col("_end") - F.col("n"))
    most = of({k: 0.8 * sum(n for n, _ in by.values()) for k, by in sizes.items()})
    light = light.withColumn("_train", (F.col("_start") == 0) | (F.col("_start") < train_chars) & (F.col("_end") <= most))
    light = light.withColumn("_used", F.sum(F.when(F.col("_train"), F.col("n"))).over(order))
    tuned = ~F.col("_train") & (F.col("_start") - F.col("_used") < tune_chars)
    cuts = light.groupBy("_lang").agg(F.max(F.when(F.col("_train"), F.col("_at"))).alias("a"), F.max(F.when(F.col("_train") | tuned, F.col("_at"))).alias("b")).collect()
    part = F.when(F.col("_at") <= of({r["_lang"]: r["a"] for r in cuts}), 0).when(F.col("_at") <= of({r["_lang"]: r["b"] for r in cuts}), 1)
    sample = rows.withColumn("_part", part).where("_part is not null").dropDuplicates(["_lang", "_at"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            found: dict[str, Counter] = {}
            for t, name in zip(b["__spanlake_text"].to_pylist(), b["_lang"].to_pylist(), strict=True):
                found.setdefault(name, Counter()).update(t.split())
            for name, c in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(c), "word": list(c), "n": list(c.values())})

    got = sample.where("_part = 0").select("__spanlake_text", "_lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    counts = {}
    for name in sorted(set(got["lang"].to_pylist())):
        mine = got.filter(pa.compute.equal(got["lang"], name))
        counts[name] = (mine["word"].to_pylist(), mine["n"].to_numpy())
    models = Models.fit(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            n, h = scorer.texts(texts_of(b, "__spanlake_text"))
            yield pa.RecordBatch.from_pydict({"lang": b["_lang"], "n": n, "h": pa.array(h.tolist(), pa.list_(pa.float64()))})

    tuning = sample.where("_part = 1").select("__spanlake_text", "_lang").mapInArrow(measure, "lang string, n long, h array<double>").where("n > 0").toArrow()
    own = [k for k, x in enumerate(tuning["lang"].to_pylist()) if x in models.langs]
    if own:
        models.tune(np.array(tuning["lang"].to_pylist())[own], tuning["n"].to_numpy()[own], np.array(tuning["h"].to_pylist())[own])
    return models


def identify(df: DataFrame, models: Models, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """All columns of ``df`` (or ``keep``), with lang_pred, score, cross_entropy and rejected.

    Columns of ``df`` with these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    made = ("lang_pred", "score", "cross_entropy", "rejected")
    keep = tuple(c for c in (keep or df.columns) if c not in made)
    out = StructType([df.schema[c] for c in keep])
    for name, kind in zip(made, (StringType(), DoubleType(), DoubleType(), BooleanType()), strict=True):
        out = out.add(name, kind)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            for part in slices(batch, 4_000_000, "__spanlake_text"):
                decided = models.decide(*scorer.texts(texts_of(part, "__spanlake_text")))
                yield pa.RecordBatch.from_arrays([*(part[c].cast(schema.field(c).type) for c in keep), *(pa.array(x, schema.field(c).type) for c, x in zip(made, decided, strict=True))], schema=schema)

    return df.select(*keep, F.col(text).alias("__spanlake_text")).mapInArrow(run, out)


def known(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose text isn't rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            for part in slices(batch, 4_000_000, text):
                rejected = models.decide(*scorer.texts(texts_of(part, text)))[3]
                yield pa.RecordBatch.from_arrays([part.column(k).cast(schema.field(k).type) for k in range(part.num_columns)], schema=schema).filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)
