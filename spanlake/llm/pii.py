"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns and are certain.  The field's nodes are a
document's base spans and its other candidates: runs of digits, and tokens with
an ``@`` or with digits and letters.  Each node has a potential from its shape,
neighbouring nodes share one, and so do distant nodes that repeat or resemble each
other (skip links): numbers with equal last 7 digits, last 9 that differ in one
digit, or (long ones) equal first 9, addresses of four equal numbers, equal names before an ``@``.  Skip links go
from each candidate to the first base span of each kind it is alike to, or, without
any, to the first alike; so their number is linear and a repeat's evidence does
not depend on how many there are.  Loopy sum-product message passing within the
document, run until no message changes, makes labels agree; a candidate becomes a
span when the belief in a label reaches ``certain``.

All potentials are learned from a sample of about ``train_docs`` documents with
digits or ``@`` whose base spans serve as labels (piecewise training).  The shape
potential is a multinomial logistic regression.  A base span is always written as
its pattern wants, so for each one the ways to write it otherwise (``bare``) count
as its kind and, once, as 'other': shape alone then never speaks for a kind, and
speaks against one as often as other numbers are written so.  The pair potentials
are log-ratios of smoothed counts; for the skip links each node counts as a repeat
of itself, beside the real repeats.  Candidates alike to a base span have no label
and are not counted.  Detection covers all rows and whole texts; every scan is linear.

Results for odd input: null and empty texts have no spans; spans of different
kinds may overlap; repeated rows give repeated results; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import slices, texts_of

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"(?<![0-9])[0-9](?:[ ().\-/]{0,3}[0-9])*")
TOKEN = re.compile(r"\S+")
ANY = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at + 1)):
            low = at
            while low > done and text[low - 1] in LOCAL:
                low -= 1
            if low < at:
                out.append((low, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def shape(text: str, low: int, high: int) -> int:
    """Features of a candidate as bits."""
    t = text[low:high]
    digits = sum(c.isdigit() and c.isascii() for c in t)
    letters = sum(c.isalpha() for c in t)
    parts = t.split(".")
    quad = len(parts) == 4 and all(p.isdigit() for p in parts)
    groups = re.findall("[0-9]+", t)
    bits = [
        digits == 0, 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 8, 9 <= digits <= 11, 12 <= digits <= 15, digits == 16, digits > 16,
        letters > 0, "@" in t, quad, quad and all(len(p) <= 3 and int(p) <= 255 for p in parts), 12 <= digits <= 19 and luhn("".join(c for c in t if c.isdigit() and c.isascii())),
        low > 0 and text[low - 1] == "+" or t[0] == "+", "(" in t, "-" in t, " " in t, "." in t[:-1], "/" in t, high < len(text) and text[high] == "%",
        len(groups) == 4 and all(len(p) <= 3 for p in groups),
    ]
    return sum(1 << k for k, b in enumerate(bits) if b)


N_FEATURES = 21


def likeness(kind: str | None, t: str) -> tuple[str, ...]:
    """Nodes that share one of these are linked; the surest comes first."""
    out = []
    parts = re.findall("[0-9]+", t)
    if kind == "ip" or kind is None and len(parts) == 4 and all(len(p.lstrip("0")) <= 3 for p in parts):
        out.append("i:" + ".".join(p.lstrip("0") or "0" for p in parts))
    if kind == "ip":
        return tuple(out)
    if kind == "email" or kind is None and any(c.isalpha() for c in t):
        name, at, domain = t.strip(".,;:!?()[]{}<>\"'").lower().partition("@")
        if len(name) >= 4 + name.isalpha():
            out.append("n:" + name)
        if name and at and domain:
            out.append(f"a:{name}@{domain.split('.')[0]}")
        return tuple(out)
    digits = "".join(parts)
    if len(digits) >= 7:
        out.append("d:" + digits[-7:])
    if len(digits) >= 9:
        last = digits[-9:]
        out += [f"{k}:{last[:k]}{last[k + 1:]}" for k in range(9)]
    if len(digits) >= 12 or kind is None and len(digits) == 11:
        out.append("f:" + digits[:9])
    return tuple(out)


def bare(kind: str, t: str) -> list[str]:
    """Ways to write a base span that its pattern doesn't find."""
    if kind == "email":
        name, _, domain = t.partition("@")
        return [name + "@", f"{name}@{domain.split('.')[0]}", f"{name}1"]
    digits = "".join(c for c in t if c.isdigit())
    if kind == "ip":
        return ["-".join(t.split(".")), " ".join(t.split("."))]
    cut = [4, 8, 12] if kind == "card" else [len(digits) - 7, len(digits) - 4]
    ways = [mark.join(digits[a:b] for a, b in zip([0, *cut], [*cut, len(digits)], strict=True)) for mark in (".", "/", "-")]
    if kind == "phone":
        local = digits[-10:]
        ways += [digits, local, digits[-7:], f"{local[:-7]}-{local[-7:-4]}-{local[-4:]}", f"({local[:-7]}) {local[-7:-4]}-{local[-4:]}", f"{local[-7:-4]}-{local[-4:]}"]
    else:
        ways += [digits[:-1], digits[1:], digits[:-1] + str((int(digits[-1]) + 1) % 10)]
    return ways


def nodes(text: str) -> list[tuple[int, int, int, int, tuple[str, ...]]]:
    """(start, end, label or -1, shape, likeness) of base spans and other candidates, by start."""
    spans = base_spans(text)
    out = [(a, b, LABELS.index(k), shape(text, a, b), likeness(k, text[a:b])) for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    from bisect import bisect_left

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    extra = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for m in TOKEN.finditer(text):
        t = m[0]
        if ("@" in t or ANY.search(t)) and any(c.isalpha() for c in t):
            a, b = m.start(), m.end()
            while b > a and text[b - 1] in ".,;:!?)]}>\"'":
                b -= 1
            while a < b and text[a] in "([{<\"'":
                a += 1
            if a < b:
                extra.append((a, b))
    last = -1
    for a, b in sorted(extra, key=lambda x: (x[0], -x[1])):
        if a >= last and free(a, b):
            out.append((a, b, -1, shape(text, a, b), likeness(None, text[a:b])))
            last = b
    return sorted(out)


def links(found: list[tuple[int, int, int, int, tuple[str, ...]]], near: int = 3) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours (up to ``near`` characters apart) and ones alike, as index pairs.

    Of those alike each base span is linked to the one before, and each candidate
    to the first base span of each kind or, without any, to the first candidate.
    """
    chain = [(k, k + 1) for k in range(len(found) - 1) if 0 <= found[k + 1][0] - found[k][1] <= near]
    hubs: dict[str, dict[int, int]] = {}
    last: dict[str, int] = {}
    skip: dict[tuple[int, int], None] = {}
    for k, x in enumerate(found):
        if x[2] >= 0:
            for name in x[4]:
                hubs.setdefault(name, {}).setdefault(x[2], k)
            for name in x[4][:1]:
                if name in last:
                    skip[last[name], k] = None
                last[name] = k
    for k, x in enumerate(found):
        if x[2] < 0:
            base = {hub: None for name in x[4] for hub in hubs.get(name, {}).values()}
            skip.update(((hub, k), None) for hub in base)
            if not base and x[4]:
                hub = last.setdefault(x[4][0], k)
                if hub != k:
                    skip[hub, k] = None
    return chain, list(skip)


def tally(text: str) -> Counter:
    """Counts for ``Field.fit``; candidates alike to a base span are hidden, the others are labelled 'other'."""
    found = nodes(text)
    alike = {name for x in found if x[2] >= 0 for name in x[4]}
    label = [x[2] if x[2] >= 0 else -1 if alike.intersection(x[4]) else 0 for x in found]
    c: Counter = Counter()
    for x, y in zip(found, label, strict=True):
        if y >= 0:
            c["shape", x[3], y] += 1
            c["skip", y, y] += 1
        if y > 0:
            for t in bare(LABELS[y], text[x[0] : x[1]]):
                for z in nodes(f" {t} "):
                    if z[2] < 0:
                        c["shape", z[3], y] += 1
                        c["shape", z[3], 0] += 1
    chain, skip = links(found)
    c.update(("chain", label[i], label[j]) for i, j in chain if label[i] >= 0 and label[j] >= 0)
    c.update(("skip", label[i], label[j]) for i, j in skip if label[i] >= 0 and label[j] >= 0)
    return c


class Field:
    """Potentials of the field; ``fit`` learns them from counts."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    @staticmethod
    def design(shapes: np.ndarray) -> np.ndarray:
        x = (shapes[:, None] >> np.arange(N_FEATURES)) & 1
        return np.concatenate([x, np.ones((len(shapes), 1), np.int64)], 1).astype(np.float64)

    @classmethod
    def fit(cls, counts: Counter, steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> Field:
        """counts: ("shape", shape, label), ("chain", a, b) and ("skip", a, b)."""
        n = len(LABELS)
        rows = [(s, y, c) for (kind, s, y), c in sorted(counts.items()) if kind == "shape"]
        weights = np.zeros((N_FEATURES + 1, n))
        if rows:
            s, y, c = (np.array(x) for x in zip(*rows, strict=True))
            x, truth = cls.design(s), np.eye(n)[y]
            share = c / c.sum()
            speed = np.zeros_like(weights)
            for _ in range(steps):
                z = x @ weights
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                speed = 0.9 * speed - rate * (x.T @ ((p - truth) * share[:, None]) + decay * weights)
                weights = weights + speed
        pairs = []
        for kind in ("chain", "skip"):
            table = np.full((n, n), 0.5)  # so that few examples don't turn a potential round
            for (what, a, b), c in counts.items():
                if what == kind:
                    table[a, b] += c / 2
                    table[b, a] += c / 2
            table /= table.sum()
            own = table.sum(1)
            pairs.append(np.log(table / (own[:, None] * own)))
        return cls(weights, *pairs)

    def beliefs(self, shapes: np.ndarray, given: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int | None = None, close: float = 1e-4) -> np.ndarray:
        """The belief in each label for each node; ``given`` labels (not -1) are certain.  Links are index pairs.

        A message is sent again while what comes into its node changes, so a
        forest of any depth gets its exact beliefs.  Rounds end, without a given
        number, when no log-message is off by ``close``; a graph with loops whose
        messages swing is damped more and more.
        """
        z = self.design(shapes) @ self.weights
        unary = z - np.logaddexp.reduce(z, axis=1, keepdims=True)
        known = given >= 0
        unary[known] = -50.0
        unary[np.flatnonzero(known), given[known]] = 0.0
        edges = np.concatenate([chain.reshape(-1, 2), skip.reshape(-1, 2)])
        if not len(edges):
            return np.exp(unary)
        pair = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
        table = np.repeat(np.arange(4), [len(chain.reshape(-1, 2)), len(skip.reshape(-1, 2))] * 2)
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        leaving = np.argsort(a, kind="stable")
        first = np.searchsorted(a[leaving], np.arange(len(unary) + 1))
        message, total = np.zeros((len(a), len(LABELS))), unary.copy()
        wait, at, step = np.arange(len(a)), 0, 1.0
        while len(wait) and (rounds is None or at < rounds):
            out = np.logaddexp.reduce((total[a[wait]] - message[back[wait]])[:, :, None] + pair[table[wait]], axis=1)
            out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
            off = out - message[wait]
            far = np.abs(off).max(1) >= close
            wait, off = wait[far], off[far]
            at += 1
            step = 1.0 if at <= 20 else 0.5 if at <= len(unary) + 100 else 0.99 * step
            message[wait] += step * off
            np.add.at(total, b[wait], step * off)
            # next: messages not yet at their value, and those leaving a node that got news
            news = np.unique(b[wait])
            size = first[news + 1] - first[news]
            more = leaving[np.arange(int(size.sum())) + np.repeat(first[news] - np.cumsum(size) + size, size)]
            wait = np.union1d(wait[step * np.abs(off).max(1) >= close] if step < 1 else wait[:0], more)
            if step < close:
                break
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))

    def find(self, texts: list[str], certain: float = 0.9) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """For each text, whose graph is its own, its base spans and the spans the field adds."""
        out: list[tuple[list, list]] = []
        for text in texts:
            found = nodes(text) if ANY.search(text) else []
            base = [(LABELS[x[2]], x[0], x[1]) for x in sorted(found, key=lambda x: (x[0], x[2])) if x[2] >= 0]
            more = []
            if len(base) < len(found):
                chain, skip = links(found)
                belief = self.beliefs(np.array([x[3] for x in found], np.int64), np.array([x[2] for x in found]), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))
                more = [(LABELS[1 + int(b[1:].argmax())], x[0], x[1]) for x, b in zip(found, belief, strict=True) if x[2] < 0 and b[1:].max() >= certain]
            out.append((base, more))
        return out


def train(df: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = 20_000) -> Field:
    """The field learned from about ``train_docs`` documents, taken by a hash of key and text."""
    rows = df.select(F.col(text).alias("__spanlake_text"), F.col(key).cast("string").alias("_key")).where(F.col("__spanlake_text").rlike("[0-9@]"))
    n = rows.count()
    place = F.pmod(F.xxhash64("_key", "__spanlake_text"), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b["__spanlake_text"].to_pylist():
                c.update(tally(t))
            yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in c], "a": [k[1] for k in c], "b": [k[2] for k in c], "n": list(c.values())}, schema=pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    sample = rows.where(place < min(1.0, train_docs / max(n, 1))).select("__spanlake_text")
    got = sample.mapInArrow(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Field.fit(Counter({(r["kind"], r["a"], r["b"]): r["n"] for r in got}))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def detect(df: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",), certain: float = 0.9) -> DataFrame:
    """``keep`` columns, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all ``spans``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    out = StructType([df.schema[c] for c in keep])
    for k in KINDS:
        out = out.add(f"n_{k}", LongType())
    out = out.add("base_sha256", StringType()).add("spans", StringType())
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000, "__spanlake_text"):
                found = field.find(texts_of(part, "__spanlake_text"), certain)
                cols = [part[c].cast(schema.field(c).type) for c in keep]
                cols += [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(base + more) for base, more in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.select(*keep, F.col(text).alias("__spanlake_text")).mapInArrow(run, out)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earlier, and longer, stays."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = b
        elif b > done:  # the rest of an overlapping span goes with the one before
            done = b
    return "".join([*out, text[done:]])


def redact(df: DataFrame, field: Field, text: str = "text", certain: float = 0.9) -> DataFrame:
    """All columns of ``df`` with the spans in ``text`` masked; a null text stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000, text):
                raw = part[text].to_pylist()
                found = field.find([t or "" for t in raw], certain)
                new = [t if t is None or not (base or more) else masked(t, base + more) for t, (base, more) in zip(raw, found, strict=True)]
                cols = [part.column(k).cast(schema.field(k).type) for k in range(part.num_columns)]
                cols[place] = pa.array(new, schema.field(place).type)
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.mapInArrow(run, df.schema)
