"""Embedding near-duplicates with a hierarchical navigable small-world graph per shard.

Vectors of a label are dealt to shards; each shard's task builds a graph, and every
vector of the label queries every shard of it.  The queries of a shard are dealt in
slices, those at home in ``SLICE`` shards each, so no task has all of a label; each
slice builds the same graph.  Searches run in batches with a
beam; from a beam that is full of links a query goes on through linked nodes.  Before
its queries a shard audits itself: sampled vectors are compared with all of the
shard until enough with few links are known, and the beam is widened until the
mean recall of a linked vector reaches ``audit`` for small groups and large ones
alike.  Where no beam does, or too few vectors have links to tell, the shard is
compared exactly, by blocks.  Candidates count only if their cosine in double
precision reaches the threshold.

A pair found from either end counts for both.  Pairs of one shard meet in a bit
matrix of its task; pairs of two shards are returned as such where a query has up
to ``PAIRS`` of them in a shard.  Beyond that (a large group over several shards)
its own search gives their number.  Else a task returns numbers and a spanning
forest of the links, not all pairs.

Equal vectors of a label are one entry with a number of copies.

Results for odd input: a null label, or a vector that is null, zero or holds null
or non-finite components, or a row without an id, links with nothing: n_links 0
and its own id as component; vectors of different lengths are not compared;
repeated rows count as vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written
from spanlake.llm.components import Forest, components
from spanlake.llm.vectors import cosines, directions, matrix, usable


#: Links of one query into another shard that are returned pair by pair.
PAIRS = 64
#: Shards whose vectors query another shard in one task.
SLICE = 16


class Graph:
    """The graph of unit vectors; layer 0 holds all nodes, each layer above about a fraction 1/m."""

    def __init__(self, x: np.ndarray, m: int = 16, beam: int = 48, batch: int = 256, seed: int = 7):
        self.x, self.m, n = x, m, len(x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int64), 5)
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry = 0
        self.mark = np.zeros(0, np.int32)
        for low in range(0, n, batch):
            self._insert(np.arange(low, min(n, low + batch)), beam)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        old = int(new[0])
        top = int(self.level[self.entry]) if old else -1
        at = np.full((len(new), 1), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= layer)
            found, near = np.full((len(new), 0), -1), np.zeros((len(new), 0), np.float32)
            if layer <= top:
                found, near = self._search(self.x[new], layer, at, beam if len(mine) else 4)
                at = found[:, :4] if layer else at
            if not len(mine):
                continue
            fresh = new[mine]
            both = self.x[fresh] @ self.x[fresh].T
            np.fill_diagonal(both, -np.inf)
            k = min(beam, len(fresh))
            close = np.argpartition(-both, k - 1, axis=1)[:, :k]
            cand = np.concatenate([found[mine], np.where(np.isneginf(np.take_along_axis(both, close, 1)), -1, fresh[close])], axis=1)
            sims = np.concatenate([near[mine], np.take_along_axis(both, close, 1)], axis=1)
            chosen = self._choose(fresh, cand, sims, self.m)
            self.links[layer][fresh, : self.m] = chosen
            self._back(layer, fresh, chosen)
        highest = int(new[np.argmax(self.level[new])])
        if self.level[highest] > self.level[self.entry]:
            self.entry = highest

    def _choose(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours for each node: first those nearer to it than to any chosen before, then the nearest left."""
        sims = np.where(cand < 0, -np.inf, sims).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * self.m]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(cand, 0)]
        mutual = v @ v.transpose(0, 2, 1)
        width = cand.shape[1]
        taken, worst = np.zeros(cand.shape, bool), np.full(cand.shape, -np.inf, np.float32)
        count = np.zeros(len(nodes), np.int64)
        for k in range(width):
            ok = (cand[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (count < most)
            taken[:, k] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, mutual[:, k, :]), worst)
        rank = np.where(taken, np.arange(width), np.where(cand >= 0, width + np.arange(width), 3 * width))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(rank < 3 * width, cand, -1), pick, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
        return out.astype(np.int32)

    def _back(self, layer: int, source: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the links in the other direction; a full node chooses again."""
        table = self.links[layer]
        u, v = np.repeat(source, chosen.shape[1]), chosen.ravel()
        u, v = u[v >= 0], v[v >= 0]
        order = np.argsort(v, kind="stable")
        u, v = u[order], v[order]
        nodes, first, count = np.unique(v, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 512):
            some = slice(low, low + 512)
            width = int(count[some].max())
            pos = np.minimum(first[some, None] + np.arange(width), len(u) - 1)
            more = np.where(np.arange(width) < count[some, None], u[pos], -1)
            have = table[nodes[some]]
            more = np.where((more[:, :, None] == have[:, None, :]).any(2), -1, more)
            cand = np.concatenate([have, more], axis=1)
            sims = np.einsum("nd,nkd->nk", self.x[nodes[some]], self.x[np.maximum(cand, 0)])
            free = (cand >= 0).sum(1) <= table.shape[1]
            plain = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)[:, : table.shape[1]]
            full = ~free
            if full.any():
                plain[full] = self._choose(nodes[some][full], cand[full], sims[full], table.shape[1])
            table[nodes[some]] = plain

    def _search(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a beam for each query, best first (-1: fewer), and their cosines."""
        n, rows = len(self.x), len(q)
        if len(self.mark) < rows * n:
            self.mark = np.zeros(rows * n, np.int32)
        seen = np.zeros(rows * n, bool)
        ids, sims = np.full((rows, beam), -1, np.int64), np.full((rows, beam), -np.inf, np.float32)
        done = np.ones((rows, beam), bool)
        active = np.arange(rows)
        fresh_r, fresh_i = np.repeat(np.arange(rows), entry.shape[1]), entry.ravel().astype(np.int64)
        while True:
            ok = fresh_i >= 0
            fresh_r, fresh_i = fresh_r[ok], fresh_i[ok]
            flat = fresh_r * n + fresh_i
            ok = ~seen[flat]
            flat, fresh_r, fresh_i = flat[ok], fresh_r[ok], fresh_i[ok]
            self.mark[flat] = np.arange(len(flat), dtype=np.int32)
            ok = self.mark[flat] == np.arange(len(flat))  # one of several for the same node
            flat, fresh_r, fresh_i = flat[ok], fresh_r[ok], fresh_i[ok]
            seen[flat] = True
            if len(flat):
                s = np.einsum("pd,pd->p", q[fresh_r], self.x[fresh_i])
                better = s > sims[fresh_r, -1]
                fresh_r, fresh_i, s = fresh_r[better], fresh_i[better], s[better]
            if len(fresh_r) and len(flat):
                count = np.bincount(fresh_r, minlength=rows)
                touched = np.flatnonzero(count)
                place = np.arange(len(fresh_r)) - np.repeat((np.cumsum(count) - count)[touched], count[touched])
                row = np.repeat(np.arange(len(touched)), count[touched])
                width = int(count.max())
                new_i, new_s = np.full((len(touched), width), -1, np.int64), np.full((len(touched), width), -np.inf, np.float32)
                new_i[row, place], new_s[row, place] = fresh_i, s
                all_s = np.concatenate([sims[touched], new_s], 1)
                order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                sims[touched] = np.take_along_axis(all_s, order, 1)
                ids[touched] = np.take_along_axis(np.concatenate([ids[touched], new_i], 1), order, 1)
                done[touched] = np.take_along_axis(np.concatenate([done[touched], new_i < 0], 1), order, 1)
            open_ = ~done[active]
            active = active[open_.any(1)]
            if not len(active):
                return ids, sims
            open_ = ~done[active]
            pick = open_ & (np.cumsum(open_, axis=1) <= expand)
            r, c = np.nonzero(pick)
            r = active[r]
            done[r, c] = True
            near = self.links[layer][ids[r, c]]
            fresh_r, fresh_i = np.repeat(r, near.shape[1]), near.ravel().astype(np.int64)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry)
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self._search(q, layer, at, 4)[0]
        return self._search(q, 0, at, beam)

    def within(self, q: np.ndarray, limit: float, beam: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) pairs found with a cosine of about ``limit`` or more."""
        rows, nodes = [], []
        for low in range(0, len(q), batch):
            part = q[low : low + batch]
            if beam >= len(self.x):  # as wide as the shard: compared with all of it
                r, node = np.nonzero(part @ self.x.T >= limit)
                rows.append(low + r)
                nodes.append(node)
                continue
            ids, sims = self.search(part, min(beam, len(self.x)))
            r, c = np.nonzero(sims >= limit)
            r, node = r.astype(np.int64), ids[r, c]
            rows.append(low + r)
            nodes.append(node)
            full = np.flatnonzero(sims[:, -1] >= limit)
            for at in range(0, len(full), 64):
                own = full[at : at + 64]
                more = self._spread(part[own], *self._renumber(r, node, own), limit)
                rows.append(low + own[more[0]])
                nodes.append(more[1])
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64),) * 2

    @staticmethod
    def _renumber(r: np.ndarray, node: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = np.isin(r, own)
        return np.searchsorted(own, r[mine]), node[mine]

    def _spread(self, q: np.ndarray, r: np.ndarray, node: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """What a beam of any width would add: nodes near enough that are reached from near ones through near ones."""
        n, out_r, out_n = len(self.x), [], []
        seen = np.zeros(len(q) * n, bool)
        seen[r * n + node] = True
        while len(r):
            near = self.links[0][node]
            flat = (np.repeat(r, near.shape[1]) * n + near.ravel())[near.ravel() >= 0]
            flat = flat[~seen[flat]]
            seen[flat] = True
            flat = np.unique(flat)
            r, node = flat // n, flat % n
            ok = np.einsum("pd,pd->p", q[r], self.x[node]) >= limit
            r, node = r[ok], node[ok]
            out_r.append(r)
            out_n.append(node)
        return np.concatenate(out_r), np.concatenate(out_n)

    def audited_beam(self, limit: float, audit: float, beam: int, sample: int = 512, least: int = 64) -> int:
        """The smallest of beam, 2 beam, ... with which linked nodes find the share ``audit`` of their links, or all nodes.

        Nodes are compared with all others, in random order, until ``sample`` with
        less than ``beam`` links are known.  Each size of group (by powers of two)
        must reach the share, as the mean over its nodes; with fewer than ``least``
        linked nodes, or from a beam of a quarter of the nodes on, it's exact.
        """
        n, few = len(self.x), 0
        order = np.random.default_rng(11).permutation(n)
        pick, there = [], []
        for low in range(0, n, 64):
            part = order[low : low + 64]
            near = self.x[part] @ self.x.T >= limit
            near[np.arange(len(part)), part] = False
            count = near.sum(1)
            pick.append(part[count > 0])
            there.append(count[count > 0])
            few += int(((count > 0) & (count < beam)).sum())
            if few >= sample:
                break
        pick, there = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pick, there))
        if len(pick) < least:
            return n
        size = np.log2(there).astype(np.int64)
        some = np.sort(np.concatenate([np.flatnonzero(size == k)[:sample] for k in np.unique(size)]))
        pick, there, size = pick[some], there[some], size[some]
        while 4 * beam < n:
            got = np.zeros(len(pick))
            for low in range(0, len(pick), 256):
                r, c = self.within(self.x[pick[low : low + 256]], limit, beam)
                got += np.bincount(low + r[pick[low + r] != c], minlength=len(pick))
            share = np.bincount(size, np.minimum(got / there, 1)) / np.maximum(np.bincount(size), 1)
            if (share[np.unique(size)] >= audit).all():
                return beam
            beam *= 2
        return n


class Pairs:
    """The pairs of a shard's nodes found from either end, as bits."""

    def __init__(self, n: int):
        self.bits = np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, r: np.ndarray, node: np.ndarray) -> None:
        rows, at = np.unique(r, return_inverse=True)
        for low in range(0, len(rows), 256):
            mine = (at >= low) & (at < low + 256)
            dense = np.zeros((min(256, len(rows) - low), len(self.bits)), bool)
            dense[at[mine] - low, node[mine]] = True
            self.bits[rows[low : low + 256]] |= np.packbits(dense, axis=1)

    def counts(self, copies: np.ndarray) -> np.ndarray:
        """For each node the copies of all nodes it is paired with."""
        n, out = len(self.bits), []
        for low in range(0, n, 256):
            own = np.unpackbits(self.bits[low : low + 256], axis=1, count=n)
            back = np.unpackbits(self.bits[:, low // 8 : low // 8 + 32], axis=1)[:, : len(own)].T
            out.append((own | back) @ copies)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def shard_links(rows: DataFrame, threshold: float, audit: float, beam: int, m: int) -> DataFrame:
    """Rows from shards; ``rows`` has _label, _dim, _shard, _slice, _home, _kind, _cid, _copies, _v.

    (node, other) is a link of the forest; with n_links and ``there``, that number
    of links of the node into the shard ``there``; with n_links, back and ``there``,
    one pair of nodes of different shards: n_links are the copies of other, which
    is in ``there``, and back those of node, which is in ``home``.

    A partition holds whole slices of a shard's queries; of each the indexed
    vectors (kind 0) come before the queries (kind 1), which stream past the graph
    in batches.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("node", "other", "n_links", "there", "back", "home")])

    def out(**cols):
        size = len(cols["node"])
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(cols[f.name], size), pa.int64()) if f.name in cols else pa.nulls(size, pa.int64()) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, graph = None, [], None

        def index():
            t = pa.Table.from_batches(held)
            v = matrix(t["_v"])
            g = Graph(directions(v), m)
            return g, v, t["_cid"].to_numpy(), t["_copies"].to_numpy(), Forest(len(v)), g.audited_beam(threshold - 1e-4, audit, beam), Pairs(len(v))

        def close():
            if graph is not None:
                _, _, cid, copies, forest, _, pairs = graph
                u, v = forest.edges()
                yield out(node=cid[u], other=cid[v])
                total = pairs.counts(copies)
                some = np.flatnonzero(total)
                yield out(node=cid[some], n_links=total[some], there=place[2])

        def ask(own: np.ndarray, v: np.ndarray, home: np.ndarray, number: np.ndarray):
            g, stored, cid, copies, forest, width, pairs = graph
            r, node = g.within(directions(v), threshold - 1e-4, width)
            other = cid[node] != own[r]
            r, node = r[other], node[other]
            near = [cosines(v[r[k : k + 100_000]], stored[node[k : k + 100_000]]) >= threshold for k in range(0, len(r), 100_000)]
            if not near:
                return
            near = np.concatenate(near)
            r, node = r[near], node[near]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, node = r[order], node[order]
            first = np.concatenate([[True], r[1:] != r[:-1]])
            forest.link(node, node[np.flatnonzero(first)[np.cumsum(first) - 1]])
            yield out(node=own[r[first]], other=cid[node[first]])
            mine = home[r] == place[2]
            if mine.any():
                pairs.add(np.searchsorted(cid, own[r[mine]]), node[mine])
            size = np.bincount(r, minlength=len(own))
            few = ~mine & (size[r] <= PAIRS)
            if few.any():
                yield out(node=own[r[few]], other=cid[node[few]], n_links=copies[node[few]], there=place[2], back=number[r[few]], home=home[r[few]])
            many = first & ~mine & (size[r] > PAIRS)
            if many.any():
                yield out(node=own[r[many]], n_links=np.bincount(r, copies[node], len(own)).astype(np.int64)[r[many]], there=place[2])

        for b in batches:
            names = list(zip(b["_label"].to_pylist(), b["_dim"].to_pylist(), b["_shard"].to_pylist(), b["_slice"].to_pylist(), strict=True))
            kind = b["_kind"].to_numpy()
            cut = [k for k in range(len(names)) if not k or names[k] != names[k - 1] or kind[k] != kind[k - 1]] + [len(names)]
            for low, high in zip(cut, cut[1:], strict=False):
                part = b.slice(low, high - low)
                if names[low] != place:
                    yield from close()
                    place, held, graph = names[low], [], None
                if kind[low] == 0:
                    held.append(part)
                    continue
                if graph is None:
                    graph, held = index(), []
                own, v, home, number = part["_cid"].to_numpy(), matrix(part["_v"]), part["_home"].to_numpy(), part["_copies"].to_numpy()
                for at in range(0, len(own), 256):
                    yield from ask(*(x[at : at + 256] for x in (own, v, home, number)))
        yield from close()

    return rows.select("_label", "_dim", "_shard", "_slice", "_home", "_kind", "_cid", "_copies", "_v").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def link_counts(found: DataFrame) -> DataFrame:
    """(node, _n) from the rows of ``shard_links``: each pair counts for both ends, once."""
    sure = found.where("n_links is not null and back is null").select("node", "there", "n_links")
    pairs = found.where("back is not null")
    turned = pairs.select(F.col("other").alias("node"), F.col("node").alias("other"), F.col("back").alias("n_links"), F.col("home").alias("there"))
    # a number that a node's own search gives for a shard holds the pairs found from there
    turned = turned.join(sure.select("node", "there"), ["node", "there"], "left_anti").select("node", "other", "n_links")
    each = pairs.select("node", "other", "n_links").unionByName(turned).distinct().select("node", "n_links")
    return sure.select("node", "n_links").unionByName(each).groupBy("node").agg(F.sum("n_links").alias("_n"))


def near_duplicates(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = 16384, audit: float = 0.98, beam: int = 48, m: int = 16) -> DataFrame:
    """key, n_links, component_id and kept for every row of ``df``."""
    valid = usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.col(vector).cast("array<double>").alias("_v"), valid.alias("_ok"))
    entries = rows.where("_ok").groupBy("_label", "_v").agg(F.min("_id").alias("_low"), F.count("*").alias("_copies")).withColumn("_dim", F.size("_v"))
    entries = written(entries.withColumn("_cid", F.monotonically_increasing_id()), "entries")
    shards = entries.groupBy("_label", "_dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_shards"))
    entries = entries.join(shards, ["_label", "_dim"])
    entries = entries.withColumn("_home", F.pmod(F.xxhash64("_cid"), "_shards").cast("int"))
    last = F.expr(f"(_shards - 1) div {SLICE}").cast("int")
    stored = entries.select("*", F.col("_home").alias("_shard"), F.explode(F.sequence(F.lit(0), last)).alias("_slice"), F.lit(0).alias("_kind"))
    asking = entries.select("*", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard"), F.expr(f"_home div {SLICE}").cast("int").alias("_slice"), F.lit(1).alias("_kind"))
    total = max(1, shards.agg(F.sum(F.col("_shards") * (last + 1))).first()[0] or 1)
    dealt = stored.unionByName(asking).repartition(min(1 << 16, 4 * total), "_label", "_dim", "_shard", "_slice").sortWithinPartitions("_label", "_dim", "_shard", "_slice", "_kind", "_cid")
    found = written(shard_links(dealt, threshold, audit, beam, m), "links")
    counts = link_counts(found)
    member = components(found.where("other is not null and n_links is null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = entries.select("_cid", "_label", "_v", "_low", "_copies").join(counts, F.col("_cid") == counts["node"], "left").drop("node").join(member, F.col("_cid") == member["node"], "left")
    named = written(named.select("_label", "_v", "_low", (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("root", "_cid").alias("_root")), "named")
    least = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = named.join(least, "_root").select("_label", "_v", "n_links", "component_id")
    out = rows.where("_ok").join(named, ["_label", "_v"]).select("_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(key), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
