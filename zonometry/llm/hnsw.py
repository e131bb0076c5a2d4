"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors become one node. Nodes are dealt into shards of a bounded size, and each shard builds its graph:
nodes on nested layers, joined in batches with the diverse nearest of a beam search. A shard widens its beam
until an audit passes: probes just above the threshold, made from its own vectors, and these vectors
themselves, must find what comparing them with the whole shard finds. Every node then queries every shard, in blocks, by streams of
index chunks followed by query blocks, so a task holds one graph and one block. What a beam finds is verified by cosine in
double precision.

Links are never listed pair by pair. A shard's own links make its local groups; a query that touches a local group
is compared with all of that group's members and sends one row with their count. A query whose beam holds nothing but
links is compared with the whole shard. A second pass compares all members of two local groups that any query has joined, so
that a link counts from both of its ends. Rows of counts are the edges that make the components.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonometry.llm import common as C
from zonometry.llm.codebooks import whole
from zonometry.llm.components import components
from zonometry.session import stage

SHARD_BYTES = 16 << 20  # of vectors in a shard, beyond LEAST_SHARDS shards
LEAST_SHARDS = 4
LEAST_SLICES, MOST_SLICES = 4, 64  # of the queries; each shard meets each slice in one stream
LINKS = 16  # of a node on an upper layer; twice as many on the lowest
BUILD_BEAM, FIRST_BEAM, UPPER_BEAM = 64, 32, 8
EXPAND = 4  # beam entries whose neighbours are looked at in one step
BATCH = 512
AUDITS, AUDIT_RECALL = 256, 0.995
CHUNK_BYTES = 1 << 20
SLACK = 1e-3  # by which float32 similarities of a beam may miss the threshold before they are verified
KEY = ["width", "shard"]
ROW = "width int, from_shard int, q long, shard int, rep long, links long"


class Beam:
    """Beam search of many queries at once over one layer's lists of neighbours (-1: none)."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def search(self, lists: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``ef`` found, best first; -1 and -inf where fewer are found."""
        b, n = len(q), len(lists)
        seen = np.zeros(b * n, bool)
        ids, sims, open_ = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32), np.zeros((b, ef), bool)
        live, (row, node) = np.arange(b), np.nonzero(entry >= 0)
        node = entry[row, node]
        while len(live):
            place = row.astype(np.int64) * n + node
            place = np.unique(place[~seen[place]])
            seen[place] = True
            row, node = place // n, place % n
            got = np.einsum("ij,ij->i", self.x[node], q[row])
            good = got > sims[row, -1]
            row, node, got = row[good], node[good], got[good]
            if len(row):
                rows, first, count = np.unique(row, return_index=True, return_counts=True)
                at, col = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(first, count)
                more, named = np.full((len(rows), count.max()), -np.inf, np.float32), np.full((len(rows), count.max()), -1, np.int32)
                more[at, col], named[at, col] = got, node
                all_s, all_i = np.concatenate([sims[rows], more], 1), np.concatenate([ids[rows], named], 1)
                all_o = np.concatenate([open_[rows], named >= 0], 1)
                order = np.argsort(-all_s, 1, kind="stable")[:, :ef]
                sims[rows], ids[rows], open_[rows] = (np.take_along_axis(a, order, 1) for a in (all_s, all_i, all_o))
            mine = open_[live]
            live, mine = live[mine.any(1)], mine[mine.any(1)]
            if not len(live):
                break
            pick = mine & (np.cumsum(mine, 1) <= EXPAND)
            at, col = np.nonzero(pick)
            row = live[at]
            open_[row, col] = False
            near = lists[ids[row, col]]
            row, node = np.repeat(row, near.shape[1]), near.ravel()
            row, node = row[node >= 0], node[node >= 0]
        return ids, sims


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) those nearer to the row than to any chosen before, ``most`` at most."""
    r, k = cand.shape
    out = np.full((r, most), -1, np.int32)
    for lo in range(0, r, 256):
        c, s = cand[lo : lo + 256], sims[lo : lo + 256]
        v = x[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        for j in range(k):
            fits = (c[:, j] >= 0) & (count < most) & ~(chosen & (between[:, j] >= s[:, j, None])).any(1)
            chosen[:, j] = fits
            at = np.flatnonzero(fits)
            out[lo + at, count[at]] = c[at, j]
            count[at] += 1
    return out


class Graph:
    """Nodes in order of falling level: those of a layer are a prefix of all."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers, self.beam = x, layers, Beam(x)

    def search(self, q: np.ndarray, ef: int, lowest: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the top layer down to ``lowest``; nodes by place."""
        top = self.layers[-1]
        entry, sims = np.tile(np.arange(min(len(top), UPPER_BEAM), dtype=np.int32), (len(q), 1)), None
        for layer in range(len(self.layers) - 1, lowest - 1, -1):
            entry, sims = self.beam.search(self.layers[layer], q, entry, ef if layer == lowest else UPPER_BEAM)
        return entry, sims


def levels(n: int) -> np.ndarray:
    return np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(np.int64)


def build(x: np.ndarray, level: np.ndarray) -> Graph:
    """Graph over unit vectors ``x`` (float32) whose ``level`` falls."""
    graph = Graph(x, [])
    for layer in range(int(level.max(initial=0)), -1, -1):
        n, width = int((level >= layer).sum()), LINKS * (1 + (layer == 0))
        lists = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            b = min(n - done, BATCH, max(done, 64))
            q, new = x[done : done + b], np.arange(done, done + b, dtype=np.int32)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            mates = np.argsort(-own, 1, kind="stable")[:, : min(LINKS, b - 1)]
            cand, sims = new[mates], np.take_along_axis(own, mates, 1)
            if done:
                entry = np.tile(np.arange(min(done, UPPER_BEAM), dtype=np.int32), (b, 1))
                if graph.layers:
                    found = graph.search(q, UPPER_BEAM)[0]
                    entry = np.concatenate([np.where(found < done, found, -1), entry[:, :1]], 1)
                old, old_sims = graph.beam.search(lists[:done], q, entry, BUILD_BEAM)
                cand, sims = np.concatenate([cand, old], 1), np.concatenate([sims, old_sims], 1)
                order = np.argsort(-sims, 1, kind="stable")
                cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            lists[new, :LINKS] = diverse(x, cand, sims, LINKS)
            _link_back(x, lists, new)
            done += b
        graph.layers.insert(0, lists)
    return graph


def _link_back(x: np.ndarray, lists: np.ndarray, new: np.ndarray) -> None:
    """Put the new nodes on the lists of those that they have chosen; a full list keeps its diverse nearest."""
    width = lists.shape[1]
    own = lists[new, :LINKS]
    row, col = np.nonzero(own >= 0)
    to, node = own[row, col], new[row]
    known = (lists[to] == node[:, None]).any(1)
    to, node = to[~known], node[~known]
    if not len(to):
        return
    near = np.einsum("ij,ij->i", x[to], x[node])
    order = np.lexsort((-near, to))
    to, node = to[order], node[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    col = np.arange(len(to)) - np.repeat(first, count)
    fits = col < width
    more = np.full((len(target), min(width, int(count.max()))), -1, np.int32)
    more[np.repeat(np.arange(len(target)), count)[fits], col[fits]] = node[fits]
    cand = np.concatenate([lists[target], more], 1)
    sims = np.where(cand >= 0, np.einsum("rkd,rd->rk", x[np.maximum(cand, 0)], x[target]), -np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    full = (cand >= 0).sum(1) > width
    lists[target[~full]] = cand[~full, :width]
    if full.any():
        lists[target[full]] = diverse(x, cand[full], sims[full], width)


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square overflows."""
    x = flat.astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def probes(x: np.ndarray, least: float) -> np.ndarray:
    """A vector for each of ``x`` at a cosine just above ``least`` to it, in a direction of its own."""
    noise = np.random.default_rng(11).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.sqrt((noise * noise).sum(1, keepdims=True))
    c = least + (1 - least) / 20
    return c * x + np.sqrt(1 - c * c) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-9)


def settled(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest place that links (u, v) reach from each of ``n`` places, beyond what an earlier ``label`` says."""
    label = np.arange(n) if label is None else label
    both = np.unique(np.minimum(label[u], label[v]) * n + np.maximum(label[u], label[v]))
    u, v = both // max(n, 1), both % max(n, 1)
    u, v = u[u != v], v[u != v]
    if not len(u):
        return label
    root = np.arange(n)
    while True:
        before, least = root.copy(), np.minimum(root[u], root[v])
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        root = root[root]
        if (root == before).all():
            return root[label]


class Shard:
    """A shard's index: nodes, weights, graph, beam width and local groups."""

    def __init__(self, ids, weight, x, layers, ef: int, group=None):
        self.ids, self.weight, self.x, self.ef, self.group = ids, weight, x, int(ef), group
        self.graph = Graph(x.astype(np.float32), layers)
        if group is not None:
            self.members = np.argsort(group, kind="stable")
            self.first = np.searchsorted(group[self.members], np.arange(len(ids) + 1))

    def found(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place) of verified links, and the queries to compare with the whole shard: their beam is full of links."""
        if self.ef >= len(self.ids):  # the audit has given up on the graph, or the shard is small
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(q))
        ids, sims = self.graph.search(q.astype(np.float32), self.ef)
        close = sims >= least - SLACK
        full = np.flatnonzero(close[:, -1])
        close[full] = False
        row, col = np.nonzero(close)
        place = ids[row, col]
        true = np.einsum("ij,ij->i", q[row], self.x[place]) >= least
        return row[true], place[true], full

    def audit(self, least: float) -> None:
        """Widen the beam until probes and own vectors find what a comparison with the whole shard finds."""
        n = len(self.ids)
        some = self.x[np.unique(np.linspace(0, n - 1, min(n, AUDITS)).astype(np.int64))]
        for q in (probes(some, least), some):
            true = (q @ self.x.T >= least).sum(1)
            while self.ef < n:
                row, _, full = self.found(q, least)
                got = np.bincount(row, minlength=len(q))
                got[full] = true[full]
                if got.sum() >= AUDIT_RECALL * true.sum():
                    break
                self.ef *= 2

    def local_groups(self, least: float) -> np.ndarray:
        label = np.arange(len(self.ids))
        for lo in range(0, len(self.ids), BATCH):
            q = self.x[lo : lo + BATCH]
            row, place, full = self.found(q, least)
            label = settled(len(label), row + lo, place, label)
            for k in full:  # one row of the shard at a time
                near = np.flatnonzero(self.x @ q[k] >= least)
                label = settled(len(label), np.full(len(near), lo + k), near, label)
        return label

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, weight=self.weight, x=self.x, ef=self.ef, group=self.group, **{f"layer{i}": a for i, a in enumerate(self.graph.layers)})
        return out.getvalue()

    @classmethod
    def opened(cls, blob: bytes) -> Shard:
        z = np.load(io.BytesIO(blob))
        return cls(z["ids"], z["weight"], z["x"], [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z.files))], z["ef"], z["group"])

    def counts(self, q: np.ndarray, own: np.ndarray, wanted: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place that names the local group, linked rows) of each query and group with links.

        ``own``: the query's place in this shard, or -1; a node is no link of itself. ``wanted``: ids that name groups, to compare with these only.
        """
        if wanted is None:
            row, place, full = self.found(q, least)
            group = [self.group[place]]
            row = [row]
            for lo in range(0, len(full), 64):
                at, place = np.nonzero(q[full[lo : lo + 64]] @ self.x.T >= least)
                both = np.unique(full[lo : lo + 64][at] * len(self.ids) + self.group[place])
                row.append(both // len(self.ids))
                group.append(both % len(self.ids))
            pair = np.unique(np.concatenate(group) * len(q) + np.concatenate(row))
        else:
            named = np.argsort(self.ids, kind="stable")
            pair = np.unique(self.group[named[np.searchsorted(self.ids, wanted, sorter=named)]] * len(q) + np.arange(len(q)))
        group, row = pair // len(q), pair % len(q)
        count, edge = np.zeros(len(pair), np.int64), np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        size = self.first[group + 1] - self.first[group]
        single = size == 1
        place = group[single]
        near = (np.einsum("ij,ij->i", q[row[single]], self.x[place]) >= least) & (own[row[single]] != place)
        count[single] = near * self.weight[place]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if single[lo]:
                continue
            members = self.members[self.first[group[lo]] : self.first[group[lo] + 1]]
            for a in range(lo, hi, 64):
                some = row[a : min(hi, a + 64)]
                near = (q[some] @ self.x[members].T >= least) & (own[some][:, None] != members)
                count[a : a + len(some)] = near @ self.weight[members]
        any_ = count > 0
        return row[any_], group[any_], count[any_]


def _index(nodes: DataFrame, least: float) -> DataFrame:
    """``width, shard, part, blob``: the shards' indexes in chunks."""

    def run(key, t):
        width = key[0].as_py()
        x = unit(t.column("v").combine_chunks().flatten().to_numpy(), width)
        ids, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        level = levels(len(ids))
        by_id = np.argsort(ids)
        order = by_id[np.argsort(-level, kind="stable")]
        x, ids, weight = x[order], ids[order], weight[order]
        shard = Shard(ids, weight, x, build(x.astype(np.float32), np.sort(level)[::-1]).layers, FIRST_BEAM)
        shard.audit(least)
        label = shard.local_groups(least)
        # a group is named by its member with the smallest id
        first = np.lexsort((ids, label))
        shard.group = first[np.searchsorted(label[first], label)]
        blob = shard.packed()
        parts = [blob[a : a + CHUNK_BYTES] for a in range(0, len(blob), CHUNK_BYTES)]
        n = len(parts)
        return pa.table([pa.array([width] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], ["width", "shard", "part", "blob"])

    return nodes.groupBy(*KEY).applyInArrow(run, "width int, shard int, part int, blob binary")


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` columns, ``blob``: queries (``id, from_shard, v, rep``) packed for the nodes of one ``by``."""

    def pack(held: list[pa.RecordBatch], key: tuple) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        out = io.BytesIO()
        v = t.column("v").combine_chunks().flatten().to_numpy()
        np.savez(out, v=v, **{c: t.column(c).to_numpy() for c in ("id", "from_shard", "rep")})
        return pa.record_batch([*[pa.array([k], pa.int32()) for k in key], pa.array([out.getvalue()], pa.binary())], [*by, "blob"])

    def run(batches):
        held, key, n = [], None, 0
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in by]))
            edge = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                for at in range(lo, hi, BATCH):
                    piece = b.slice(at, min(BATCH, hi - at))
                    if held and (keys[at] != key or n + piece.num_rows > BATCH):
                        yield pack(held, key)
                        held, n = [], 0
                    held.append(piece)
                    key, n = keys[at], n + piece.num_rows
        if held:
            yield pack(held, key)

    return C.small_batches(rows).mapInArrow(run, ", ".join(f"{c} int" for c in by) + ", blob binary")


def _asked(index: DataFrame, blocks: DataFrame, slices: int, least: float) -> DataFrame:
    """Counts (``ROW``) of query blocks (``width, shard, slice, blob``) against the shards' indexes."""

    def run(batches):
        held, shard, key = [], None, None
        for b in batches:
            for r in b.to_pylist():
                own_key = (r["width"], r["shard"], r["slice"])
                if own_key != key:
                    held, shard, key = [], None, own_key
                if r["kind"] == 0:
                    held.append(r["blob"])
                    continue
                if shard is None and not held:  # no vector of this length is in the shard
                    continue
                if shard is None:
                    shard, held = Shard.opened(b"".join(held)), []
                z = np.load(io.BytesIO(r["blob"]))
                q, ids, origin = unit(z["v"], r["width"]), z["id"], z["from_shard"]
                named = np.argsort(shard.ids, kind="stable")
                at = named[np.minimum(np.searchsorted(shard.ids, ids, sorter=named), len(named) - 1)]
                own = np.where((origin == r["shard"]) & (shard.ids[at] == ids), at, -1)
                row, group, links = shard.counts(q, own, None if z["rep"][0] == NO_REP else z["rep"], least)
                n = len(row)
                yield pa.record_batch([pa.array([r["width"]] * n, pa.int32()), pa.array(origin[row], pa.int32()), pa.array(ids[row]), pa.array([r["shard"]] * n, pa.int32()), pa.array(shard.ids[group]), pa.array(links)],
                                      [c.split()[0] for c in ROW.split(", ")])

    chunks = index.select("width", "shard", F.explode(F.array(*[F.lit(s) for s in range(slices)])).alias("slice"), F.lit(0).alias("kind"), "part", "blob")
    both = chunks.unionByName(blocks.select("width", "shard", "slice", F.lit(1).alias("kind"), F.lit(0).alias("part"), "blob"))
    conf = both.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), slices * LEAST_SHARDS)
    return both.repartition(parts, "width", "shard", "slice").sortWithinPartitions("width", "shard", "slice", "kind", "part").mapInArrow(run, ROW)


NO_REP = -(1 << 63)


def links(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """``v, weight, links, component`` of each distinct usable vector ``v`` among the rows with an id.

    ``weight``: its rows; ``links``: rows of other vectors at a cosine of ``least`` or more; ``component``: the smallest id that links reach.
    """
    v = F.col(vector).cast("array<double>")
    usable = vectors.where(F.col(vec_id).isNotNull() & whole(v) & F.exists(v, lambda x: x != 0))
    nodes = usable.groupBy(v.alias("v")).agg(F.min(F.col(vec_id).cast("long")).alias("id"), F.count(F.lit(1)).alias("weight"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = nodes.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    slices = max(LEAST_SLICES, min(MOST_SLICES, shards))
    nodes = nodes.select("*", F.size("v").alias("width"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    # by range, so that each shard has a task of its own
    index = stage(_index(nodes.select("node", "weight", "v", *KEY).repartitionByRange(shards, *KEY), least), "shard-indexes")

    conf, name = vectors.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    queries = nodes.select("width", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(slices)).cast("int").alias("slice"), F.col("node").alias("id"), F.col("shard").alias("from_shard"), "v", F.lit(NO_REP).alias("rep"))
    packed = stage(_blocks(queries.sortWithinPartitions("width", "slice"), ["width", "slice"]), "query-blocks")
    before = conf.get(name)
    try:
        conf.set(name, "16")  # rows here are blocks and chunks of up to a megabyte
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        told = stage(_asked(index, packed.select("width", "slice", each, "blob"), slices, least), "shard-counts")
    finally:
        conf.set(name, before)

    # local groups that any query has joined, from both sides; what their members were not compared with
    own = told.where("from_shard = shard").select("width", "q", F.col("shard").alias("s"), F.col("rep").alias("g"))
    away = told.where("from_shard <> shard").select("width", "q", F.col("from_shard").alias("s"), F.col("shard").alias("t"), F.col("rep").alias("h"))
    known = away.join(own, ["width", "q", "s"], "left").withColumn("g", F.coalesce("g", "q"))
    ends = known.select("width", "s", "g", "t", "h").union(known.select("width", F.col("t").alias("s"), F.col("h").alias("g"), F.col("s").alias("t"), F.col("g").alias("h"))).distinct()
    ends = stage(ends, "joined-groups")
    member = own.union(ends.select("width", F.col("g").alias("q"), "s", "g").distinct()).distinct()
    open_ = ends.join(member, ["width", "s", "g"]).select("width", "q", "s", "t", "h").distinct().join(away, ["width", "q", "s", "t", "h"], "left_anti")
    again = open_.join(nodes.select("width", F.col("node").alias("q"), F.col("shard").alias("s"), "v"), ["width", "q", "s"])
    again = again.select("width", F.col("t").alias("shard"), F.col("q").alias("id"), F.col("s").alias("from_shard"), "v", F.col("h").alias("rep"))
    packed = stage(_blocks(again.repartition(*KEY).sortWithinPartitions(*KEY), KEY), "open-blocks")
    try:
        conf.set(name, "16")
        more = stage(_asked(index, packed.withColumn("slice", F.lit(0)), 1, least), "more-counts")
    finally:
        conf.set(name, before)

    told = told.union(more)
    joined = components(told.select(F.col("q").alias("u"), F.col("rep").alias("v")).distinct()).select(F.col("v").alias("node"), "component")
    total = told.groupBy(F.col("q").alias("node")).agg(F.sum("links").alias("links"))
    placed = nodes.join(total, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stage(placed.select("v", "id", "weight", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "component"), "placed-vectors")
    smallest = placed.groupBy("component").agg(F.min("id").alias("least"))
    return placed.join(smallest, "component").select("v", "weight", "links", F.col("least").alias("component"))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Rows with ``n_links`` (other rows within the bound), ``component_id`` (smallest id that links reach) and ``kept``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of different lengths. A row
    without an id links with nothing, has no component and is kept. Equal vectors are linked; rows that repeat an id with another
    vector are judged each by its own. Extra columns pass through, names that the result adds are refused.
    """
    C.require_free(vectors, "n_links", "component_id", "kept", "__v", "__links", "__component", "__weight")
    found = stage(links(vectors, vec_id, vector, least), "linked-vectors")
    found = found.select(F.col("v").alias("__v"), F.col("weight").alias("__weight"), F.col("links").alias("__links"), F.col("component").alias("__component"))
    key = F.when(F.col(vec_id).isNotNull(), F.col(vector).cast("array<double>"))
    joined = vectors.withColumn("__v", key).join(found, "__v", "left")
    n_links = F.coalesce(F.col("__links") + F.col("__weight") - 1, F.lit(0).cast("long"))
    component = F.coalesce(F.col("__component"), F.col(vec_id).cast("long"))
    return joined.select(*vectors.columns, n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col(vec_id) == component, F.lit(True)).alias("kept"))
