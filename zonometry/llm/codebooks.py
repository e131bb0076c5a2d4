"""Vector codes by dual-tree Lloyd rounds.

Vectors become integers and are cut into parts; each part position has a codebook of a few entries. The
rows are packed once into blocks, and every block keeps a tree of boxes over its parts for each position, with
the count and the sum of each box, as a stage table. A round reads the blocks: the tree over a block's parts and the
tree over the entries descend together, a pair of boxes is dropped when the least distance between them is over
the greatest distance to another pair of the same part box, and a part box with one entry left is assigned
whole, by its cached sum. Only leaves with several entries left compare integers. Blocks send one row of sums for each
part, entry and component, whatever their size, and only the codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.llm import common as C
from zonometry.session import stage

SCALE = 4096
LARGEST = 4096.0  # of a component's absolute value: the squares of all boxes stay below 2^63
BLOCK_ROWS = 4096
LEAF_ROWS = 16
TREE = "rows binary, n int, points binary, place binary, low binary, high binary, sums binary"


class Tree(NamedTuple):
    """Node j of depth t holds the points ``(j * n) >> t`` up to ``((j + 1) * n) >> t`` in tree order; its number is 2^t - 1 + j."""

    n: int
    depth: int
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def edges(self, t: int) -> np.ndarray:
        return (np.arange((1 << t) + 1) * self.n) >> t


def depth_of(n: int, leaf: int) -> int:
    return max(0, -(-n // leaf) - 1).bit_length()


def grow(points: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """Order of the points and the tree over them: each node is halved along its longest side."""
    n, depth = len(points), depth_of(len(points), leaf)
    order, tree = np.arange(n), Tree(n, depth, *np.zeros((3, (2 << depth) - 1, points.shape[1]), np.int64))
    for t in range(depth + 1):
        edge = tree.edges(t)
        full = np.flatnonzero(np.diff(edge))
        at, own = edge[full], points[order]
        node = (1 << t) - 1 + full
        tree.low[node], tree.high[node], tree.sums[node] = (f.reduceat(own, at) for f in (np.minimum, np.maximum, np.add))
        if t < depth:
            side = (tree.high[node] - tree.low[node]).argmax(1)
            which = np.repeat(np.arange(len(full)), np.diff(edge)[full])
            order = order[np.lexsort((own[np.arange(n), side[which]], which))]
    return order, tree


def assign(points: np.ndarray, tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each point in tree order, counts, sums of the entries): ties go to the lower entry."""
    k = len(entries)
    label, counts, sums = np.zeros(len(points), np.int64), np.zeros(k, np.int64), np.zeros_like(entries)
    named, top = grow(entries, 1)
    d, e, u = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    for t in range(tree.depth + 1):
        more = True
        while more:  # the entries' tree goes down two steps for one of the parts', and to its end at the leaves
            more = u < top.depth and t == tree.depth
            for _ in range(2):
                if u < top.depth:
                    d, e, u = np.repeat(d, 2), np.stack([2 * e, 2 * e + 1], 1).ravel(), u + 1
            size = np.diff(top.edges(u))
            d, e = d[size[e] > 0], e[size[e] > 0]
            a, b = (1 << t) - 1 + d, (1 << u) - 1 + e
            gap = np.maximum(0, np.maximum(tree.low[a] - top.high[b], top.low[b] - tree.high[a]))
            far = np.maximum(tree.high[a] - top.low[b], top.high[b] - tree.low[a])
            first = np.flatnonzero(np.diff(d, prepend=-1))
            bound = np.repeat(np.minimum.reduceat((far * far).sum(1), first), np.diff(first, append=len(d)))
            near = (gap * gap).sum(1) <= bound
            d, e = d[near], e[near]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        alone = first[np.diff(first, append=len(d)) == 1] if u == top.depth else first[:0]
        if len(alone):  # whole boxes
            edge, own = tree.edges(t), named[top.edges(u)[e[alone]]]
            np.add.at(counts, own, np.diff(edge)[d[alone]])
            np.add.at(sums, own, tree.sums[(1 << t) - 1 + d[alone]])
            mark = np.zeros(len(points) + 1, np.int64)
            np.add.at(mark, edge[d[alone]], own + 1)
            np.add.at(mark, edge[d[alone] + 1], -own - 1)
            label += np.cumsum(mark[:-1])
            rest = np.ones(len(d), bool)
            rest[alone] = False
            d, e = d[rest], e[rest]
        if not len(d):
            return label - 1, counts, sums
        if t < tree.depth:  # both halves of a box keep its entries
            first = np.flatnonzero(np.diff(d, prepend=-1))
            size = np.repeat(np.diff(first, append=len(d)), np.diff(first, append=len(d)))
            at = np.repeat(first, np.diff(first, append=len(d)))
            place = 2 * at + np.arange(len(d)) - at
            nd, ne = np.empty(2 * len(d), np.int64), np.empty(2 * len(d), np.int64)
            nd[place], nd[place + size], ne[place], ne[place + size] = 2 * d, 2 * d + 1, e, e
            d, e = nd, ne
            full = np.diff(tree.edges(t + 1))[d] > 0
            d, e = d[full], e[full]
    edge = tree.edges(tree.depth)
    entry, size = named[top.edges(u)[e]], np.diff(edge)[d]
    point = np.repeat(edge[d], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    entry = np.repeat(entry, size)
    apart = ((points[point] - entries[entry]) ** 2).sum(1)
    order = np.lexsort((entry, apart, point))
    best = order[np.diff(point[order], prepend=-1) != 0]
    label[point[best]] = entry[best] + 1
    np.add.at(counts, entry[best], 1)
    np.add.at(sums, entry[best], points[point[best]])
    return label - 1, counts, sums


def whole(vector: Column) -> Column:
    """True for a vector without null and non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _packed(rows: DataFrame, keep: list[str], vector: str, parts: int, width: int) -> DataFrame:
    """Blocks of rows with the trees over their parts."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(len(table), parts, width)
        grown = [grow(x[:, p], LEAF_ROWS) for p in range(parts)]
        sink = pa.BufferOutputStream()
        kept = table.select(keep)
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        blobs = [np.stack([x[o, p] for p, (o, _) in enumerate(grown)]).astype("<i4"), np.stack([o for o, _ in grown]).astype("<i4"),
                 *[np.stack([getattr(t, f) for _, t in grown]).astype(kind) for f, kind in (("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]]
        row = [sink.getvalue().to_pybytes(), len(table), *[b.tobytes() for b in blobs]]
        return pa.record_batch([pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.int32()), *[pa.array([b], pa.binary()) for b in row[2:]]], [f.split()[0] for f in TREE.split(", ")])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                piece = b.slice(at, BLOCK_ROWS)
                if held and n + piece.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield block(held)

    return C.small_batches(rows).select(*keep, *([] if vector in keep else [vector])).mapInArrow(run, TREE)


def _opened(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, list[Tree]]]:
    """(kept rows, points and places in tree order, trees) of each block."""
    for r in batch.to_pylist():
        n, depth = r["n"], depth_of(r["n"], LEAF_ROWS)
        box = [np.frombuffer(r[f], kind).astype(np.int64).reshape(parts, -1, width) for f, kind in (("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]
        points = np.frombuffer(r["points"], "<i4").astype(np.int64).reshape(parts, n, width)
        yield r["rows"], points, np.frombuffer(r["place"], "<i4").reshape(parts, n), [Tree(n, depth, *[b[p] for b in box]) for p in range(parts)]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that no part chose stays."""
    parts, k, width = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for b in batches:
            for _, points, _, trees in _opened(b, parts, width):
                for p, tree in enumerate(trees):
                    _, c, s = assign(points[p], tree, books[p])
                    counts[p] += c
                    sums[p] += s
        both = np.concatenate([counts[:, :, None], sums], 2)
        at = np.flatnonzero(np.broadcast_to(counts[:, :, None] > 0, both.shape))
        yield pa.record_batch([pa.array(at), pa.array(both.ravel()[at])], ["at", "total"])

    # parts x entries x (1 + width) rows at most
    told = blocks.mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out, total = books.copy(), {r["at"]: int(r["total"]) for r in told}
    for at in (a for a in total if a % (width + 1) == 0):
        out.reshape(-1, width)[at // (width + 1)] = [total[at + 1 + j] // total[at] for j in range(width)]
    return out


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(blocks with trees, codebooks: parts x entries x components) of the rows whose vectors can be coded.

    Not coded, and in no block: vectors that are null, empty or hold null or non-finite components, and those whose length is no
    multiple of ``parts`` or not that of the coded vector with the smallest id. Codebooks start with the parts of the smallest ids (null
    ids last; equal ids by their vectors), and are as short as the rows are few. A component beyond ``LARGEST`` raises an error.
    """
    keep = list(rows.columns) if keep is None else list(keep)
    good = rows.where(whole(F.col(vector)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    order = [F.col(vec_id).asc_nulls_last(), F.col(vector)]
    first = good.orderBy(*order).select(F.size(vector)).first()
    length = first[0] if first else parts
    good = good.where(F.size(vector) == length)
    seeds = good.orderBy(*order).limit(entries).select(vector).collect()
    blocks = stage(_packed(good.withColumn(vector, _checked(F.col(vector))), keep, vector, parts, length // parts), "code-blocks")
    start = np.array([r[0] for r in seeds], np.float64).reshape(len(seeds), length)
    books = np.floor(start * SCALE).astype(np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        books = _round(blocks, books)
    return blocks, books


def _checked(vector: Column) -> Column:
    large = F.raise_error(F.lit(f"a vector component is beyond {LARGEST}"))
    return F.when(F.exists(vector, lambda x: F.abs(x) > LARGEST), F.when(large.isNull(), vector)).otherwise(vector)


def codes(blocks: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    """The kept rows (columns ``schema``) with ``code``, one byte for each part, and ``error``, the squared distance to the coded vector."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            for rows, points, place, trees in _opened(b, parts, width):
                kept = pa.ipc.open_stream(rows).read_all().combine_chunks()
                code, error = np.zeros((len(kept), parts), np.uint8), np.zeros(len(kept), np.int64)
                for p, tree in enumerate(trees):
                    label = assign(points[p], tree, books[p])[0]
                    code[place[p], p] = label
                    error[place[p]] += ((points[p] - books[p][label]) ** 2).sum(1)
                flat = pa.array([r.tobytes() for r in code], pa.binary())
                yield pa.record_batch([*[c.combine_chunks() for c in kept.columns], flat, pa.array(error)], [*kept.column_names, "code", "error"])

    return blocks.mapInArrow(run, f"{schema}, code binary, error long")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(``keep`` columns, all by default, with ``code`` and ``error``; codebooks). Entries: 256 at most.

    Extra columns pass through, repeated rows stay, names that the result adds are refused; see ``fit`` for the rows that are left out.
    """
    keep = list(rows.columns) if keep is None else list(keep)
    C.require_free(rows.select(*keep), "code", "error")
    if not 0 < entries <= 256:
        raise ValueError("a code byte names one of 256 entries at most")
    blocks, books = fit(rows, vec_id, vector, parts, entries, rounds, keep)
    return codes(blocks, books, C.schema_of(rows.select(*keep))), books


def digest(books: np.ndarray) -> str:
    """Hash of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
