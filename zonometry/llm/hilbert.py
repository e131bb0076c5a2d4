"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to a few bits by equal depth, the levels of a row form a cell, and the cells
are ordered along the Hilbert curve, so rows that are near in all dimensions come to lie in the same
shard, and a shard's minima and maxima prune files for a predicate on any of them. The order is cut
into runs of equal row counts. Only DataFrame expressions: ranks come from counts per cell and per
slice of a cell, never from a sort of all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonometry.llm import common as C
from zonometry.session import stage

BITS = 4  # per dimension: four dimensions have at most 65,536 cells
BINS = 1024  # equal-width bins from which the equal-depth levels are made
SLICE_ROWS = 250_000  # rows that a cell's slice is meant to hold


def number_code(value: Column) -> Column:
    return value.cast("double")


def text_code(value: Column) -> Column:
    """Order-preserving number of a string's first seven bytes."""
    return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with ``bits`` bits per axis (Skilling's transform, then bit interleaving).

    The steps fold over arrays, so the expression stays as small as one step.
    """
    n, step = len(levels), lambda q, i: F.struct(F.lit(q).alias("q"), F.lit(i).alias("i"))

    def turn(x: Column, s: Column) -> Column:
        p, first, own = s.q - 1, F.element_at(x, 1), F.element_at(x, s.i + 1)
        high, swap = own.bitwiseAND(s.q) != 0, first.bitwiseXOR(own).bitwiseAND(p)
        new_first = F.when(high, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(high, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == s.i, new_own).otherwise(v))

    axes = F.array(*[v.cast("int") for v in levels])
    down = [1 << b for b in range(bits - 1, 0, -1)]
    axes = F.aggregate(F.array(*[step(q, i) for q in down for i in range(n)]), axes, turn) if down else axes
    gray = F.aggregate(F.sequence(F.lit(2), F.lit(n)), axes, lambda x, i: F.transform(x, lambda v, k: F.when(k == i - 1, v.bitwiseXOR(F.element_at(x, i - 1))).otherwise(v))) if n > 1 else axes
    fix = lambda x: F.aggregate(F.array(*[F.lit(q) for q in down]), F.lit(0), lambda t, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    final = F.transform(F.array(gray), lambda x: F.transform(x, lambda v: v.bitwiseXOR(fix(x))))[0] if down else gray
    places = F.array(*[step(1 << b, i) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda x, s: F.when(F.element_at(x, s.i + 1).bitwiseAND(s.q) != 0, 1).otherwise(0)
    return F.transform(F.array(final), lambda x: F.aggregate(places, F.lit(0).cast("long"), lambda acc, s: acc * 2 + bit(x, s)))[0]


def curve_shards(rows: DataFrame, dims: dict[str, Column], n_shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve`` (Hilbert index), ``shard`` and ``slot``; shard sizes differ by at most one row.

    ``dims`` name order-preserving numeric codes (``number_code``, ``text_code``); null sorts before all
    values. ``rows`` should be slim and stable (a stage table), since the passes read it again. Within a
    cell the order is by hash slice, then by ``tie``; rows equal in ``tie`` may change places. An empty table
    gives no rows. Extra columns pass through; names that the result adds are refused.
    """
    C.require_free(rows, "curve", "shard", "slot", "__cell", "__slice", "__off")
    codes = list(dims)
    range_of = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(f"{a}{i}") for i, c in enumerate(dims.values()) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    total = range_of["n"]

    def bin_of(i: int) -> Column:
        lo, hi = range_of[f"lo{i}"], range_of[f"hi{i}"]
        if lo is None:
            return F.lit(-1)
        width = max((hi - lo) / BINS, 1e-300)
        return F.coalesce(F.least(F.lit(BINS - 1), F.floor((dims[codes[i]] - F.lit(lo)) / F.lit(width)).cast("int")), F.lit(-1))

    binned = rows.select("*", *[bin_of(i).alias(f"__b{i}") for i in range(len(codes))])
    bins = binned.select(F.posexplode(F.array(*[F.col(f"__b{i}") for i in range(len(codes))])).alias("d", "b")).groupBy("d", "b").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("d").orderBy("b")) - F.col("c")
    level = stage(bins.select("d", "b", (before * (1 << bits) / max(total, 1)).cast("int").alias("level")), "levels")
    placed = binned
    for i in range(len(codes)):  # at most BINS + 1 rows a dimension
        placed = placed.join(F.broadcast(level.where(F.col("d") == i).select(F.col("b").alias(f"__b{i}"), F.col("level").alias(f"__l{i}"))), f"__b{i}")
    cell = F.lit(0)
    for i in range(len(codes)):
        cell = cell * (1 << bits) + F.col(f"__l{i}")
    slices = 1 + total // SLICE_ROWS
    placed = placed.select(*rows.columns, cell.alias("__cell"), F.pmod(F.xxhash64(*tie), F.lit(slices)).alias("__slice"))
    placed = stage(placed, "cells")

    parts = placed.groupBy("__cell", "__slice").agg(F.count(F.lit(1)).alias("c"))
    mask = (1 << bits) - 1
    axes = [F.shiftright(F.col("__cell"), bits * (len(codes) - 1 - i)).bitwiseAND(F.lit(mask)) for i in range(len(codes))]
    cells = parts.groupBy("__cell").agg(F.sum("c").alias("c")).withColumn("curve", hilbert_index(axes, bits))  # at most 2^(bits * dims) rows
    cells = cells.select("__cell", "curve", (F.sum("c").over(Window.orderBy("curve")) - F.col("c")).alias("off"))
    inside = F.sum("c").over(Window.partitionBy("__cell").orderBy("__slice")) - F.col("c")
    offsets = stage(parts.withColumn("in", inside).join(cells, "__cell").select("__cell", "__slice", "curve", (F.col("off") + F.col("in")).alias("__off")), "offsets")
    number = F.row_number().over(Window.partitionBy("__cell", "__slice").orderBy(*tie)) - 1
    ranked = placed.withColumn("__r", number).join(offsets, ["__cell", "__slice"]).withColumn("__r", F.col("__off") + F.col("__r"))
    shard = F.expr(f"cast((__r * {n_shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__r") - first).select(*rows.columns, "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet per shard, rows in slot order, for readers that prune by file statistics."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Manifest: rows, and least and greatest value of the columns, for every shard."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}_{a}") for c in columns for a, f in (("min", F.min), ("max", F.max))])
