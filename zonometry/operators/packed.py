"""Sorted numbers as short byte strings, and lookups of packed numbers in distributions that lie in slices.

What blocks of rows draw many times over stays arrays: a block sends each slice of a distribution its distinct values once, and
gets their places back, so that rows x draws are never rows.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonometry.operators.rank import value_positions
from zonometry.session import stage

SLICE_VALUES = 50_000  # distinct values of a slice
ASKED_VALUES = 3_000_000  # values that one task looks up in a slice, on average
UNIT = 1e9  # values of nine digits are packed as whole numbers
HEAD = "<BqI"


def rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, halves away from zero, as SQL rounds; numbers too large to have nine digits stay."""
    return np.where(np.abs(x) < 4e6, np.sign(x) * np.floor(np.abs(x) * UNIT + 0.5) / UNIT, x)


def pack(x: np.ndarray) -> bytes:
    """Ascending whole numbers: the first, then the steps, low bytes first and only as many as the widest one needs."""
    steps = np.diff(x.astype("<i8")).astype("<u8")
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = steps.view("u1").reshape(-1, 8).T[:width]
    return struct.pack(HEAD, width, int(x[0]) if len(x) else 0, len(x)) + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, first, n = struct.unpack_from(HEAD, data)
    steps = np.zeros((n, 8), "u1")
    if n > 1 and width:
        steps[1:, :width] = np.frombuffer(data, "u1", offset=struct.calcsize(HEAD)).reshape(width, -1).T
    return np.cumsum(steps.view("<i8")[:, 0]) + first


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers in the same order, and back."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def pack_values(v: np.ndarray) -> bytes:
    """Ascending doubles, none lost: as multiples of ``UNIT`` where they are ones, else by their bits."""
    if np.abs(v).max(initial=0.0) < 4e6:
        whole = np.rint(v * UNIT)
        if (whole / UNIT == v).all():
            return b"\1" + pack(whole)
    return b"\0" + pack(_ordered(np.ascontiguousarray(v, "<f8").view("<i8")))


def unpack_values(data: bytes) -> np.ndarray:
    x = unpack(data[1:])
    return x / UNIT if data[:1] == b"\1" else _ordered(x).view("<f8")


Groups = dict[str, tuple[float, float, np.ndarray]]  # size, last value, first value of every slice


class Distribution(NamedTuple):
    """Values of some groups: ``rows`` (group, slice, salt, v, upto) and what every task knows of a group."""

    rows: DataFrame
    groups: Groups
    salts: int


def distribution(fixed: DataFrame, group: str, value: str, asked: int, domain: tuple[float, float] | None = None) -> Distribution:
    """Each group's known values cut into slices, for ``asked`` lookups a group; a slice that many ask is dealt to several tasks."""
    known = value_positions(fixed.select(F.col(group).alias("group"), F.col(value).cast("double").alias("v")), "v", ["group"], domain)
    known = stage(known.select("group", "v", (F.col("before") + F.col("c")).alias("upto"), "n"), "fixed-values")
    sizes = known.groupBy("group").agg(F.count(F.lit(1)).alias("values"), F.max("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = {r["group"]: r for r in sizes.collect()}  # a row a group
    slices = max([1, *(-(-r["values"] // SLICE_VALUES) for r in sizes.values())])
    cuts = {}
    if slices > 1:
        at = F.percentile_approx("v", [i / slices for i in range(1, slices)], 20 * slices)
        cuts = {r["group"]: r["cuts"] for r in known.groupBy("group").agg(at.alias("cuts")).collect()}
    groups = {g: (r["n"], r["hi"], np.unique([r["lo"], *cuts.get(g, [])])) for g, r in sizes.items()}
    salts = max(1, -(-asked // (slices * ASKED_VALUES)))

    def sliced(batches):
        for b in batches:
            names, v = b.column("group").to_pylist(), b.column("v").to_numpy()
            out = np.zeros(len(v), np.int32)
            for g in set(names):
                at = np.flatnonzero([x == g for x in names])
                out[at] = np.searchsorted(groups[g][2], v[at], "right") - 1
            yield pa.record_batch([b.column("group"), pa.array(out), b.column("v"), b.column("upto")], ["group", "slice", "v", "upto"])

    rows = known.select("group", "v", "upto").mapInArrow(sliced, "group string, slice int, v double, upto double")
    return Distribution(rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), groups, salts)


def ask(groups: Groups, labels: list[str], x: np.ndarray) -> tuple[list, list[tuple[str, int, bytes]]]:
    """(what ``told`` needs at home, pieces ``group, slice, values`` to look up) of the rows of ``x``, each of the group of its label."""
    home, pieces = [], []
    for g in dict.fromkeys(labels):
        at = np.flatnonzero([y == g for y in labels])
        if g not in groups:
            home.append((g, at, None, 0, 0, 0, 0))
            continue
        values, place = np.unique(x[at], return_inverse=True)
        none = int(np.isnan(values).sum())
        _, last, cuts = groups[g]
        low, high = np.searchsorted(values, [cuts[0], last]).tolist()  # below all of the group; at or above its last value
        high = max(low, high)
        home.append((g, at, place.reshape(x[at].shape).astype(np.min_scalar_type(len(values))), low, high - low, len(values) - none - high, none))
        middle = values[low:high]
        cut = np.searchsorted(cuts, middle, "right") - 1
        edge = np.flatnonzero(np.diff(cut, prepend=-1, append=len(cuts)))
        pieces += [(g, int(cut[a]), pack_values(middle[a:b])) for a, b in zip(edge[:-1], edge[1:])]
    return home, pieces


def answers(known: Distribution, pieces: DataFrame) -> DataFrame:
    """``block, group, slice, data``: how many values of the group lie at or below each asked one."""
    def counted(key, asked, rows):
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "group": pa.array([], pa.string()), "slice": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        order = np.argsort(v := rows.column("v").to_numpy())
        v, upto = v[order], rows.column("upto").to_numpy()[order]
        told = [pack(upto[np.searchsorted(v, unpack_values(x), "right") - 1]) for x in asked.column("data").to_pylist()]
        return pa.table({"block": asked.column("block"), "group": asked.column("group"), "slice": asked.column("slice"), "data": pa.array(told, pa.binary())})

    to = ["group", "slice", "salt"]
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(known.salts)).cast("int"))
    return dealt.groupBy(*to).cogroup(known.rows.groupBy(*to)).applyInArrow(counted, "block long, group string, slice int, data binary")


def told(groups: Groups, home: list, back: pa.Table, shape: tuple[int, int]) -> np.ndarray:
    """Percent of the group at or below every asked value; NaN without a value, or a group."""
    out = np.full(shape, np.nan)
    back = back.sort_by("slice")
    names, data = back.column("group").to_pylist(), back.column("data").to_pylist()
    for g, at, place, low, middle, high, none in home:
        if place is None:
            continue
        counts = [unpack(d) for x, d in zip(names, data) if x == g]
        found = np.concatenate([np.zeros(low), *counts, np.full(high, groups[g][0]), np.full(none, np.nan)])
        out[at] = (found / groups[g][0] * 100)[place]
    return out
