"""Rank bands: how far a rank moves under re-weighting and measurement noise."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonometry.functions.noise import digest, normals_of, uniform, uniforms_of
from zonometry.operators.packed import ASKED_VALUES, answers, ask, distribution, pack, pack_values, rounded, told, unpack, unpack_values
from zonometry.operators.rank import exact_quantiles
from zonometry.session import stage

# Noise scale (percentile points per unit CV), the CV floor quantile and excess cap.
SURVEY_SCALE, SURVEY_FLOOR_Q, SURVEY_EXCESS_CAP = 36.0, 0.50, 1.5
MODEL_SCALE = 71.0
WEIGHT_LO, WEIGHT_HI = 0.15, 0.55
DRAWS = 300
MIN_SCOREABLE = 10
BLOCK_ROWS, SLICE_ROWS = 2048, 100_000  # areas of a packed block (at most 65,536), and of a slice of one draw on average
DRAWN_AREAS = 200  # areas of a block whose members are shaken


def with_noise_sigma(df: DataFrame, survey_cv: str, model_cv: str,
                     survey_share: dict[str, float], model_share: dict[str, float]) -> DataFrame:
    """``sigma_<dim>``: survey noise above the median CV and model noise, in quadrature."""
    floor = exact_quantiles(df, survey_cv, [SURVEY_FLOOR_Q], names=["__floor"]).select("__floor")
    mid = exact_quantiles(df, model_cv, [0.5], names=["__mid"]).select("__mid")
    both = df.join(F.broadcast(floor)).join(F.broadcast(mid))  # one row each
    excess = F.least(F.greatest(F.coalesce(F.col(survey_cv), F.col("__floor")) - F.col("__floor"), F.lit(0.0)),
                     F.lit(SURVEY_EXCESS_CAP))
    model = F.coalesce(F.col(model_cv), F.col("__mid"))
    dims = sorted(set(survey_share) | set(model_share))
    out = {}
    for d in dims:
        a = F.coalesce(excess, F.lit(0.0)) * (SURVEY_SCALE * survey_share.get(d, 0.0))
        b = F.coalesce(model, F.lit(0.0)) * (MODEL_SCALE * model_share.get(d, 0.0))
        out[f"sigma_{d}"] = F.sqrt(a * a + b * b)
    return both.withColumns(out).drop("__floor", "__mid")


def draw_weights(spark, k: int, draws: int, seed: int) -> DataFrame:
    """(draw, w0..wk-1): dimension weights uniform in the allowed range, summing to one."""
    d = spark.range(draws).select(F.col("id").cast("int").alias("draw")).withColumn(
        "__d", digest(F.lit(seed), F.lit("w"), F.col("draw")))
    raw = d.select("draw", *[(F.lit(WEIGHT_LO) + uniform(F.col("__d"), i) * (WEIGHT_HI - WEIGHT_LO)).alias(f"r{i}") for i in range(k)])
    total = sum(F.col(f"r{i}") for i in range(k))
    return raw.select("draw", *[(F.col(f"r{i}") / total).alias(f"w{i}") for i in range(k)])


def _composites(seed: int, keys: list[str], x: np.ndarray, sigma: np.ndarray | None, weights: np.ndarray) -> np.ndarray:
    """rows x draws: weighted means of the dimensions that are there, shaken by ``sigma``; NaN without any."""
    shaken = np.repeat(x[:, None, :], len(weights), 1)
    if sigma is not None:
        noise = normals_of(uniforms_of(seed, keys, len(weights)), x.shape[1]) * sigma[:, None, :]
        shaken = np.clip(shaken + np.nan_to_num(noise), 0.0, 100.0)
    known = ~np.isnan(x)
    den = known.astype(float) @ weights.T
    num = np.einsum("bdk,dk->bd", np.nan_to_num(shaken), weights)
    return np.round(np.divide(num, den, out=np.full_like(num, np.nan), where=den > 0), 9)


def rank_bands(df: DataFrame, key: str, dims: list[str], variants: dict[str, list[str] | None], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """5th and 95th percentile of each area's rank over the draws, for every variant of the noise: ``key``, then ``<variant>_lo`` and ``<variant>_hi``.

    ``df`` holds the scoreable rows; a variant names its noise columns, or is None for weights only. A block of areas makes
    its composites of all draws of all variants at once and keeps, for each draw, its distinct values with their counts: one packed row a
    block, draw and slice of the 0..100 range. A (draw, slice) ranks the values of all blocks by array work, with
    the counts of lower slices below them, and sends each block its ranks back; there every area's quantiles are taken. A value that very many
    areas share is one entry a block, and areas x draws never become rows.
    """
    spark, names = df.sparkSession, list(variants)
    weights = np.array([list(r)[1:] for r in draw_weights(spark, len(dims), draws, seed).orderBy("draw").collect()])  # ``draws`` rows
    slices = max(1, -(-df.count() // SLICE_ROWS))
    noise = sorted({c for v in variants.values() if v for c in v})
    none = reduce(lambda a, b: a & b, [F.col(d).isNull() for d in dims])  # these have no band and count for none
    rows = df.where(~none).select(F.col(key), F.col(key).cast("string").alias("__key"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*dims, *noise])])

    def block(table: pa.Table, number: int) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in [*dims, *noise]}
        x, keys = np.column_stack([cols[d] for d in dims]), table.column("__key").to_pylist()
        comps = np.concatenate([_composites(seed, keys, x, None if v is None else np.column_stack([cols[c] for c in v]), weights) for v in variants.values()], 1)
        place = np.zeros(comps.shape, "<u2")
        out = {"draw": [], "slice": [], "values": [], "counts": []}
        for d in range(comps.shape[1]):
            value, place[:, d], count = np.unique(comps[:, d], return_inverse=True, return_counts=True)
            cut = np.clip(value * (slices / 100.0), 0, slices - 1).astype(np.int64)
            edge = np.flatnonzero(np.diff(cut, prepend=-1, append=slices))
            for lo, hi in zip(edge[:-1], edge[1:]):
                for c, v in (("draw", d), ("slice", int(cut[lo])), ("values", pack_values(value[lo:hi])), ("counts", pack(np.cumsum(count[lo:hi])))):
                    out[c].append(v)
        sink = pa.BufferOutputStream()
        kept = table.select([key])
        with pa.ipc.new_stream(sink, kept.schema) as w:
            w.write_table(kept)
        n = len(out["draw"])
        return pa.record_batch(
            [pa.array([number] * (n + 1), pa.int64()), pa.array([-1, *out["draw"]], pa.int32()), pa.array([0, *out["slice"]], pa.int32()),
             pa.array([place.tobytes(), *out["values"]], pa.binary()), pa.array([sink.getvalue().to_pybytes(), *out["counts"]], pa.binary())],
            ["block", "draw", "slice", "values", "counts"])

    def packed(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                yield block(pa.Table.from_batches([batch.slice(lo, BLOCK_ROWS)]), at)
                at += 1

    blocks = stage(rows.mapInArrow(packed, "block long, draw int, slice int, values binary, counts binary"), "packed-draws")
    pieces = blocks.where("draw >= 0")

    def counted(batches):
        for b in batches:
            n = [int(unpack(x)[-1]) for x in b.column("counts").to_pylist()]
            yield pa.record_batch([b.column("draw"), b.column("slice"), pa.array(n, pa.int64())], ["draw", "slice", "n"])

    totals = pieces.select("draw", "slice", "counts").mapInArrow(counted, "draw int, slice int, n long").groupBy("draw", "slice").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("draw").orderBy("slice")
    below = totals.select("draw", "slice", (F.sum("n").over(run) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy("draw")).alias("all"))

    def ranked(key_, t):
        values = [unpack_values(x) for x in t.column("values").to_pylist()]
        counts = [np.diff(unpack(x), prepend=0) for x in t.column("counts").to_pylist()]
        value, at = np.unique(np.concatenate(values), return_inverse=True)
        ties = np.bincount(at, np.concatenate(counts))
        twice = (2 * (t.column("below")[0].as_py() + np.cumsum(ties) - ties) + ties + 1)[at]  # ranks may end in a half
        edge = np.cumsum([0, *map(len, values)])
        return pa.table({"block": t.column("block"), "draw": t.column("draw"), "slice": t.column("slice"), "all": t.column("all"),
                         "twice": pa.array([pack(twice[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    back = pieces.join(below, ["draw", "slice"]).groupBy("draw", "slice").applyInArrow(ranked, "block long, draw int, slice int, all long, twice binary")
    bounds = [f"{n}_{end}" for n in names for end in ("lo", "hi")]

    def banded(key_, home, back):
        keys = pa.ipc.open_stream(home.column("counts")[0].as_py()).read_all()
        width = draws * len(names)
        place = np.frombuffer(home.column("values")[0].as_py(), "<u2").reshape(len(keys), width)
        by_draw = back.sort_by([("draw", "ascending"), ("slice", "ascending")])
        pct, whole = np.full(place.shape, np.nan), back.column("all")[0].as_py() if back.num_rows else 0
        draw, parts = by_draw.column("draw").to_numpy(), [unpack(x) for x in by_draw.column("twice").to_pylist()]
        edge = np.searchsorted(draw, np.arange(width + 1))
        for d in range(width):
            if edge[d] < edge[d + 1]:
                pct[:, d] = (np.concatenate(parts[edge[d] : edge[d + 1]]) / 2 / whole * 100)[place[:, d]]
        out = {key: keys.column(key).combine_chunks()}
        for i, n in enumerate(names):
            q = np.quantile(pct[:, i * draws : (i + 1) * draws], [0.05, 0.95], axis=1) if whole >= MIN_SCOREABLE else np.full((2, len(keys)), np.nan)
            out |= {f"{n}_lo": q[0], f"{n}_hi": q[1]}
        return pa.table({c: v if c == key else pa.array(v, from_pandas=True) for c, v in out.items()})

    schema = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{b} double" for b in bounds)
    out = blocks.where("draw < 0").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(banded, schema)
    return out.unionByName(df.where(none).select(key, *[F.lit(None).cast("double").alias(b) for b in bounds]))


def rank_band(df: DataFrame, key: str, dims: list[str], sigmas: list[str] | None = None,
              draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """5th and 95th percentile of each area's rank over the draws: (key, rank_lo, rank_hi)."""
    return rank_bands(df, key, dims, {"rank": sigmas}, draws, seed)


def median_widths(bands: DataFrame, flag: str, tag: str) -> DataFrame:
    """Median band width by a boolean flag."""
    w = bands.where(F.col("rank_lo").isNotNull()).withColumn("width", F.col("rank_hi") - F.col("rank_lo"))
    q = exact_quantiles(w, "width", [0.5], [flag], [tag], domain=(0.0, 100.0))
    return q.select(flag, tag)


def band_decomposition(df: DataFrame, key: str, dims: list[str], sigmas: list[str], flag: str,
                       draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Median width by confidence tier: combined, weights only, and the part noise adds."""
    flags = df.select(key, flag)
    bands = stage(rank_bands(df, key, dims, {"both": sigmas, "weights": None}, draws, seed), "bands").join(flags, key)
    both, weights_only = [bands.select(flag, F.col(f"{n}_lo").alias("rank_lo"), F.col(f"{n}_hi").alias("rank_hi")) for n in ("both", "weights")]
    out = median_widths(both, flag, "combined").join(median_widths(weights_only, flag, "weights_only"), flag)
    return out.withColumn("measurement", F.col("combined") - F.col("weights_only"))


def differentiation_gate(bands: DataFrame, flag: str, ratio: float = 1.6) -> DataFrame:
    """Low-confidence bands must be ``ratio`` times as wide as the others."""
    m = median_widths(bands, flag, "width")
    wide = m.agg(F.max(F.when(F.col(flag), F.col("width"))).alias("low"), F.max(F.when(~F.col(flag), F.col("width"))).alias("high"))
    return wide.withColumn("ratio", F.col("low") / F.col("high")).withColumn("ok", F.col("ratio") >= ratio)


def shrinkage_gate(on: DataFrame, off: DataFrame, flag: str) -> DataFrame:
    """Low-confidence bands must be narrower with shrinkage than without."""
    a = median_widths(on, flag, "width_on").where(F.col(flag)).select("width_on")
    b = median_widths(off, flag, "width_off").where(F.col(flag)).select("width_off")
    return a.join(F.broadcast(b)).withColumn("ok", F.col("width_on") < F.col("width_off"))  # one row each


def resample_sd(samples: DataFrame, members: DataFrame, sub_means: DataFrame, dim_means: DataFrame,
                key: str, draws: int, seed: int) -> DataFrame:
    """SD over draws of each sampled area's dimension percentile when its members are shaken.

    ``samples``: key, item, subscore, dim, base (percentile), value (oriented), se, for every
    scored member of a sampled area. ``members``: item, value; ``sub_means``: subscore, raw;
    ``dim_means``: dim, raw, the fixed distributions of the whole table.

    A block of areas draws all its members at once, as arrays. At each of the three levels it sends every slice of the fixed
    distribution its distinct values and gets their places back (``packed``); areas x draws never become rows.
    """
    fields = ["item", "subscore", "dim", *[F.col(c).cast("double").alias(c) for c in ("base", "value", "se")]]
    lists = stage(samples.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("x")), "sampled-areas")
    asked = lists.count() * draws
    lists = lists.repartition(max(1, -(-asked // ASKED_VALUES)))  # small rows that draw much
    levels = [distribution(members, "item", "value", asked), distribution(sub_means, "subscore", "raw", asked, (0.0, 100.0)),
              distribution(dim_means, "dim", "raw", asked, (0.0, 100.0))]
    groups = [x.groups for x in levels]
    names = ["block", "group", "slice", "data"]
    schema = "block long, group string, slice int, data binary"
    kind, dim = lists.schema[key].dataType.simpleString(), samples.schema["dim"].dataType.simpleString()

    def sent(number: int, level: int, keys: pa.Array, labels: list[tuple], x: np.ndarray, still: np.ndarray | None = None) -> list[tuple]:
        """Rows of a block: what it keeps (slice -1) and its pieces; ``labels`` end in the group that a row asks."""
        home, pieces = ask(groups[level], [y[-1] for y in labels], x)
        return [(number, None, -1, pickle.dumps((keys, labels, home, x.shape, still))), *[(number, *p) for p in pieces]]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def block(piece: pa.RecordBatch, number: int) -> pa.RecordBatch:
        keys, texts, x = piece.column(key).take(pa.array(np.arange(piece.num_rows))), piece.column("__key").to_pylist(), piece.column("x")
        flat, who = x.flatten(), np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy())
        item, sub, top = (flat.field(c).to_pylist() for c in ("item", "subscore", "dim"))
        base, value, se = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("base", "value", "se"))
        # members without a standard error are not drawn at all: they keep their base percentile
        moved = flat.field("se").is_valid().to_numpy(zero_copy_only=False)
        heads = [p for p in ("|".join(t for t in (texts[w], i) if t is not None) for w, i, m in zip(who, item, moved) if m)]
        se = np.where(value == 0, se, np.fmin(se, 2 * np.abs(value)))[moved]
        z = normals_of(uniforms_of(seed, heads, draws), 1)[..., 0] if heads else np.empty((0, draws))
        shaken = rounded(value[moved][:, None] + z * se[:, None])
        still = np.flatnonzero(~moved)
        labels = [(int(who[i]), top[i], sub[i], item[i]) for i in np.flatnonzero(moved)]
        rest = [(int(who[i]), top[i], sub[i]) for i in still]
        return table(sent(number, 0, keys, labels, shaken, (rest, base[still])))

    def first(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, DRAWN_AREAS):
                yield block(batch.slice(lo, DRAWN_AREAS), at)
                at += 1

    def averaged(labels: list[tuple], p: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Mean of the known rows that share a label."""
        at = {y: i for i, y in enumerate(dict.fromkeys(labels))}
        who = np.array([at[y] for y in labels], int)
        total, n = np.zeros((len(at), p.shape[1])), np.zeros((len(at), p.shape[1]))
        np.add.at(total, who, np.nan_to_num(p))
        np.add.at(n, who, ~np.isnan(p))
        return list(at), rounded(np.divide(total, n, out=np.full_like(total, np.nan), where=n > 0))

    def opened(level: int, home: pa.Table, back: pa.Table):
        keys, labels, own, shape, still = pickle.loads(home.column("data")[0].as_py())
        return keys, labels, told(groups[level], own, back, shape), still

    def raised(level: int):
        def run(key_, home, back):
            keys, labels, p, still = opened(level, home, back)
            labels = [y[:-1] for y in labels]
            if still:
                labels, p = labels + still[0], np.concatenate([p, np.repeat(still[1][:, None], draws, 1)])
            labels, raw = averaged(labels, p)
            return pa.Table.from_batches([table(sent(key_[0].as_py(), level + 1, keys, labels, raw))])

        return run

    def spread(key_, home, back):
        keys, labels, p, _ = opened(2, home, back)
        p = p - np.nan_to_num(p).max(1, keepdims=True)  # one value in all draws has no spread to the last digit
        n = (~np.isnan(p)).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.nansum(p, 1) / n
            sd = np.sqrt(np.nansum((p - mean[:, None]) ** 2, 1) / n)
        return pa.table({key: keys.take(pa.array([y[0] for y in labels], pa.int64())), "dim": [y[1] for y in labels], "sd": pa.array(sd, from_pandas=True)})

    def met(rows: DataFrame, level: int):
        return rows.where("slice < 0").groupBy("block").cogroup(answers(levels[level], rows.where("slice >= 0")).groupBy("block"))

    rows = stage(lists.withColumn("__key", F.col(key).cast("string")).mapInArrow(first, schema), "shaken-members")
    for level, name in enumerate(("shaken-subs", "shaken-dims")):
        rows = stage(met(rows, level).applyInArrow(raised(level), schema), name)
    return met(rows, 2).applyInArrow(spread, f"`{key}` {kind}, dim {dim}, sd double")


def calibration_gate(sds: DataFrame, sigmas: DataFrame, key: str, lo: float = 0.8, hi: float = 1.2,
                     min_rows: int = 20) -> DataFrame:
    """Median of injected sigma over resampled SD per dimension, against the allowed corridor."""
    joined = sds.join(sigmas, [key, "dim"]).where((F.col("sigma") > 1.0) & (F.col("sd") > 0))
    joined = joined.withColumn("ratio", F.col("sigma") / F.col("sd"))
    q = exact_quantiles(joined, "ratio", [0.5], ["dim"], ["ratio"])
    ok = F.when(F.col("n") > min_rows, F.col("ratio").between(lo, hi))
    return q.withColumn("ok", ok)
