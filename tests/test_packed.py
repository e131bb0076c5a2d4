"""Packed numbers, lookups in slices of a distribution, and the draws that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonometry.functions.noise import normals_of, uniforms_of
from zonometry.operators import packed
from zonometry.plans import uncertainty as unc


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    whole = np.sort(rng.integers(-(2**62), 2**62, 50))
    for x in (whole, np.arange(5), np.array([7, 7, 7]), np.array([-3]), np.array([], int)):
        assert packed.unpack(packed.pack(x)).tolist() == x.tolist()
    for v in (np.sort(np.round(rng.normal(0, 50, 99), 9)), np.sort(rng.normal(0, 1e9, 99)), np.array([-np.inf, -1.5, 0.1 + 0.2, np.inf]), np.array([])):
        assert packed.unpack_values(packed.pack_values(v)).tolist() == v.tolist()
    assert packed.rounded(np.array([0.0244140625 / 1e0, -0.0000000005, 1e12 + 0.5, np.nan])).tolist()[:3] == [0.024414063, -0.000000001, 1e12 + 0.5]


def _case(spark):
    rng = np.random.default_rng(2)
    members = [(i, float(x)) for i in ("m1", "m2", "m3") for x in np.round(rng.normal(5, 2, 300), 2)]
    subs = [(s, float(x)) for s in ("s1", "s2") for x in np.round(rng.uniform(0, 100, 300), 1)]
    dims = [("d", float(x)) for x in np.round(rng.uniform(0, 100, 300), 1)]
    rows = []
    for k in range(60):
        for item, sub in (("m1", "s1"), ("m2", "s1"), ("m3", "s2")):
            se = None if (item == "m3" or k % 9 == 0) else float(rng.uniform(0, 3))
            value = None if k == 5 and item == "m1" else 0.0 if k == 7 else float(np.round(rng.normal(5, 2), 4))
            rows.append((None if k == 11 else f"a{k}", item, sub, "d", None if k == 3 else float(rng.uniform(0, 100)), value, se))
    rows.append(("a20", *rows[60][1:]))  # a member that comes twice
    frame = spark.createDataFrame
    return (rows, members, subs, dims,
            [frame(rows, "area string, item string, subscore string, dim string, base double, value double, se double"),
             frame(members, "item string, value double"), frame(subs, "subscore string, raw double"), frame(dims, "dim string, raw double")])


def _plain(rows, members, subs, dims, draws, seed):
    def share(table, g, v):
        have = np.array([x for y, x in table if y == g])
        return np.where(np.isnan(v), np.nan, (have[None, :] <= v[:, None]).sum(1) / len(have) * 100)

    def mean(x):
        with np.errstate(invalid="ignore"):
            return np.round(np.nansum(x, 0) / (~np.isnan(x)).sum(0), 9)

    each = {}
    for k, item, sub, d, base, value, se in rows:
        p = np.full(draws, np.nan if base is None else base)
        if se is not None:
            v = np.nan if value is None else value
            z = normals_of(uniforms_of(seed, [item if k is None else f"{k}|{item}"], draws), 1)[0, :, 0]
            p = share(members, item, np.round(v + z * (se if v == 0 else np.fmin(se, 2 * abs(v))), 9))
        each.setdefault((k, d, sub), []).append(p)
    tops = {}
    for (k, d, sub), ps in each.items():
        tops.setdefault((k, d), []).append(share(subs, sub, mean(np.array(ps))))
    out = {kd: share(dims, kd[1], mean(np.array(ps))) for kd, ps in tops.items()}
    return {k: np.nanstd(p) for (k, _), p in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_resampled_sd_equals_plain_draws(spark, monkeypatch, small):
    if small:  # many slices, each dealt to several tasks, and blocks of a few areas
        monkeypatch.setattr(packed, "SLICE_VALUES", 20)
        monkeypatch.setattr(packed, "ASKED_VALUES", 100)
        monkeypatch.setattr(unc, "DRAWN_AREAS", 7)
    rows, members, subs, dims, frames = _case(spark)
    out = {r.area: r.sd for r in unc.resample_sd(*frames, "area", 40, 3).collect()}
    want = _plain(rows, members, subs, dims, 40, 3)
    assert out.keys() == want.keys()
    for k, sd in want.items():
        assert out[k] == pytest.approx(sd, abs=1e-7), k
    assert out["a9"] == 0


def test_resampled_draws_are_never_rows(spark, monkeypatch):
    sizes = {}

    def counted(df, name, *more):
        out = stage(df, name, *more)
        sizes[name] = out.count()
        return out

    stage = unc.stage
    monkeypatch.setattr(unc, "stage", counted)
    frames = _case(spark)[4]
    unc.resample_sd(*frames, "area", 50, 3).collect()
    assert sizes and max(sizes.values()) <= 60


def test_drawn_ranks_move_few_bytes(spark, monkeypatch):
    kept = {}

    def seen(df, name, *more):
        kept[name] = stage(df, name, *more)
        return kept[name]

    stage = unc.stage
    monkeypatch.setattr(unc, "stage", seen)
    areas, draws = 2048, 20
    df = spark.range(areas).select(F.format_string("%05d", "id").alias("area"), (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"), F.lit(9.0).alias("sx"), F.lit(5.0).alias("sy"))
    assert unc.rank_band(df, "area", ["x", "y"], ["sx", "sy"], draws).where("rank_lo < rank_hi").count() > areas * 0.9
    moved = kept["packed-draws"].where("draw >= 0").agg(F.sum(F.length("values") + F.length("counts"))).first()[0]
    home = kept["packed-draws"].where("draw < 0").agg(F.sum(F.length("values"))).first()[0]
    assert moved <= 7 * areas * draws and home <= 2 * areas * draws
