"""Ranks, quantiles and positions against pandas and numpy, with ties, nulls and a hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonometry.operators import rank
from zonometry.plans.uncertainty import rank_band


@pytest.fixture(scope="module")
def ties():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(50, 20, 3000), 1)
    v[:1000] = 42.0  # a third of the rows share one value
    v[1000:1100] = np.nan
    g = rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1])
    return pd.DataFrame({"id": np.arange(3000), "v": v, "g": g})


def load(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)


@pytest.mark.parametrize("domain", [None, (0.0, 100.0)])
def test_percentile_matches_pandas(spark, ties, domain):
    out = rank.with_percentile(load(spark, ties), "v", "p", domain=domain).toPandas().sort_values("id")
    np.testing.assert_allclose(out["p"].to_numpy(float), ties["v"].rank(pct=True).to_numpy() * 100, rtol=1e-12)


def test_percentile_by_group_with_null_group(spark, ties):
    out = rank.with_percentile(load(spark, ties), "v", "p", ["g"]).toPandas().sort_values("id")
    want = ties.groupby("g", dropna=False)["v"].rank(pct=True) * 100
    np.testing.assert_allclose(out["p"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_rows_without_a_value_stay_out_of_the_join(spark):
    """Half nulls and one value on a third of the rows: ranks are right and no partition holds the nulls."""
    rows = [(i, None if i % 2 else (7.0 if i % 3 == 0 else float(i % 50))) for i in range(6000)]
    out = rank.with_percentile(spark.createDataFrame(rows, "id long, v double"), "v", "p")
    got = out.toPandas().sort_values("id")["p"].to_numpy(float)
    want = pd.Series([v for _, v in rows], dtype=float).rank(pct=True).to_numpy() * 100
    ties = pd.Series([v for _, v in rows], dtype=float).rank(method="average").to_numpy() / 3000 * 100
    np.testing.assert_allclose(got, ties, rtol=1e-12)
    assert np.isnan(got).sum() == np.isnan(want).sum() == 3000


def test_min_count_skips_thin_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    rows = {(r.g, r.v): r.p for r in rank.with_percentile(df, "v", "p", ["g"], min_count=2).collect()}
    assert rows == {("a", 1.0): 50.0, ("a", 2.0): 100.0, ("b", 3.0): None}


def test_exact_quantiles_match_numpy(spark, ties):
    probs = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    row = rank.exact_quantiles(load(spark, ties), "v", probs).first()
    want = np.nanpercentile(ties["v"], [100 * p for p in probs])
    np.testing.assert_allclose([row[f"q{i}"] for i in range(len(probs))], want, rtol=1e-12)


def test_global_index_is_consecutive_and_ordered(spark, ties):
    df = load(spark, ties)
    out = rank.global_index(df, [F.col("v"), F.col("id")], "pos").toPandas().sort_values("pos")
    assert out["pos"].tolist() == list(range(3000))
    want = ties.assign(k=ties["v"].fillna(-1e9)).sort_values(["k", "id"])["id"].tolist()
    assert out["id"].tolist() == want


def test_fixed_share_is_right_sided_search(spark):
    rng = np.random.default_rng(1)
    fixed, asked = np.round(rng.uniform(0, 100, 500), 1), np.round(rng.uniform(-5, 105, 300), 1)
    f = spark.createDataFrame([(float(x),) for x in fixed], "v double")
    q = spark.createDataFrame([(i, float(x)) for i, x in enumerate(asked)], "i int, v double")
    out = rank.with_fixed_share(q, f, "v", "p").toPandas().sort_values("i")
    want = np.searchsorted(np.sort(fixed), asked, side="right") / 500 * 100
    np.testing.assert_allclose(out["p"], want, rtol=1e-12)


def test_less_share_counts_only_eligible(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (4.0, True), (None, True)], "v double, e boolean")
    out = {r.v: r.p for r in rank.with_less_share(df, "v", F.col("e"), "p").collect()}
    assert out[1.0] == 0.0 and out[2.0] == pytest.approx(100 / 3) and out[4.0] == pytest.approx(200 / 3) and out[None] is None


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    d = rng.uniform(0, 100, (n, 3))
    rows = [(f"{i:06d}", *map(float, d[i]), float(20 * (i % 2)), 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "area string, a double, b double, c double, sa double, sb double, sc double")


def test_rank_band_does_not_depend_on_partitioning(spark):
    df = frame(spark, 300)
    one = rank_band(df.repartition(1), "area", ["a", "b", "c"], ["sa", "sb", "sc"], 20).orderBy("area").collect()
    many = rank_band(df.repartition(11), "area", ["a", "b", "c"], ["sa", "sb", "sc"], 20).orderBy("area").collect()
    assert one == many


def test_noise_only_widens_the_noisy_half(spark):
    df = frame(spark, 600)
    loud = rank_band(df, "area", ["a", "b", "c"], ["sa", "sb", "sc"], 60).toPandas().sort_values("area")
    width = (loud["rank_hi"] - loud["rank_lo"]).to_numpy()
    assert (loud["rank_lo"] <= loud["rank_hi"]).all()
    assert np.median(width[1::2]) > 1.2 * np.median(width[0::2])


def test_few_scoreable_rows_give_null_bands(spark):
    out = rank_band(frame(spark, 9), "area", ["a", "b", "c"], None, 20).collect()
    assert all(r.rank_lo is None and r.rank_hi is None for r in out)
