"""Hand-computed values and brute-force checks of the smaller rules."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonometry.functions import keys, labels, numeric
from zonometry.operators import aggregates as agg
from zonometry.operators import crosswalk, joins, quality, resample, serve, smallarea, stats
from zonometry.plans import score, validate
from zonometry import session
from zonometry.session import shared_dir
from zonometry.sinks import tables as sink
from zonometry.sources import nested, tabular


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first().o


@pytest.mark.parametrize("raw,want", [("123.0", "00123"), (" 9021 ", "09021"), ("90210-1234", "90210"), (None, None)])
def test_area_key(spark, raw, want):
    assert one(spark, keys.norm_area_key(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [("0", (0.0, False)), ("1,002", (1002.0, False)), ("*", (None, True)), ("S", (None, True)),
                                      ("", (None, True)), (None, (None, True)), (" 7 ", (7.0, False))])
def test_suppressed_cell_keeps_real_zero(spark, raw, want):
    value, censored = numeric.suppressed_cell(F.col("v"))
    row = spark.createDataFrame([(raw,)], "v string").select(value.alias("a"), censored.alias("b")).first()
    assert (row.a, row.b) == want


def test_interval_to_se(spark):
    assert one(spark, numeric.interval_to_se(F.col("v")), "( 9.3, 12.1)") == pytest.approx(2.8 / 3.92)
    assert one(spark, numeric.interval_to_se(F.col("v")), "n/a") is None


def test_title_case_breaks_at_every_mark(spark):
    assert one(spark, labels.title_case(F.col("v")), "O'FALLON WINSTON-SALEM") == "O'Fallon Winston-Salem"
    assert one(spark, labels.title_case(F.col("v")), "  ") is None


def test_provider_class_order(spark):
    def cls(g, c, s):
        df = spark.createDataFrame([(g, c, s)], "g string, c string, s string")
        return df.select(labels.provider_class(F.col("g"), F.col("c"), F.col("s")).alias("o")).first().o

    doctor = "Allopathic & Osteopathic Physicians"
    assert cls(doctor, "Psychiatry & Neurology", "Psychiatry") == "mental_health"
    assert cls(doctor, "Psychiatry & Neurology", "Neurology") == "specialist"
    assert cls("x", "Nurse Practitioner", "Psychiatric/Mental Health") == "mental_health"
    assert cls("x", "Physician Assistant", "") == "primary_care"
    assert cls("Dental Providers", "Dental Hygienist", "") == "other"


def test_row_sum_needs_one_value(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r.o for r in df.select(numeric.row_sum([F.col("a"), F.col("b")]).alias("o")).collect()] == [1.0, None]


def test_shortage_score_rules(spark):
    des = spark.createDataFrame([("tract", "01001000100", 20.0), ("tract", "01001000100", 4.0), ("county", "01003", 10.0)], "kind string, code string, score double")
    xw = spark.createDataFrame([("A", "01001000100", 1.0), ("A", "01001000200", 1.0), ("B", "01003000100", 2.0), ("C", "01005000100", 3.0)],
                               "area string, tract string, w double")
    out = {r.area: r.score for r in crosswalk.shortage_score(des, xw, "area", "tract", "w").collect()}
    assert out == {"A": 10.0, "B": 10.0, "C": 0.0}


def fay_herriot(r, s2):
    def g(t):
        p = 1 / (t + s2)
        m = (p * r).sum() / p.sum()
        return (p * (r - m) ** 2).sum() - (len(r) - 1), m

    if g(0)[0] <= 0:
        return 0.0, g(0)[1]
    lo, hi = 0.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if g(mid)[0] > 0 else (lo, mid)
    return lo, g(lo)[1]


def test_shrinkage_matches_bisection(spark):
    rng = np.random.default_rng(0)
    rows = []
    for grp, n, spread in (("wide", 40, 0.2), ("flat", 30, 0.0), ("mixed", 200, 0.02), ("thin", 3, 0.1)):
        se = rng.uniform(0.005, 0.05, n)
        r = np.clip(0.4 + rng.normal(0, spread, n) + rng.normal(0, se), 0, 1)
        rows += [(f"{grp}{i}", grp, float(r[i]), float(se[i])) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["k", "g", "r", "se"])
    out = smallarea.shrink(spark.createDataFrame(pdf), "k", "g", {"r": "se"}).toPandas().set_index("k")["r"]
    for grp, part in pdf.groupby("g"):
        want = part["r"].to_numpy()
        if len(part) >= 5:
            s2 = part["se"].to_numpy() ** 2
            t, m = fay_herriot(part["r"].to_numpy(), s2)
            want = t / (t + s2) * part["r"].to_numpy() + (1 - t / (t + s2)) * m
        np.testing.assert_allclose(out.loc[part["k"]].to_numpy(), want, atol=1e-9)


def test_shrinkage_pulls_the_noisy_outlier(spark):
    rows = [(str(i), "g", 0.10 + 0.001 * i, 0.005) for i in range(5)] + [("out", "g", 0.90, 0.40), ("none", "g", 0.5, None)]
    out = {r.k: r.r for r in smallarea.shrink(spark.createDataFrame(rows, "k string, g string, r double, se double"), "k", "g", {"r": "se"}).collect()}
    assert out["out"] < 0.6 and abs(out["0"] - 0.10) < 0.03 and out["none"] == 0.5


def test_fdr_oracle(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.008), ("c", 0.039), ("d", 0.041), ("e", 0.9), ("x", None)], "k string, p double")
    out = {r.k: (round(r.q_value, 5), r.survives) for r in stats.bh_fdr(df, "k", "p").collect()}
    assert out == {"a": (0.005, True), "b": (0.02, True), "c": (0.05125, False), "d": (0.05125, False), "e": (0.9, False)}


def test_weighted_correlation_equals_repeated_rows(spark):
    rng = np.random.default_rng(2)
    a, w = rng.normal(size=80), rng.integers(1, 5, 80)
    b = a + rng.normal(size=80)
    df = spark.createDataFrame([(float(x), float(y), float(k)) for x, y, k in zip(a, b, w)], "a double, b double, w double")
    r = stats.weighted_correlations(df, [("a", "b")], "w").first().r
    assert r == pytest.approx(np.corrcoef(np.repeat(a, w), np.repeat(b, w))[0, 1], abs=1e-12)


def test_correlation_floor_and_zero_variance(spark):
    df = spark.createDataFrame([(float(i), 5.0, None if i else 1.0) for i in range(60)], "a double, b double, c double")
    out = {(r.x, r.y): r.r for r in stats.correlations(df, ["a"], ["b", "c"]).collect()}
    assert out == {("a", "b"): None, ("a", "c"): None}


def test_partial_correlation_is_residual_correlation(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(300, 3))
    y, c = z @ [1, 2, 0.5] + rng.normal(size=300), z @ [0.5, -1, 1] + rng.normal(size=300)
    cols = ["y", "c", "z0", "z1", "z2"]
    df = spark.createDataFrame([tuple(map(float, t)) for t in np.column_stack([y, c, z])], ", ".join(f"{x} double" for x in cols))
    a = np.column_stack([np.ones(300), z])
    ry, rc = (v - a @ np.linalg.lstsq(a, v, rcond=None)[0] for v in (y, c))
    assert stats.partial_corr(df, "y", "c", cols[2:]).first().partial_r == pytest.approx(np.corrcoef(ry, rc)[0, 1], abs=1e-10)


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05), (0.0, 3, 1.0), (40.0, 2, np.exp(-20))])
def test_chi2_tail(x, df, p):
    assert stats.chi2_tail(x, df) == pytest.approx(p, rel=1e-5)


def test_nonneg_ls_satisfies_the_optimality_conditions():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x = rng.normal(size=(40, 3)) + rng.normal(size=(40, 1))
        y = x @ rng.normal(size=3) + rng.normal(size=40)
        b = stats.nonneg_ls(x.T @ x, x.T @ y)
        grad = x.T @ (x @ b - y)
        assert (b >= 0).all() and (grad[b == 0] >= -1e-8).all() and np.allclose(grad[b > 0], 0, atol=1e-7)


def cv_frame(n, noise, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 100, (n, 3))
    y = x @ [0.5, 0.3, 0.2] * (0 if noise else 1) + rng.normal(0, 8, n)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "g": rng.choice([f"s{i}" for i in range(10)], n)})


def direct_cv(pdf):
    x, y, g = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy(), pdf["g"].to_numpy()
    pred, ws = np.full(len(y), np.nan), []
    for u in np.unique(g):
        tr = g != u
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - mu) / sd
        b = stats.nonneg_ls(z.T @ z, z.T @ (y[tr] - y[tr].mean()))
        if b.sum() == 0:
            continue
        pred[~tr] = (x[~tr] - mu) / sd @ b + y[tr].mean()
        ws.append(stats.floored(b))
    ok = ~np.isnan(pred)
    return 1 - ((y[ok] - pred[ok]) ** 2).sum() / ((y[ok] - y[ok].mean()) ** 2).sum(), np.array(ws)


@pytest.mark.parametrize("noise", [False, True])
def test_leave_one_state_out_matches_row_loop(spark, noise):
    pdf = cv_frame(600, noise, 6)
    row = validate.loso_cv(spark.createDataFrame(pdf), ["a", "b", "c"], "y", "g").first()
    r2, ws = direct_cv(pdf)
    assert row.cv_r2 == pytest.approx(r2, abs=1e-9) and row.mean_a == pytest.approx(ws[:, 0].mean(), abs=1e-9)
    assert row.sd_b == pytest.approx(ws[:, 1].std(), abs=1e-6) and (row.cv_r2 < 0.1 if noise else row.cv_r2 > 0.6)


def test_nnls_fit_reports_weights_and_r2(spark):
    pdf = cv_frame(400, False, 7)
    row = validate.nnls_fit(spark.createDataFrame(pdf), ["a", "b", "c"], "y").first()
    assert row.w_a + row.w_b + row.w_c == pytest.approx(100) and row.w_a > row.w_b > row.w_c >= 5 and row.r2 > 0.6


def test_effective_dimensions_of_one_gradient(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=500)
    d = base[:, None] + 0.05 * rng.normal(size=(500, 3))
    df = spark.createDataFrame([(*map(float, x), float(x.mean())) for x in d], "a double, b double, c double, s double")
    row = validate.effective_dimensions(df, ["a", "b", "c"], "s").first()
    assert row.pc1_share > 0.98 and row.participation_ratio < 1.05 and row.pc1_corr > 0.999


def test_cluster_blocks(spark):
    df = spark.createDataFrame([(1, "NY", "Kings"), (2, "NY", "Kings"), (3, "NY", "Queens"), (4, "TX", "Harris"), (5, "TX", "Harris"), (6, "CA", "")],
                               "i int, s string, c string")
    for level, want in (("county", [1, 1, 2, 2]), ("state", [1, 2, 3])):
        key = resample.cluster_key(level, F.col("i"), F.col("s"), F.col("c"))
        assert sorted(r["count"] for r in df.groupBy(key.alias("k")).count().collect()) == want


def clustered(spark, beta):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(60):
        u = rng.normal()
        for _ in range(6):
            x = u + 0.5 * rng.normal()
            rows.append((f"c{c:02d}", float(x), float(beta * x + rng.normal())))
    return spark.createDataFrame(rows, "block string, x double, y double")


@pytest.mark.parametrize("beta,excludes", [(0.8, True), (0.0, False)])
def test_block_bootstrap_reads_clustered_signal(spark, beta, excludes):
    g = resample.bootstrap_grams(clustered(spark, beta), ["x", "y"], "block", 200, 1)
    row = resample.intervals(g.select("replicate", stats.corr_of(0, 1).alias("r")), "r").first()
    assert row.excludes_0 is excludes and row.ci_lo < row.point < row.ci_hi and row.n_boot == 200


def test_draws_repeat_and_sum_to_the_number_of_blocks(spark):
    index = resample.block_index(clustered(spark, 0.0), "block")
    a = resample.draw_counts(index, "block", 5, 3)
    b = resample.draw_counts(index.repartition(9), "block", 5, 3)
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r["sum(times)"] for r in a.groupBy("replicate").sum("times").collect()} == {60}


def test_draw_vectors_hold_the_counts(spark):
    index = resample.block_index(clustered(spark, 0.0), "block")
    counts = {(r.block, r.replicate): r.times for r in resample.draw_counts(index, "block", 3, 3).collect()}
    vectors = {r.block: np.frombuffer(r.draws, "<u2") for r in resample.draw_vectors(index.repartition(9), "block", 3, 3).collect()}
    assert len(vectors) == 60 and all(v.tolist() == [counts.get((b, i), 0) for i in range(-1, 3)] for b, v in vectors.items())


def test_bootstraps_meet_one_row_a_block(spark, monkeypatch):
    """No row of a block's sums, nor of its name, for every replicate; a block that is not finite counts only where it is drawn."""
    monkeypatch.setattr(resample, "draw_counts", None)
    df = clustered(spark, 0.5).withColumn("x", F.when(F.col("block") == "c07", float("nan")).otherwise(F.col("x")))
    df = df.unionByName(df.select(F.lit(None).cast("string").alias("block"), "x", "y").limit(5))
    vectors = resample.stage(resample.draw_vectors(resample.block_index(df, "block"), "block", 30, 1), "vectors")
    times = {r.block: np.frombuffer(r.draws, "<u2") for r in vectors.collect()}
    sums = df.withColumn("one", F.lit(1.0)).where("block is not null").groupBy("block").agg(F.sum("one").alias("n"), F.sum("x").alias("x"))
    got = {r.replicate: (r.n, r.x) for r in resample.drawn_sums(sums.withColumn("c", F.lit(4)), vectors, "block", "c", ["n", "x"]).collect()}
    rows = sums.collect()
    for i in range(31):
        n, x = (sum(r[c] * int(times[r.block][i]) for r in rows if times[r.block][i]) for c in ("n", "x"))
        assert got[i - 1][0] == n and (abs(got[i - 1][1] - x) < 1e-9 or np.isnan([got[i - 1][1], x]).all())
    assert 0 < sum(np.isnan(x) for _, x in got.values()) < 31
    given = df.select("block", "y", (F.col("y") + 1).alias("z"))
    shared, own = (resample.bootstrap_grams(given, ["y", "z"], "block", 30, 1, vectors=v).collect() for v in (vectors, None))
    assert {(r.replicate, r.n) for r in shared} == {(r.replicate, r.n) for r in own} == {(i, n) for i, (n, _) in got.items()}


def test_weights_are_validated():
    with pytest.raises(ValueError):
        score.effective_weights({"a": -1.0, "b": 1.0, "c": 1.0})
    with pytest.raises(ValueError):
        score.effective_weights({"a": float("nan"), "b": 1.0, "c": 1.0})
    assert score.effective_weights({"a": 0.0, "b": 0.0, "c": 0.0}) == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_geometric_is_below_additive_and_needs_a_score(spark):
    df = spark.createDataFrame([(90.0, 10.0, None, True), (50.0, 50.0, 50.0, True), (1.0, 2.0, 3.0, False)], "a double, b double, c double, ok boolean")
    w = {"a": 1.0, "b": 1.0, "c": 1.0}
    out = df.select(score.additive(w, F.col("ok")).alias("s"), score.geometric(w, F.col("ok")).alias("m")).collect()
    assert (out[0].s, out[0].m) == (50.0, pytest.approx(30.0)) and (out[1].s, out[1].m) == (50.0, pytest.approx(50.0)) and out[2].s is None


def test_misaligned_frame_raises(spark):
    df = spark.createDataFrame([('{"n": 3, "k": ["a", "b", "c"], "v": [1, 2]}',)], "payload string")
    with pytest.raises(Exception, match="misaligned"):
        nested.columnar_frame(df, "payload", {"k": "string", "v": "int"}).collect()


def test_columnar_payload_rounds_and_keeps_nulls(spark):
    df = spark.createDataFrame([("NY", "a", 45.3, True), ("NY", "b", None, False)], "s string, k string, p double, f boolean")
    assert sink.columnar_records(df, "s", "k", ["p", "f"]).first().payload == '{"n":2,"k":["a","b"],"p":[45,null],"f":[1,0]}'


def test_large_parts_are_cut_into_chunks(spark):
    df = spark.range(1000).select(F.lit("x").alias("s"), F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("p"))
    rows = sink.columnar_records(df, "s", "k", ["p"], chunk=100).collect()
    assert len(rows) > 5 and sum(r.n for r in rows) == 1000


def test_dictionary_flags_unknown_columns(spark):
    entries = spark.createDataFrame([("a", "score", "A")], "column string, group string, description string")
    rows = {r.column: (r.group, r.non_null) for r in sink.data_dictionary(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), entries).collect()}
    assert rows == {"a": ("score", 2), "b": ("undocumented", 1)}


MATRIX = '''"Table title, with comma"
Data selected in addition to,x
Year,2014,,2015
Zip / ZCTA,Count,Note,Count
63101,"1,002",n,*
63102,0,,S
TOTAL,9,,9
'''


def test_matrix_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(MATRIX)
    out = {(r.key, r.year): (r["count"], r.censored) for r in tabular.read_matrix_export(spark, str(tmp_path)).collect()}
    assert out == {("63101", 2014): (1002.0, False), ("63101", 2015): (None, True), ("63102", 2014): (0.0, False), ("63102", 2015): (None, True)}


def test_mixed_definitions_are_refused(spark):
    df = spark.createDataFrame([("old", 1), ("new", 2)], "g string, v int")
    with pytest.raises(ValueError):
        agg.require_one_definition(df, "g")
    assert agg.require_one_definition(df, "g", only="old").count() == 1
    assert agg.require_one_definition(df, "g", allow_mixed=True).count() == 2


def test_missing_required_stage_is_fatal(spark):
    u = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        joins.universe_left_join(u, "k", {"supply": None}, {})


def test_corrupted_table_is_rejected(spark):
    df = spark.createDataFrame([("1", 120.0), ("1", 50.0)], "k string, p double")
    checks = quality.ranges(df, {"p": (0.0, 100.0)})
    with pytest.raises(ValueError):
        quality.require(checks, ~F.col("ok"), "range")
    dup = [r.n_bad for r in quality.logic(df, "k", {"none": F.lit(False)}).collect() if r.rule == "duplicate_key"]
    assert dup == [1]


def test_ranking_refuses_empty_limits_and_unknown_metrics(spark):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        serve.rankings(df, "k", "k", [], set(), limit=0)
    with pytest.raises(ValueError):
        serve.rankings(df, "k", "k", [], set(), metrics={"score"})


def test_malformed_rows_do_not_hang_on_the_kept_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12\n")
    for keep in (["a"], ["a", "b", "c"], ["c"]):
        got = tabular.read_text_csv(spark, str(tmp_path), ["a", "b", "c"], keep).collect()
        assert [r[0] for r in got] == [{"a": "1", "c": "3"}[keep[0]], {"a": "10", "c": "12"}[keep[0]]]


def test_overlapping_bands_pair_once_per_set_and_full_sets_are_refused(spark):
    rng = np.random.default_rng(10)
    lo = rng.uniform(0, 30, 46)
    hi = lo + rng.exponential(6, 46)
    sets = [(i // 4, i) for i in range(40)] + [(99, i) for i in range(40, 46)]
    bands = spark.createDataFrame([(i, float(lo[i]), float(hi[i])) for i in range(46)], "k int, lo double, hi double")
    out = joins.overlap_pairs(spark.createDataFrame(sets, "s int, k int"), bands, "s", "k", "lo", "hi")
    want = [(i // 4, i, j) for i in range(40) for j in range(i + 1, 40) if i // 4 == j // 4 and lo[i] <= hi[j] and lo[j] <= hi[i]]
    assert sorted(tuple(r)[:3] for r in out.where("status = 'tied'").collect()) == want
    assert [tuple(r) for r in out.where("status <> 'tied'").collect()] == [(99, None, None, "refused")]


def test_stage_uses_the_named_folder(spark, tmp_path, monkeypatch):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: f"{tmp_path}/"))
    assert shared_dir(named) == str(tmp_path)
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    assert session.stage(spark.range(5), "t").count() == 5
    assert list((tmp_path / "stages").iterdir())


@pytest.mark.parametrize("limits", [{}, {"HEAVY_ROWS": 4, "RANK_BUCKET_ROWS": 40}, {"HEAVY_ROWS": 1, "MATRIX_BYTES": 0}])
def test_reranked_replicates_match_repeated_rows(spark, monkeypatch, limits):
    """Also with values that are split over their blocks, many buckets, and counts too large to send to every task."""
    from zonometry.operators import resample

    for name, value in limits.items():
        monkeypatch.setattr(resample, name, value)
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"block": [f"b{i}" for i in rng.integers(0, 15, n)], "x": rng.integers(0, 60, n) * 1.5, "y": rng.normal(size=n), "o": rng.normal(size=n)})
    pdf.loc[::7, "x"] = np.nan
    pdf.loc[::11, "o"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "block string, x double, y double, o double")
    times = resample.draw_counts(resample.block_index(df, "block"), "block", 12, 5)
    got = resample.ranked_replicates(df, times, "block", {"x": F.col("x"), "y": 50 + 10 * F.col("y")}, ["o"], 10).toPandas()
    drawn = times.toPandas()
    assert len(got) == 2 * 13
    for row in got.itertuples():
        t = drawn[drawn.replicate == row.replicate].set_index("block").times
        rep = pdf.loc[pdf.index.repeat(pdf.block.map(t).fillna(0).astype(int))]
        rep = rep[rep[row.variant].notna()]
        rank, known = rep[row.variant].round(9).rank(), rep.o.notna()
        assert abs(row.r - np.corrcoef(rank[known], rep.o[known])[0, 1]) < 1e-9 and row.n == known.sum()


def test_a_value_on_a_third_of_the_rows_is_split(spark, monkeypatch):
    """Every row a block of its own, a third of them tied: no group holds more than the stated rows."""
    from zonometry.operators import resample

    n = 6000
    df = spark.range(n).select(F.concat(F.lit("s"), "id").alias("block"), F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") / n * 100).alias("x"), F.rand(1).alias("o"))
    times = resample.draw_counts(resample.block_index(df, "block"), "block", 3, 5)
    seen = []
    keep = resample.stage
    monkeypatch.setattr(resample, "stage", lambda d, name, *a: seen.append((name, keep(d, name, *a))) or seen[-1][1])
    monkeypatch.setattr(resample, "HEAVY_ROWS", 200)
    monkeypatch.setattr(resample, "RANK_BUCKET_ROWS", 500)
    got = resample.ranked_replicates(df, times, "block", {"x": F.col("x")}, ["o"], 10).toPandas()
    tables = dict(seen)
    assert [tuple(r) for r in tables["heavy-values"].select("v", "salts").collect()] == [(50.0, 10)]
    assert tables["value-buckets"].groupBy("bucket").count().agg(F.max("count")).first()[0] <= 1500
    pdf, drawn = df.toPandas(), times.toPandas()
    for row in got.itertuples():
        t = drawn[drawn.replicate == row.replicate].set_index("block").times
        rep = pdf.loc[pdf.index.repeat(pdf.block.map(t).fillna(0).astype(int))]
        assert abs(row.r - np.corrcoef(rep.x.round(9).rank(), rep.o)[0, 1]) < 1e-9


def test_paired_replicates_match_repeated_rows(spark):
    from zonometry.operators import resample

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"block": rng.integers(0, 9, 300).astype(str), "a": rng.normal(size=300), "b": rng.normal(size=300), "o": rng.normal(size=300)})
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "block string, a double, b double, o double")
    drawn = resample.draw_counts(resample.block_index(df, "block"), "block", 5, 2).toPandas()
    got = resample.paired_replicates(df, ["a", "b"], ["o"], "block", 5, 2, 10).toPandas()
    assert len(got) == 12
    for row in got.itertuples():
        t = drawn[drawn.replicate == row.replicate].set_index("block").times
        rep = pdf.loc[pdf.index.repeat(pdf.block.map(t).fillna(0).astype(int))].dropna(subset=[row.x])
        assert abs(row.r - np.corrcoef(rep[row.x], rep.o)[0, 1]) < 1e-9


def test_split_half_matches_means_of_halves(spark):
    from zonometry.operators import resample

    rng = np.random.default_rng(4)
    items = list("abcde")
    rows = [(i, c, float(rng.uniform(0, 100))) for i in range(80) for c in items if rng.uniform() < 0.8]
    df = spark.createDataFrame(rows, "k int, item string, v double")
    got = resample.split_half(df, "k", "item", "v", items, 6, 9).toPandas().set_index("split").r
    half = resample.split_assignment(items, 6, 9, spark).toPandas()
    wide = pd.DataFrame(rows, columns=["k", "item", "v"]).pivot(index="k", columns="item", values="v")
    for s in range(6):
        h = half[half.split == s].set_index("item").half
        a, b = wide[[c for c in items if h[c] == 0]].mean(axis=1), wide[[c for c in items if h[c] == 1]].mean(axis=1)
        assert abs(got[s] - a.corr(b)) < 1e-9


def test_between_variance_solves_its_equation_in_one_scan(spark):
    from zonometry.operators import smallarea

    rng = np.random.default_rng(5)
    rows = [(g, float(rng.normal(0.2, 0.03 * k)), float(np.exp(rng.normal(-8, 2)))) for k, g in enumerate(["none", "some", "more"]) for _ in range(400)] + [("few", 0.1, 0.01)] * 3
    df = spark.createDataFrame(rows, "g string, r double, s2 double")
    got = {x.g: x for x in smallarea.between_variance(df, ["g"]).collect()}
    assert set(got) == {"none", "some", "more"} and got["more"].tau2 > got["some"].tau2
    for g, x in got.items():
        r, s2 = np.array([(a, b) for k, a, b in rows if k == g]).T
        w = 1 / (x.tau2 + s2)
        assert x.m == pytest.approx((w * r).sum() / w.sum(), rel=1e-12)
        left = (w * (r - x.m) ** 2).sum() - (len(r) - 1)
        assert abs(x.residual) < 1e-10 and (abs(left) < 1e-6 if x.tau2 else left <= 0)
    text = smallarea.between_variance(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text


def test_nonneg_ls_with_many_predictors_meets_its_conditions():
    import time

    from zonometry.operators import stats

    rng = np.random.default_rng(12)
    start = time.time()
    for _ in range(20):
        x = rng.normal(size=(200, 20)) + rng.normal(size=(200, 1))
        y = x @ rng.normal(size=20) + rng.normal(size=200)
        b = stats.nonneg_ls(x.T @ x, x.T @ y)
        slope = x.T @ (y - x @ b)
        assert (b >= 0).all() and np.abs(slope[b > 0]).max(initial=0) < 1e-6 and slope[b == 0].max(initial=0) < 1e-6
    assert time.time() - start < 5 and (stats.nonneg_ls(np.eye(3), -np.ones(3)) == 0).all()


def test_dictionary_has_an_entry_for_every_column_of_the_model(spark):
    from catalog import roles
    from zonometry.sinks import tables as sink

    entries = sink.model_entries(roles.MODEL, {"area": ("identifier", "Area code", "")})
    names = [e[0] for e in entries]
    assert len(set(names)) == len(names)
    assert {m.column for _, m in roles.MODEL.measures} | set(roles.MODEL.sub_cols) | set(roles.MODEL.dim_cols) | {"area"} <= set(names)
    turned = {e[0]: e[4] for e in entries}
    assert turned["m_price"] != turned["m_orders"] and all(e[4] for e in entries if e[1].startswith("measure"))
