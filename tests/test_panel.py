"""Panel estimators: planted effects and row-by-row references."""

import numpy as np
import pandas as pd
import pytest

from zonometry.operators import panel as pn
from zonometry.operators.resample import block_index, draw_counts
from zonometry.plans import event_study as es


def staggered(n=160, effect=-50.0, trend=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        state = "NY" if i % 2 else "TX"
        cohort = [2012, 2014, 2015, None][i % 4] if i % 8 < 5 else None
        base, pop = rng.normal(1000, 80), rng.uniform(1500, 9000)
        for y in range(2008, 2019):
            r = base + 4 * (y - 2008) + trend * (y - 2008) * (cohort is not None) + rng.normal(0, 15)
            rows.append((f"u{i:03d}", y, float(r + effect * (cohort is not None and y >= cohort)), state, float(pop), cohort))
    return pd.DataFrame(rows, columns=["u", "year", "rate", "state", "pop", "cohort"])


def load(spark, pdf):
    rows = [(r.u, int(r.year), r.rate, r.state, r.pop, None if pd.isna(r.cohort) else int(r.cohort)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "u string, year int, rate double, state string, pop double, cohort int")


def wmean(v, w):
    return float(np.average(v, weights=w))


def covariates(y, base, t, pop):
    window = [c for c in y.columns if c < min(base, t)]
    cols = [np.log(pop)]
    w = y[window].to_numpy(float) if window else np.full((len(y), 0), np.nan)
    n = np.isfinite(w).sum(1)
    level = np.array([np.nanmean(r) if k else np.nan for r, k in zip(w, n)])
    slope = np.full(len(y), np.nan)
    if len(window) >= 3:
        for i, r in enumerate(w):
            ok = np.isfinite(r)
            if ok.sum() >= 3:
                slope[i] = np.polyfit(np.array(window, float)[ok], r[ok], 1)[0]
    return np.column_stack(cols + [level, slope])


def fitted(z, y, w, pen):
    """Ridge logistic coefficients by Newton steps that are halved until the likelihood rises."""
    def value(b):
        return -(w * (np.logaddexp(0, -(z @ b)) + (1 - y) * (z @ b))).sum() - 0.5 * b @ pen @ b

    b = np.zeros(z.shape[1])
    for _ in range(300):
        p = np.exp(-np.logaddexp(0, -(z @ b)))
        move = np.linalg.solve(z.T @ (z * (w * p * (1 - p) + 1e-12)[:, None]) + pen, z.T @ (w * (y - p)) - pen @ b)
        scale = 1.0
        while value(b + scale * move) < value(b) and scale > 1e-12:
            scale /= 2
        b = b + scale * move
        if np.abs(scale * move).max() < 1e-10 * max(1, np.abs(b).max()):
            break
    return b


def cell(dy, x, tr, co, w, halved=False):
    idx = tr | co
    mu, sd = np.nanmean(x[idx], 0), np.nanstd(x[idx], 0)
    sd = np.where(~np.isfinite(sd) | (sd < 1e-9), 1, sd)
    z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mu) / sd)])
    k = z.shape[1]
    wc = w * co
    m0 = z @ np.linalg.solve(z.T @ (z * wc[:, None]) + 1e-6 * np.eye(k), z.T @ (wc * dy))
    b, pen = np.zeros(k), np.diag([0.0] + [1e-3] * (k - 1))
    zi, yi, wi = z[idx], tr[idx].astype(float), w[idx]
    for _ in range(0 if halved else 40):
        p = 1 / (1 + np.exp(-np.clip(zi @ b, -30, 30)))
        h = zi.T @ (zi * (wi * p * (1 - p) + 1e-12)[:, None]) + pen
        b = b + np.linalg.solve(h, zi.T @ (wi * (yi - p)) - pen @ b)
    b = fitted(zi, yi, wi, pen) if halved else b
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-6, 0.95)
    e = dy - m0
    return wmean(e[tr], w[tr]) - wmean(e[co], (w * p / (1 - p))[co])


def reference(pdf, weighted, dr, halved=False):
    out = {}
    for st, js in pdf.groupby("state"):
        y = js.pivot_table(index="u", columns="year", values="rate")
        first = js.groupby("u").first().reindex(y.index)
        pop, coh = first["pop"].to_numpy(float), first["cohort"].fillna(np.inf).to_numpy(float)
        w = pop if weighted else np.ones(len(y))
        for g in sorted({c for c in coh if np.isfinite(c)}):
            for t in y.columns:
                if t == g - 1 or g - 1 not in y.columns:
                    continue
                dy = (y[t] - y[g - 1]).to_numpy(float)
                tr, co = (coh == g) & np.isfinite(dy), (coh > max(t, g)) & np.isfinite(dy)
                if tr.sum() < 1 or co.sum() < 2:
                    continue
                if dr and tr.sum() >= 3:
                    out[st, g, t] = cell(np.nan_to_num(dy), covariates(y, g - 1, t, pop), tr, co, w, halved)
                else:
                    out[st, g, t] = wmean(dy[tr], w[tr]) - wmean(dy[co], w[co])
    return out


@pytest.mark.parametrize("weight", [None, "pop"])
def test_group_time_effects_match_row_reference(spark, weight):
    pdf = staggered().sample(frac=0.95, random_state=1)
    got = {(r.state, r.g, r.t): r.att for r in pn.att_gt(load(spark, pdf), "u", "year", "rate", "state", "cohort", weight).collect()}
    want = reference(pdf, weight is not None, False)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


def test_doubly_robust_matches_row_reference(spark):
    pdf = staggered(80, seed=2).sample(frac=0.95, random_state=1)
    rows = pn.att_gt_dr(load(spark, pdf), "u", "year", "rate", "state", "cohort", "pop").collect()
    got = {(r.state, r.g, r.t): r.att for r in rows}
    want = reference(pdf, False, True)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-4)


@pytest.mark.parametrize("turns", [64 << 20, 20_000], ids=["at once", "in turns"])
def test_doubly_robust_replicates_match_refits_on_copies(spark, monkeypatch, turns):
    monkeypatch.setattr(pn, "DR_BYTES", turns)
    pdf = staggered(64, seed=2).sample(frac=0.95, random_state=1)
    pdf["block"] = "b" + (pdf.u.str[1:].astype(int) // 3).astype(str)
    df = load(spark, pdf).join(spark.createDataFrame(pdf[["u", "block"]].drop_duplicates()), "u")
    times = draw_counts(block_index(df, "block"), "block", 3, 7)
    got = {(r.replicate, r.state, r.g, r.t): r.att for r in pn.att_gt_dr_replicates(df, times, "block", "u", "year", "rate", "state", "cohort", "pop", "pop").collect()}
    drawn = times.toPandas()
    for rep in range(-1, 3):
        t = drawn[drawn.replicate == rep].set_index("block").times
        copies = pd.concat([g.assign(u=g.u + f"_{i}") for b, g in pdf.groupby("block") for i in range(int(t.get(b, 0)))])
        want = reference(copies, True, True)
        own = {k[1:]: v for k, v in got.items() if k[0] == rep}
        assert own.keys() == want.keys()
        for k in want:
            assert own[k] == pytest.approx(want[k], abs=2e-4)


def test_registered_intervals_of_the_doubly_robust_effect(spark):
    """The first replicates of the registered query against refits on copied rows; its rows against the quantiles of all."""
    from catalog import panels, resampling

    sf = "/root/testdata/sf0.01"
    every = panels.dr_boot(spark, sf).toPandas()
    pdf = panels.built(spark, sf).join(panels.R.panel_stage(spark, sf).select("unit", "county").distinct(), "unit").toPandas().rename(columns={"unit": "u"})
    for kind in ("u", "county"):
        df = spark.createDataFrame(pdf[["u", "county"]].drop_duplicates()).selectExpr(f"{kind} AS block").distinct()
        drawn = draw_counts(block_index(df, "block"), "block", panels.DR_REPS, resampling.SEED).where("replicate < 2").toPandas()
        own = every[every.block == ("unit" if kind == "u" else kind)].set_index("replicate").v
        for rep in (-1, 0, 1):
            t = drawn[drawn.replicate == rep].set_index("block").times
            copies = pd.concat([g.assign(u=g.u + f"_{i}") for b, g in pdf.groupby(kind) for i in range(int(t.get(b, 0)))])
            cells = reference(copies, True, True, halved=True)
            post = {k: v for k, v in cells.items() if k[2] >= k[1]}
            w = [treated(copies, *k) for k in post]
            assert own[rep] == pytest.approx(np.average(list(post.values()), weights=w), rel=1e-3)
    rows = {r.block: r for r in panels.QUERIES["att_dr_bootstrap"](spark, sf).collect()}
    for kind, r in rows.items():
        v = every[(every.block == kind) & (every.replicate >= 0)].v
        assert r.point == pytest.approx(every[(every.block == kind) & (every.replicate == -1)].v.iloc[0], abs=1e-3)
        np.testing.assert_allclose([r.ci_lo, r.ci_hi], np.quantile(v, [0.025, 0.975]), atol=1e-3)


def treated(pdf, state, g, t):
    """Treated units of a cell with a change since the base period."""
    own = pdf[(pdf.state == state) & (pdf.cohort == g)].pivot_table(index="u", columns="year", values="rate")
    return int((own[t] - own[g - 1]).notna().sum())


def test_planted_effect_and_no_effect(spark):
    a = pn.att_gt(load(spark, staggered()), "u", "year", "rate", "state", "cohort")
    row = es.event_summary(a, "state").first()
    assert abs(row.overall_att + 50) < 12 and row.pre_rms < 12
    b = pn.att_gt(load(spark, staggered(effect=0.0, seed=3)), "u", "year", "rate", "state", "cohort")
    assert abs(pn.overall_att(b).first().overall_att) < 8


def test_placebo_in_time_finds_a_siting_trend(spark):
    p = es.placebo_in_time(load(spark, staggered(effect=0.0, trend=10.0)), "cohort", "year")
    assert pn.overall_att(pn.att_gt(p, "u", "year", "rate", "state", "cohort")).first().overall_att > 5


def barrier_panel(spark, effect, pre=0.0, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(80):
        b, base, st = rng.normal(), rng.normal(1000, 50), "NY" if i % 2 else "TX"
        for y in range(2010, 2018):
            r = base + 3 * y + b * (effect * (y >= 2014) * (st == "NY") + pre * (y - 2013) * (y < 2014)) + rng.normal(0, 4)
            rows.append((f"u{i}", y, float(r), float(b), st))
    return spark.createDataFrame(rows, "u string, year int, rate double, b double, state string")


def test_event_study_and_did_recover_the_plant(spark):
    p = barrier_panel(spark, -20.0)
    ny = p.where("state = 'NY'")
    assert pn.did_coef(ny, "u", "year", "rate", "b", 2014).first().did == pytest.approx(-20, abs=2)
    path = {r.period: r.beta for r in pn.event_study(ny, "u", "year", "rate", "b", list(range(2010, 2018)), 2013).collect()}
    assert all(abs(path[y]) < 4 for y in (2010, 2011, 2012)) and all(abs(path[y] + 20) < 4 for y in range(2014, 2018))


@pytest.mark.parametrize("levels", [2048, 0], ids=["matrix", "gradients"])
def test_two_factor_residuals_equal_dummy_regression(spark, monkeypatch, levels):
    """Unbalanced, factors not nested, units that share one period only; alternating means would take long."""
    monkeypatch.setattr(pn, "LEVELS", levels)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"u": [f"u{i}" for i in rng.integers(0, 60, 300)], "st": rng.choice(["a", "b"], 300), "t": rng.integers(0, 9, 300), "x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf = pdf[(pdf.t < 5) | (pdf.u < "u3")].reset_index(drop=True)
    pdf["k"] = range(len(pdf))
    rows = [*pdf.itertuples(index=False, name=None), ("u1", "a", 1, None, 2.0, -1)]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]
    df = spark.createDataFrame(rows, "u string, st string, t int, x double, z double, k int")
    d = np.column_stack([pd.get_dummies(pdf.u, dtype=float), pd.get_dummies(pdf.st + pdf.t.astype(str), dtype=float)])
    want = pdf[["x", "z"]].to_numpy() - d @ np.linalg.lstsq(d, pdf[["x", "z"]].to_numpy(), rcond=None)[0]
    for first, second in ((["u"], ["st", "t"]), (["st", "t"], ["u"])):
        got = {r.k: (r.x, r.z) for r in pn.iter_demean(df, first, second, ["x", "z"]).collect()}
        assert got.pop(-1) == (None, None)
        np.testing.assert_allclose([got[i] for i in range(len(pdf))], want, atol=1e-8)


def test_panel_replicates_equal_copies_of_blocks(spark):
    """Unbalanced panel, blocks of several units: every replicate against a regression on repeated rows, without any copied row."""
    rng = np.random.default_rng(9)
    pdf = barrier_panel(spark, -5.0, seed=9).toPandas().sample(frac=0.9, random_state=2)
    pdf["block"] = "b" + (pdf.u.str[1:].astype(int) % 9).astype(str)
    df = spark.createDataFrame(pdf)
    times = draw_counts(block_index(df, "block"), "block", 4, 1)
    drawn = times.toPandas()
    did = {r.replicate: r.did for r in pn.did_replicates(df, times, "block", "u", "year", "rate", "b", 2014).collect()}
    path = {(r.replicate, r.period): r.beta for r in pn.event_replicates(df, times, "block", "u", "year", "rate", "b", list(range(2010, 2018)), 2013).collect()}
    assert len(did) == 5 and len(path) == 35
    for rep in range(-1, 4):
        t = drawn[drawn.replicate == rep].set_index("block").times
        copies = pd.concat([g.assign(u=g.u + f"_{i}") for b, g in pdf.groupby("block") for i in range(int(t.get(b, 0)))])

        def within(v):
            return v - v.groupby(copies.u).transform("mean") - v.groupby(copies.year).transform("mean") + v.mean()

        copies = copies.reset_index(drop=True)
        y, x = within(copies.rate), within(copies.b * (copies.year >= 2014))
        assert did[rep] == pytest.approx((x * y).sum() / (x * x).sum(), rel=1e-8)
        xs = np.column_stack([within(copies.b * (copies.year == p)) for p in range(2010, 2018) if p != 2013])
        want = np.linalg.lstsq(xs, y.to_numpy(), rcond=None)[0]
        np.testing.assert_allclose([path[rep, p] for p in range(2010, 2018) if p != 2013], want, rtol=1e-6)
    text = pn.did_replicates(df, times, "block", "u", "year", "rate", "b", 2014)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text  # nothing is exploded per replicate


def test_triple_difference_equals_dummy_regression(spark):
    p = barrier_panel(spark, -20.0)
    pdf = p.toPandas()
    pdf["bp"] = pdf["b"] * (pdf["year"] >= 2014)
    pdf["bpt"] = pdf["bp"] * (pdf["state"] == "NY")
    x = pd.concat([pdf[["bp", "bpt"]], pd.get_dummies(pdf["u"], dtype=float),
                   pd.get_dummies(pdf["state"] + pdf["year"].astype(str), dtype=float)], axis=1).to_numpy()
    want = np.linalg.lstsq(x, pdf["rate"].to_numpy(), rcond=None)[0][:2]
    row = pn.triple_diff(p, "u", "year", "state", "rate", "b", 2014, "NY").first()
    np.testing.assert_allclose([row.bp, row.bpt], want, atol=1e-6)


@pytest.mark.parametrize("pre,passes", [(0.0, True), (6.0, False)])
def test_pre_trend_test(spark, pre, passes):
    p = barrier_panel(spark, -20.0, pre, seed=5).withColumnRenamed("u", "unit")
    blocks = p.selectExpr("unit as block").distinct()
    times = draw_counts(block_index(blocks, "block"), "block", 60, 1)
    row = es.pre_trend_wald(p.selectExpr("*", "unit as block"), times, "block", "unit", "year", "rate", "b", list(range(2010, 2018)), 2013, 2014).first()
    assert row.df == 3 and row.passes is passes
