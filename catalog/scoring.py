"""Catchments, shrinkage, the scoring hierarchy, composites, lenses, rank bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.joins import HAVERSINE
from catalog.registry import Section
from catalog.roles import AREAS_SQL, DIMS, MODEL, SCORED_SQL, pct_sql, with_sql
from catalog.columns import DRIVER_CTE, _PARTS
from zonometry.operators import catchment, smallarea
from zonometry.operators.rank import with_percentile
from zonometry.operators.stats import ols_residual
from zonometry.plans import score as scoring
from zonometry.plans import uncertainty as unc
from zonometry.session import stage

S = Section()
_PCTS = [*DIMS, "pctile", "mult_pctile", "resid_pctile", "pctile_within_state", *R.SUBS]


@S.query("scored_table", with_sql(SCORED_SQL) + "SELECT area, scoreable, n_dims_scored, tier, low_confidence, institutional, score, mult, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _PCTS) + " FROM scored")
def scored_table(spark, sf):
    return R.scored_build(spark, sf).select(
        "area", "scoreable", "n_dims_scored", "tier", "low_confidence", "institutional",
        "score", "mult", *[F.round(c, 6).alias(c) for c in _PCTS])


# ---- catchments ------------------------------------------------------------------------------

_SUPPLY = ["providers_primary", "n_orders"]
_D = HAVERSINE.format(a="a", b="b")
CATCH_SQL = AREAS_SQL + f""",
pts AS (SELECT area, lat, lon, coalesce(population, 0.0) AS pop, providers_primary, n_orders FROM areas),
edge AS (SELECT a.area AS i, b.area AS j, {_D} AS d FROM pts a, pts b)
"""
ADAPTIVE_SQL = CATCH_SQL + """,
nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS idx FROM edge),
near AS (SELECT * FROM nn WHERE idx < 400),
sig AS (SELECT i, greatest(8.0, least(60.0, max(d))) AS sigma FROM near WHERE idx <= 30 GROUP BY 1),
w AS (SELECT n.i, n.j, exp(-0.5 * pow(d / sj.sigma, 2)) AS w1, exp(-0.5 * pow(d / si.sigma, 2)) AS w2
  FROM near n JOIN sig si ON si.i = n.i JOIN sig sj ON sj.i = n.j),
pool AS (SELECT w.i, sum(pop * w1) AS pooled FROM w JOIN pts ON area = j GROUP BY 1)
"""
FIXED_SQL = CATCH_SQL + """,
w AS (SELECT i, j, exp(-0.5 * pow(d / 8.0, 2)) AS w1, exp(-0.5 * pow(d / 8.0, 2)) AS w2 FROM edge WHERE d <= 16.0),
pool AS (SELECT w.i, sum(pop * w1) AS pooled FROM w JOIN pts ON area = j GROUP BY 1)
"""


def _access(scale: str) -> str:
    return ", ".join(
        f"sum(CASE WHEN pooled > 0 THEN {c} / pooled ELSE 0.0 END * w2){scale} AS {c}" for c in _SUPPLY)


@S.query("e2sfca_adaptive", with_sql(ADAPTIVE_SQL, f"acc AS (SELECT w.i AS area, {_access(' * 1000.0')} FROM w JOIN pool ON pool.i = w.j JOIN pts ON pts.area = w.j GROUP BY 1)")
         + "SELECT area, " + ", ".join(f"round({c}, 8) AS {c}" for c in _SUPPLY) + ", (SELECT count(*) >= 400 AND max(d) < 3 * max(sigma) FROM near JOIN sig USING (i) WHERE i = area) AS cut FROM acc")
def e2sfca_adaptive(spark, sf):
    pts = R.area_stage(spark, sf).withColumn("pop", F.coalesce("population", F.lit(0.0)))
    out = catchment.adaptive_access(pts.select("area", "lat", "lon", "pop", *_SUPPLY), "area", _SUPPLY, "pop", neighbours=400)
    return out.select("area", *[F.round(c, 8).alias(c) for c in _SUPPLY], "cut")


KERNEL_SQL = CATCH_SQL + """,
nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS idx FROM edge),
sig AS (SELECT i, greatest(8.0, least(60.0, max(d))) AS sigma FROM nn WHERE idx <= 30 GROUP BY 1),
w AS (SELECT e.i, e.j, exp(-0.5 * pow(d / sigma, 2)) AS w FROM edge e JOIN sig ON sig.i = e.i WHERE d <= 3 * sigma),
pool AS (SELECT j, sum(pop * w) AS pooled FROM w JOIN pts ON area = i GROUP BY 1)
"""
_KERNEL = ", ".join(f"1000.0 * sum(CASE WHEN pooled > 0 THEN {c} / pooled ELSE 0.0 END * w) AS {c}" for c in _SUPPLY)


@S.query("e2sfca_kernel", with_sql(KERNEL_SQL, f"acc AS (SELECT w.i AS area, {_KERNEL} FROM w JOIN pool USING (j) JOIN pts ON pts.area = w.j GROUP BY 1)")
         + "SELECT area, " + ", ".join(f"round({c}, 8) AS {c}" for c in _SUPPLY) + " FROM acc")
def e2sfca_kernel(spark, sf):
    pts = R.area_stage(spark, sf).withColumn("pop", F.coalesce("population", F.lit(0.0)))
    out = catchment.kernel_access(pts.select("area", "lat", "lon", "pop", *_SUPPLY), "area", _SUPPLY, "pop")
    return out.select("area", *[F.round(c, 8).alias(c) for c in _SUPPLY])


_FIXED_ACC = f"acc AS (SELECT w.i AS area, {_access('')} FROM w JOIN pool ON pool.i = w.j JOIN pts ON pts.area = w.j GROUP BY 1)"


def _fixed(spark, sf):
    pts = R.area_stage(spark, sf).withColumn("pop", F.coalesce("population", F.lit(0.0)))
    pts = pts.select("area", "lat", "lon", "pop", *_SUPPLY)
    return pts, catchment.fixed_access(pts, "area", _SUPPLY, "pop")


@S.query("e2sfca_fixed", with_sql(FIXED_SQL, _FIXED_ACC) + "SELECT area, " + ", ".join(f"round({c}, 11) AS {c}" for c in _SUPPLY) + " FROM acc")
def e2sfca_fixed(spark, sf):
    _, acc = _fixed(spark, sf)
    return acc.select("area", *[F.round(c, 11).alias(c) for c in _SUPPLY])


@S.query("shortage_flag", with_sql(FIXED_SQL, _FIXED_ACC) + """SELECT pts.area, round(CASE WHEN a.providers_primary > 0 THEN 1.0 / a.providers_primary END, 5) AS people_per_provider,
  pop > 0 AND coalesce(CASE WHEN a.providers_primary > 0 THEN 1.0 / a.providers_primary END > 3500, true) AS shortage FROM pts LEFT JOIN acc a USING (area)""")
def shortage_flag(spark, sf):
    pts, acc = _fixed(spark, sf)
    out = catchment.shortage(acc, pts, "area", "providers_primary", "pop")
    return out.withColumn("people_per_provider", F.round("people_per_provider", 5))


# ---- small areas -----------------------------------------------------------------------------

GROUP_SQL = """
grp AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY county_fips) >= 55 THEN 'CO:' || county_fips ELSE 'ST:' || coalesce(state, '?') END AS g FROM areas)
"""
SHRINK_SQL = AREAS_SQL + "," + GROUP_SQL + """,
ob AS (SELECT area, g, 'rate' AS k, rate AS r, rate_se * rate_se AS s2 FROM grp WHERE rate IS NOT NULL AND rate_se > 0
  UNION ALL SELECT area, g, 'rate2', rate2, rate2_se * rate2_se FROM grp WHERE rate2 IS NOT NULL AND rate2_se > 0),
sz AS (SELECT g, k, count(*) AS n, greatest(1e-8, var_pop(r) * 10 + max(s2)) AS top FROM ob GROUP BY 1, 2 HAVING count(*) >= 5),
lim0 AS (SELECT g, k, n, 0.0 AS lo, top AS hi FROM sz)""" + "".join(f""",
c{i} AS (SELECT l.g, l.k, l.n, l.lo, l.hi, l.lo + (l.hi - l.lo) * x / 32.0 AS t FROM lim{i} l, range(0, 33) q(x)),
f{i} AS (SELECT c.g, c.k, c.n, c.t, sum(r * r / (t + s2)) - pow(sum(r / (t + s2)), 2) / sum(1 / (t + s2)) - (c.n - 1) AS f FROM c{i} c JOIN ob USING (g, k) GROUP BY 1, 2, 3, 4),
lim{i + 1} AS (SELECT g, k, n, coalesce(max(t) FILTER (WHERE f > 0), 0.0) AS lo, coalesce(min(t) FILTER (WHERE f <= 0 AND t > 0), 0.0) AS hi FROM f{i} GROUP BY 1, 2, 3)""" for i in range(9)) + """,
tau AS (SELECT g, k, CASE WHEN (SELECT f FROM f0 WHERE f0.g = lim9.g AND f0.k = lim9.k AND t = 0) <= 0 THEN 0.0 ELSE (lo + hi) / 2 END AS tau2 FROM lim9),
fit AS (SELECT g, k, tau2, sum(r / (tau2 + s2)) / sum(1 / (tau2 + s2)) AS m FROM tau JOIN ob USING (g, k) GROUP BY 1, 2, 3),
shr AS (SELECT area, g, k, r, tau2 / (tau2 + s2) * r + (1 - tau2 / (tau2 + s2)) * m AS v FROM ob JOIN fit USING (g, k)),
shrunk AS (SELECT grp.area, least(1.0, greatest(0.0, coalesce(a.v, rate))) AS rate, least(1.0, greatest(0.0, coalesce(b.v, rate2))) AS rate2, rate AS rate0, rate2 AS rate20
  FROM grp LEFT JOIN shr a ON a.area = grp.area AND a.k = 'rate' LEFT JOIN shr b ON b.area = grp.area AND b.k = 'rate2')
"""


def _grouped(spark, sf):
    return smallarea.local_group_key(R.area_stage(spark, sf), "county_fips", "state", "g", 55)


@S.query("local_group_key", with_sql(AREAS_SQL, GROUP_SQL) + "SELECT area, g FROM grp")
def local_group_key(spark, sf):
    return _grouped(spark, sf).select("area", "g")


def _shrunk(spark, sf):
    def build():
        g = stage(_grouped(spark, sf).select("area", "g", "rate", "rate_se", "rate2", "rate2_se"), "grouped")
        return smallarea.shrink(g, "area", "g", {"rate": "rate_se", "rate2": "rate2_se"})

    return R.once(spark, sf, "shrunk-stage", build)


@S.query("eb_shrink", with_sql(SHRINK_SQL) + "SELECT area, round(rate, 7) AS rate, round(rate2, 7) AS rate2 FROM shrunk WHERE rate0 IS NOT NULL")
def eb_shrink(spark, sf):
    out = _shrunk(spark, sf).where(F.col("rate").isNotNull())
    return out.select("area", F.round("rate", 7).alias("rate"), F.round("rate2", 7).alias("rate2"))


@S.query("shrink_shift_report", with_sql(SHRINK_SQL) + """SELECT 'rate' AS rate, round(avg(abs(rate - rate0)), 7) AS mean_abs_shift FROM shrunk
  UNION ALL SELECT 'rate2', round(avg(abs(rate2 - rate20)), 7) FROM shrunk""")
def shrink_shift_report(spark, sf):
    out = smallarea.shift_report(R.area_stage(spark, sf), _shrunk(spark, sf), "area", ["rate", "rate2"])
    return out.withColumn("mean_abs_shift", F.round("mean_abs_shift", 7))


# ---- hierarchy levels ------------------------------------------------------------------------

@S.query("member_percentiles", with_sql(SCORED_SQL) + "SELECT area, item, round(pctile, 6) AS pctile FROM mem")
def member_percentiles(spark, sf):
    out = scoring.member_percentiles(R.area_stage(spark, sf), "area", MODEL)
    return out.select("area", "item", F.round("pctile", 6).alias("pctile"))


def _members(spark, sf):
    return R.once(spark, sf, "member-stage", lambda: scoring.member_percentiles(R.area_stage(spark, sf), "area", MODEL).select("area", "item", "pctile"))


@S.query("subscores", with_sql(SCORED_SQL) + "SELECT area, subscore, round(pctile, 6) AS pctile FROM sub")
def subscores(spark, sf):
    out = scoring.subscores(_members(spark, sf), "area", MODEL)
    return out.select("area", "subscore", F.round("pctile", 6).alias("pctile"))


@S.query("dimensions", with_sql(SCORED_SQL) + "SELECT area, dim, round(pctile, 6) AS pctile FROM dimp")
def dimensions(spark, sf):
    subs = stage(scoring.subscores(_members(spark, sf), "area", MODEL).select("area", "subscore", "pctile"), "subs")
    out = scoring.dimensions(subs, "area", MODEL)
    return out.select("area", "dim", F.round("pctile", 6).alias("pctile"))


@S.query("lazy_column_merge", with_sql(SCORED_SQL) + "SELECT area, score, round(demand_pctile, 6) AS demand_pctile, round(unit_pctile, 6) AS unit_pctile FROM scored")
def lazy_column_merge(spark, sf):
    frame = R.scored(spark, sf).select("area", "score")
    late = scoring.spread(scoring.subscores(_members(spark, sf), "area", MODEL), "area",
                          {"demand": "demand_pctile", "unit": "unit_pctile"}, "subscore", "pctile")
    return frame.join(late, "area", "left").select("area", "score", F.round("demand_pctile", 6).alias("demand_pctile"), F.round("unit_pctile", 6).alias("unit_pctile"))


@S.query("composite_additive", with_sql(SCORED_SQL) + "SELECT area, score, n_dims_scored, round(pctile, 6) AS pctile FROM scored")
def composite_additive(spark, sf):
    df = R.scored(spark, sf).select("area", "scoreable", "n_dims_scored", *DIMS)
    df = df.withColumn("score", scoring.additive(DIMS, F.col("scoreable")))
    return with_percentile(df, "score", "p", domain=scoring.PCT).select("area", "score", "n_dims_scored", F.round("p", 6).alias("pctile"))


@S.query("composite_geometric", with_sql(SCORED_SQL) + "SELECT area, mult FROM scored")
def composite_geometric(spark, sf):
    return R.scored(spark, sf).select("area", scoring.geometric(DIMS, F.col("scoreable")).alias("mult"))


# The named weight presets.
PRESETS = {"Balanced": (35, 30, 35), "Need-focused": (55, 30, 15), "Access-focused": (20, 25, 55), "Vulnerability-focused": (25, 50, 25)}


def _reweight_sql(name, w):
    parts = list(zip(DIMS, w))
    num = " + ".join(f"coalesce({c}, 0.0) * {x}" for c, x in parts)
    den = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {x}.0 ELSE 0.0 END" for c, x in parts)
    return f"SELECT area, '{name}' AS preset, CASE WHEN scoreable THEN round(({num}) / ({den}), 9) END AS live FROM scored"


@S.query("reweight", with_sql(SCORED_SQL) + " UNION ALL ".join(_reweight_sql(n, w) for n, w in {**PRESETS, "zero": (1, 1, 1)}.items()))
def reweight(spark, sf):
    choices = {n: scoring.effective_weights(dict(zip(DIMS, map(float, w)))) for n, w in {**PRESETS, "zero": (0, 0, 0)}.items()}
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("preset"), scoring.additive(w, F.col("scoreable")).alias("live")) for n, w in choices.items()])).alias("s")
    return R.scored(spark, sf).select("area", rows).select("area", "s.*")


@S.query("contributions", with_sql(SCORED_SQL, DRIVER_CTE) + "SELECT area, " + ", ".join(
    f"round(max(CASE WHEN score IS NOT NULL THEN c END) FILTER (WHERE pos = {i}), 6) AS {c}" for i, (_, c, _) in enumerate(_PARTS)) + " FROM drv GROUP BY 1")
def contributions(spark, sf):
    parts = scoring.contributions(DIMS, F.col("score"))
    return R.scored(spark, sf).select("area", *[F.round(p, 6).alias(c) for c, p in parts.items()])


@S.query("driver_shares", with_sql(SCORED_SQL, DRIVER_CTE) + """SELECT area, label, round(100.0 * c / sum(c) OVER (PARTITION BY area), 6) AS share,
  CAST(row_number() OVER (PARTITION BY area ORDER BY c DESC, pos) AS INTEGER) AS place FROM drv WHERE score IS NOT NULL""")
def driver_shares(spark, sf):
    parts = scoring.contributions(DIMS, F.col("score"))
    ranked = F.array_sort(F.array(*[
        F.struct((-parts[c]).alias("neg"), F.lit(i).alias("pos"), F.lit(lab).alias("label")) for i, (lab, c, _) in enumerate(_PARTS)]))
    total = sum(parts.values())
    rows = R.scored(spark, sf).where(F.col("score").isNotNull()).select("area", total.alias("t"), F.posexplode(ranked).alias("i", "s"))
    return rows.select("area", "s.label", F.round(-F.col("s.neg") / F.col("t") * 100.0, 6).alias("share"), (F.col("i") + 1).alias("place"))


@S.query("residual_lens", with_sql(SCORED_SQL) + "SELECT area, round(resid_pctile, 6) AS resid_pctile FROM scored")
def residual_lens(spark, sf):
    d = list(DIMS)
    df = ols_residual(R.scored(spark, sf).select("area", *d), d[2], d[:2], "res").withColumn("res", F.round("res", 8))
    return with_percentile(stage(df, "resid"), "res", "p").select("area", F.round("p", 6).alias("resid_pctile"))


@S.query("life_expectancy_rank", with_sql(AREAS_SQL) + f"SELECT area, round({pct_sql('-o_price')}, 6) AS pctile FROM areas WHERE o_price IS NOT NULL")
def life_expectancy_rank(spark, sf):
    df = R.area_stage(spark, sf).where(F.col("o_price").isNotNull()).select("area", (-F.col("o_price")).alias("worse"))
    return with_percentile(df, "worse", "p").select("area", F.round("p", 6).alias("pctile"))


# ---- rank bands ------------------------------------------------------------------------------

# Shares of the survey and model noise that each dimension carries.
SURVEY_SHARE = {"vulnerability_pctile": 1.0, "access_pctile": 0.40}
MODEL_SHARE = {"need_pctile": 1.0, "access_pctile": 0.55, "vulnerability_pctile": 0.14}
SIGMAS = [f"sigma_{d}" for d in DIMS]
BAND_DRAWS = 300
CV_SQL = """
cvs AS (SELECT area, scoreable, low_confidence, need_pctile, vulnerability_pctile, access_pctile,
  CASE WHEN rate > 0 THEN least(2.0, rate_se / rate) END AS cv_a, CASE WHEN rate2 > 0 AND id % 6 <> 0 THEN least(2.0, rate2_se / rate2) END AS cv_b FROM scored WHERE scoreable),
mid AS (SELECT quantile_cont(cv_a, 0.5) AS fl, quantile_cont(cv_b, 0.5) AS md FROM cvs),
sgm AS (SELECT cvs.*, 36.0 * least(1.5, greatest(0.0, coalesce(cv_a, fl) - fl)) AS a, 71.0 * coalesce(cv_b, md) AS b FROM cvs, mid),
sig AS (SELECT *, sqrt(b * b) AS s0, sqrt(a * a + (0.14 * b) * (0.14 * b)) AS s1, sqrt((0.4 * a) * (0.4 * a) + (0.55 * b) * (0.55 * b)) AS s2 FROM sgm)
"""


def noisy(spark, sf):
    """Scoreable areas with their noise sigmas."""
    def build():
        df = R.scored(spark, sf).where("scoreable").select(
            "area", "low_confidence", *DIMS,
            F.when(F.col("rate") > 0, F.least(F.lit(2.0), F.col("rate_se") / F.col("rate"))).alias("cv_a"),
            F.when((F.col("rate2") > 0) & (F.col("id") % 6 != 0), F.least(F.lit(2.0), F.col("rate2_se") / F.col("rate2"))).alias("cv_b"))
        return unc.with_noise_sigma(df, "cv_a", "cv_b", SURVEY_SHARE, MODEL_SHARE)

    return R.once(spark, sf, "noisy-stage", build)


@S.query("noise_sigma", with_sql(SCORED_SQL, CV_SQL) + "SELECT area, round(s0, 7) AS sigma_need_pctile, round(s1, 7) AS sigma_vulnerability_pctile, round(s2, 7) AS sigma_access_pctile FROM sig")
def noise_sigma(spark, sf):
    return noisy(spark, sf).select("area", *[F.round(c, 7).alias(c) for c in SIGMAS])


def u_sql(dig: str, slot: int) -> str:
    return f"((CAST('0x' || substr({dig}, {1 + 8 * slot}, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def z_sql(dig: str, slot: int) -> str:
    """Standard normal ``slot`` (0..3) of a digest."""
    base, fn = 2 * (slot // 2), ("cos" if slot % 2 == 0 else "sin")
    return f"sqrt(-2.0 * ln({u_sql(dig, base)})) * {fn}(2.0 * pi() * {u_sql(dig, base + 1)})"


def band_sql(tag: str, noise: bool) -> str:
    z = [f"({z_sql('h', i)}) * s{i}" if noise else "0.0" for i in range(3)]
    d = list(DIMS)
    num = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0, least(100.0, {c} + {z[i]})) * w{i} ELSE 0.0 END" for i, c in enumerate(d))
    den = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN w{i} ELSE 0.0 END" for i, c in enumerate(d))
    return f"""
wr{tag} AS (SELECT x AS draw, 0.15 + {u_sql('hw', 0)} * 0.4 AS r0, 0.15 + {u_sql('hw', 1)} * 0.4 AS r1, 0.15 + {u_sql('hw', 2)} * 0.4 AS r2
  FROM (SELECT x, md5('0|w|' || x) AS hw FROM range(0, {BAND_DRAWS}) q(x))),
ww{tag} AS (SELECT draw, r0 / (r0 + r1 + r2) AS w0, r1 / (r0 + r1 + r2) AS w1, r2 / (r0 + r1 + r2) AS w2 FROM wr{tag}),
cp{tag} AS (SELECT area, low_confidence, draw, round(({num}) / ({den}), 9) AS comp
  FROM (SELECT *, md5('0|' || area || '|' || draw) AS h FROM sig, ww{tag})),
rk{tag} AS (SELECT area, low_confidence, {pct_sql('comp', 'draw')} AS p FROM cp{tag}),
band{tag} AS (SELECT area, low_confidence, quantile_cont(p, 0.05) AS rank_lo, quantile_cont(p, 0.95) AS rank_hi FROM rk{tag} GROUP BY 1, 2)
"""


@S.query("rank_band", with_sql(SCORED_SQL, CV_SQL, band_sql("", True)) + "SELECT area, round(rank_lo, 5) AS rank_lo, round(rank_hi, 5) AS rank_hi FROM band")
def rank_band(spark, sf):
    out = unc.rank_band(noisy(spark, sf), "area", list(DIMS), SIGMAS, BAND_DRAWS)
    return out.select("area", F.round("rank_lo", 5).alias("rank_lo"), F.round("rank_hi", 5).alias("rank_hi"))


@S.query("band_decomposition", with_sql(SCORED_SQL, CV_SQL, band_sql("a", True), band_sql("b", False)) + """
SELECT low_confidence, round(c, 4) AS combined, round(w, 4) AS weights_only, round(c - w, 4) AS measurement FROM
 (SELECT low_confidence, median(rank_hi - rank_lo) AS c FROM banda GROUP BY 1) JOIN (SELECT low_confidence, median(rank_hi - rank_lo) AS w FROM bandb GROUP BY 1) USING (low_confidence)""")
def band_decomposition(spark, sf):
    out = unc.band_decomposition(noisy(spark, sf), "area", list(DIMS), SIGMAS, "low_confidence", BAND_DRAWS)
    return out.select("low_confidence", *[F.round(c, 4).alias(c) for c in ("combined", "weights_only", "measurement")])


QUERIES, SQL = S.queries, S.sql
