"""Difference-in-differences, event studies, staggered adoption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import PANEL_SQL, with_sql
from catalog.resampling import PANEL_REPS, SEED, ci, ci_sql, did_boot, did_sql, panel_times_sql
from catalog.scoring import u_sql
from catalog.statistics import r6
from zonometry.operators import panel as pn, resample
from zonometry.plans import event_study as es
from zonometry.session import stage

S = Section()
YEARS = list(range(1995, 2002))
CAT = ("unit", "year", "rate", "state", "cohort")


@S.query("did_coef", with_sql(PANEL_SQL) + """SELECT round(sum(x * y) / sum(x * x), 5) AS did FROM (SELECT
  rate - avg(rate) OVER (PARTITION BY unit) - avg(rate) OVER (PARTITION BY year) + avg(rate) OVER () AS y,
  px - avg(px) OVER (PARTITION BY unit) - avg(px) OVER (PARTITION BY year) + avg(px) OVER () AS x FROM (SELECT *, barrier * (year >= 1998)::INT AS px FROM panel))""")
def did_coef(spark, sf):
    return r6(pn.did_coef(R.panel_stage(spark, sf), "unit", "year", "rate", "barrier", 1998), "did", n=5)


# On a balanced panel the interacted coefficient of a year is the slope of the change since the base year.
@S.query("event_study", with_sql(PANEL_SQL) + """SELECT p.year AS period, round(regr_slope(p.rate - b.rate, p.barrier), 5) AS beta FROM panel p
  JOIN panel b ON b.unit = p.unit AND b.year = 1997 WHERE p.year <> 1997 GROUP BY 1""")
def event_study(spark, sf):
    return r6(pn.event_study(R.panel_stage(spark, sf), "unit", "year", "rate", "barrier", YEARS, 1997), "beta", n=5)


_ORIGIN = panel_times_sql("unit").replace("px FROM panel p", "px, p.unit AS origin FROM panel p")
_WALD = """
bt AS (SELECT c.replicate, c.year, regr_slope(c.rate - b.rate, p.barrier) AS beta FROM cop c JOIN cop b ON b.replicate = c.replicate AND b.unit = c.unit AND b.year = 1997
  JOIN (SELECT DISTINCT unit, barrier FROM panel) p ON p.unit = c.origin WHERE c.year IN (1995, 1996) GROUP BY 1, 2),
wd AS (SELECT replicate, max(beta) FILTER (WHERE year = 1995) AS b5, max(beta) FILTER (WHERE year = 1996) AS b6 FROM bt GROUP BY 1),
cv AS (SELECT max(b5) FILTER (WHERE replicate = -1) AS m5, max(b6) FILTER (WHERE replicate = -1) AS m6, var_samp(b5) FILTER (WHERE replicate >= 0) AS v5,
  var_samp(b6) FILTER (WHERE replicate >= 0) AS v6, covar_samp(b5, b6) FILTER (WHERE replicate >= 0) AS v56 FROM wd),
st AS (SELECT (m5 * m5 * v6 - 2 * m5 * m6 * v56 + m6 * m6 * v5) / (v5 * v6 - v56 * v56) AS chi2 FROM cv)"""


def _wald(spark, sf):
    p = R.panel_stage(spark, sf).select("unit", "year", "rate", "barrier").withColumn("block", F.col("unit"))
    times = resample.draw_counts(resample.block_index(p, "block"), "block", PANEL_REPS, SEED)
    return es.pre_trend_wald(p, times, "block", "unit", "year", "rate", "barrier", YEARS, 1997, 1998)


@S.query("pre_trend_wald", with_sql(PANEL_SQL, _ORIGIN, _WALD)
         + "SELECT round(chi2, 6) AS chi2, 2 AS df, round(exp(-chi2 / 2), 7) AS p, exp(-chi2 / 2) > 0.05 AS passes FROM st")
def pre_trend_wald(spark, sf):
    return r6(r6(_wald(spark, sf), "chi2"), "p", n=7)


@S.query("temporal_verdict", with_sql(PANEL_SQL, _ORIGIN, _WALD, panel_times_sql("county", "k"), did_sql("cop", ""), did_sql("copk", "k"),
         "late AS (SELECT -1 AS replicate, unit, year, rate, barrier * (year >= 1998)::INT AS px FROM panel WHERE year <> 1995)", did_sql("late", "l"), """
q AS (SELECT 'unit' AS b, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM dd WHERE replicate >= 0 UNION ALL SELECT 'county', quantile_cont(v, 0.025), quantile_cont(v, 0.975) FROM ddk WHERE replicate >= 0),
x AS (SELECT (SELECT v FROM dd WHERE replicate = -1) AS did, (SELECT v FROM ddl) AS did_drop, (SELECT bool_and(lo > 0 OR hi < 0) FROM q) AS excludes_0, (SELECT exp(-chi2 / 2) FROM st) AS pre_p)""")
         + """SELECT round(did, 4) AS did, round(did_drop, 4) AS did_drop, excludes_0, round(pre_p, 7) AS pre_p, CASE WHEN NOT excludes_0 OR did_drop >= 0 THEN 'no credible effect'
  WHEN pre_p <= 0.05 THEN 'descriptive: pre-trends rejected' ELSE 'inconclusive' END AS verdict FROM x""")
def temporal_verdict(spark, sf):
    """An effect counts only if the intervals by unit and by county both exclude 0 and it holds without the first year."""
    panel = R.panel_stage(spark, sf)
    point = did_boot(spark, sf, "unit").where(F.col("replicate") == -1).select("did")
    drop = pn.did_coef(panel.where(F.col("year") != 1995).select("unit", "year", "rate", "barrier"), "unit", "year", "rate", "barrier", 1998).select(F.col("did").alias("did_drop"))
    sides = [resample.intervals(did_boot(spark, sf, b), "did").select("excludes_0") for b in ("unit", "county")]
    both = sides[0].unionByName(sides[1]).agg(F.bool_and("excludes_0").alias("excludes_0"))
    row = point.join(F.broadcast(drop)).join(F.broadcast(both)).join(F.broadcast(_wald(spark, sf).select(F.col("p").alias("pre_p"))))  # one row each
    out = pn.temporal_verdict(row)
    return r6(r6(out, "did", "did_drop", n=4), "pre_p", n=7)


_C = ["rate", "bp", "bpt"]


def _triple_sql() -> str:
    ctes, prev = ["tp AS (SELECT unit, state, year, rate, barrier * (year >= 1998)::INT AS bp, barrier * (year >= 1998)::INT * (state = 'ASIA')::INT AS bpt FROM panel)"], "tp"
    for i in range(12):
        for j, part in enumerate(("unit", "state, year")):
            ctes.append(f"t{i}_{j} AS (SELECT unit, state, year, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {part}) AS {c}" for c in _C) + f" FROM {prev})")
            prev = f"t{i}_{j}"
    return ", ".join(ctes)


@S.query("triple_diff", with_sql(PANEL_SQL, _triple_sql()) + """SELECT round((sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12), 4) AS bp, round((sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12), 4) AS bpt
  FROM (SELECT sum(bp * bp) AS s11, sum(bp * bpt) AS s12, sum(bpt * bpt) AS s22, sum(rate * bp) AS sy1, sum(rate * bpt) AS sy2 FROM t11_1)""")
def triple_diff(spark, sf):
    return r6(pn.triple_diff(R.panel_stage(spark, sf), "unit", "year", "state", "rate", "barrier", 1998, "ASIA"), "bp", "bpt", n=4)


@S.query("state_panel", with_sql(PANEL_SQL, """
base AS (SELECT DISTINCT unit, state, barrier FROM panel WHERE pop >= 1000),
bz AS (SELECT unit, state, (barrier - avg(barrier) OVER (PARTITION BY state)) / stddev_samp(barrier) OVER (PARTITION BY state) AS z FROM base),
tr AS (SELECT p.unit, p.year, p.rate, bz.state, z FROM panel p JOIN bz USING (unit) WHERE p.year BETWEEN 1996 AND 2000),
kp AS (SELECT * FROM tr WHERE rate > 0 AND rate < (SELECT quantile_cont(rate, 0.999) FROM tr))""") + """SELECT unit, year, rate, state, round(z, 7) AS barrier_z FROM kp
  WHERE unit IN (SELECT unit FROM kp GROUP BY 1 HAVING count(DISTINCT year) >= 4)""")
def state_panel(spark, sf):
    p = R.panel_stage(spark, sf)
    units = p.select("unit", "state", "barrier", "pop").distinct()
    out = es.state_panel(p, units, "unit", "year", "rate", "barrier", "pop", "state", list(range(1996, 2001)))
    return out.select("unit", "year", "rate", "state", F.round("barrier_z", 7).alias("barrier_z"))


OPENINGS_SQL = """
opn AS (SELECT unit, first_year BETWEEN 1997 AND 1999 AS newly_served, CASE WHEN first_year BETWEEN 1997 AND 1999 THEN first_year END AS treat_year, loose AS treat_year_loose FROM (SELECT unit,
  CAST(1994 + uid % 8 AS INTEGER) AS first_year, CASE WHEN uid % 8 BETWEEN 3 AND 5 THEN CAST(1994 + uid % 8 AS INTEGER) WHEN uid % 8 = 1 THEN 1998 END AS loose FROM (SELECT DISTINCT unit, uid FROM panel)))
"""
_COVER = """{t} AS (SELECT * FROM {r} WHERE (state, unit) IN (SELECT (state, unit) FROM (SELECT state, unit, count(DISTINCT year) AS seen FROM {r} GROUP BY 1, 2)
  JOIN (SELECT state, count(DISTINCT year) AS ny FROM {r} GROUP BY 1) USING (state) WHERE seen >= ceil(0.8 * ny)))"""
CLEAN_SQL = OPENINGS_SQL.strip() + """,
rawc AS (SELECT p.unit, p.year, p.rate, p.state, p.pop, o.treat_year AS cohort FROM panel p LEFT JOIN (SELECT * FROM opn WHERE newly_served) o USING (unit)
  WHERE p.pop >= 1000 AND p.unit NOT IN (SELECT unit FROM opn WHERE NOT newly_served AND treat_year_loose IS NOT NULL)),
""" + _COVER.format(t="clean", r="rawc") + """,
rawl AS (SELECT p.unit, p.year, p.rate, p.state, p.pop, o.treat_year_loose AS cohort FROM panel p LEFT JOIN opn o USING (unit) WHERE p.pop >= 1000),
""" + _COVER.format(t="loose", r="rawl")


def openings(spark, sf):
    u = R.panel_stage(spark, sf).select("unit", "uid").distinct()
    m = F.pmod(F.col("uid"), F.lit(8)).cast("int")
    first = F.lit(1994) + m
    newly = first.between(1997, 1999)
    loose = F.when(m.between(3, 5), first).when(m == 1, 1998)
    return u.select("unit", newly.alias("newly_served"), F.when(newly, first).alias("treat_year"), loose.alias("treat_year_loose"))


def built(spark, sf, dose="clean"):
    def build():
        p = R.panel_stage(spark, sf)
        areas = p.select("unit", "pop").distinct()
        return es.build_panel(p.select("unit", "year", "rate", "state"), openings(spark, sf), areas, "unit", "year", "rate", "state", "pop", dose)

    return R.once(spark, sf, f"built-{dose}", build)


@S.query("build_panel", with_sql(PANEL_SQL, CLEAN_SQL) + "SELECT 'clean' AS dose, unit, year, cohort FROM clean UNION ALL SELECT 'loose', unit, year, cohort FROM loose")
def build_panel(spark, sf):
    pick = lambda d: built(spark, sf, d).select(F.lit(d).alias("dose"), "unit", "year", "cohort")
    return pick("clean").unionByName(pick("loose"))


def att_sql(tag: str, src: str, weight: str = "1.0") -> str:
    return f"""
dy{tag} AS (SELECT p.unit, p.state, p.cohort, p.year AS t, b.year AS base, p.rate - b.rate AS dy, {weight} AS w FROM {src} p JOIN (SELECT unit, year, rate FROM {src}) b ON b.unit = p.unit
  AND b.year IN (SELECT DISTINCT cohort - 1 FROM {src} WHERE cohort IS NOT NULL) WHERE p.year <> b.year),
tt{tag} AS (SELECT state, cohort AS g, t, base, sum(w * dy) / sum(w) AS mt, count(*) AS n FROM dy{tag} WHERE cohort = base + 1 GROUP BY 1, 2, 3, 4),
cc{tag} AS (SELECT g.state, g.g, g.t, sum(c.w * c.dy) / sum(c.w) AS mc, count(*) AS nc FROM tt{tag} g JOIN dy{tag} c ON c.state = g.state AND c.t = g.t AND c.base = g.base
  AND (c.cohort IS NULL OR c.cohort > greatest(g.t, g.g)) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
att{tag} AS (SELECT state, g, t, t - g AS e, mt - mc AS att, n FROM tt{tag} JOIN cc{tag} USING (state, g, t))
"""


@S.query("att_gt", with_sql(PANEL_SQL, CLEAN_SQL, att_sql("", "clean", "pop")) + "SELECT state, g, t, e, round(att, 4) AS att, n FROM att")
def att_gt(spark, sf):
    return r6(pn.att_gt(built(spark, sf), "unit", "year", "rate", "state", "cohort", "pop"), "att", n=4)


def _att(spark, sf):
    return R.once(spark, sf, "att-stage", lambda: pn.att_gt(built(spark, sf), "unit", "year", "rate", "state", "cohort", "pop"))


@S.query("att_gt_dr")
def att_gt_dr(spark, sf):
    return pn.att_gt_dr(built(spark, sf), "unit", "year", "rate", "state", "cohort", "pop")


@S.query("cell_covariates", with_sql(PANEL_SQL) + """SELECT p.state, p.unit, b.before, round(avg(p.rate), 8) AS pre_level,
  round(CASE WHEN b.before - 1995 >= 3 AND count(*) >= 3 THEN regr_slope(p.rate, p.year) END, 8) AS pre_slope, count(*) AS n_obs FROM panel p JOIN (SELECT DISTINCT state, year AS before FROM panel) b
  ON b.state = p.state AND p.year < b.before GROUP BY 1, 2, 3""")
def cell_covariates(spark, sf):
    out = pn.pre_window_covariates(R.panel_stage(spark, sf), "unit", "year", "rate", "state")
    return r6(out.drop("n_window"), "pre_level", "pre_slope", n=8)


@S.query("aggregate_event", with_sql(PANEL_SQL, CLEAN_SQL, att_sql("", "clean", "pop")) + "SELECT e, round(sum(att * n) / sum(n), 4) AS att, count(DISTINCT (state, g)) AS n_cohorts, CAST(sum(n) AS BIGINT) AS n_treated FROM att GROUP BY 1 HAVING count(DISTINCT (state, g)) >= 2")
def aggregate_event(spark, sf):
    return r6(pn.aggregate_event(_att(spark, sf), "state"), "att", n=4)


@S.query("overall_att", with_sql(PANEL_SQL, CLEAN_SQL, att_sql("", "clean", "pop")) + """SELECT 'full' AS horizon, round(sum(att * n) / sum(n), 4) AS overall_att FROM att WHERE e >= 0
  UNION ALL SELECT 'capped', round(sum(att * n) / sum(n), 4) FROM att WHERE e BETWEEN 0 AND 1""")
def overall_att(spark, sf):
    a = _att(spark, sf)
    full = pn.overall_att(a).withColumn("horizon", F.lit("full"))
    return r6(full.unionByName(pn.overall_att(a, horizon=1).withColumn("horizon", F.lit("capped"))), "overall_att", n=4)


_PT = "pt AS (SELECT DISTINCT unit, 34.0 + (((uid + 977) * 7919) % 100003) / 100003.0 * 3 AS lat, -100.0 + (((uid + 1201) * 104729) % 100019) / 100019.0 * 4 AS lon FROM panel)"
_SPILL = """near AS (SELECT DISTINCT c.unit FROM (SELECT DISTINCT unit FROM clean WHERE cohort IS NULL) c JOIN pt a USING (unit), (SELECT DISTINCT unit FROM clean WHERE cohort IS NOT NULL) t JOIN pt s ON s.unit = t.unit
  WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - a.lon) / 2), 2)))) <= 10.0),
spill AS (SELECT * FROM clean WHERE unit NOT IN (SELECT unit FROM near)),
plac AS (SELECT unit, year, rate, state, pop, cohort - 3 AS cohort FROM clean WHERE cohort IS NOT NULL AND year < cohort UNION ALL SELECT unit, year, rate, state, pop, cohort FROM clean WHERE cohort IS NULL)"""
_VAR = {"headline": "clean", "spillover": "spill", "loose": "loose", "placebo": "plac"}


_ROBUST_REPS = 300


def _robust_sql(name: str, src: str) -> str:
    """One variant: treated units, overall effect and its interval with whole units drawn."""
    return f"""
ri_{name} AS (SELECT unit AS block, row_number() OVER (ORDER BY unit) - 1 AS idx FROM (SELECT DISTINCT unit FROM {src})),
rk_{name} AS (SELECT b, CAST(floor({u_sql('h', 0)} * n) AS BIGINT) AS idx, count(*) AS times FROM (SELECT b, idx, n, md5('{SEED}|' || b || '|' || idx) AS h
  FROM range(0, {_ROBUST_REPS}) r(b), ri_{name}, (SELECT count(*) AS n FROM ri_{name})) GROUP BY 1, 2),
rt_{name} AS (SELECT b AS replicate, block, times FROM rk_{name} JOIN ri_{name} USING (idx) UNION ALL SELECT -1, block, 1 FROM ri_{name}),
ry_{name} AS (SELECT replicate, p.state, p.cohort, p.year AS t, b.year AS base, sum(p.pop * (p.rate - b.rate) * times) AS sw, sum(p.pop * times) AS w, sum(times) AS n
  FROM {src} p JOIN (SELECT unit, year, rate FROM {src}) b ON b.unit = p.unit AND b.year IN (SELECT DISTINCT cohort - 1 FROM {src} WHERE cohort IS NOT NULL)
  JOIN rt_{name} ON block = p.unit WHERE p.year <> b.year GROUP BY 1, 2, 3, 4, 5),
rp_{name} AS (SELECT g.replicate, g.t - g.cohort AS e, g.n, g.sw / g.w - sum(c.sw) / sum(c.w) AS att FROM ry_{name} g JOIN ry_{name} c ON c.replicate = g.replicate AND c.state = g.state
  AND c.t = g.t AND c.base = g.base AND (c.cohort IS NULL OR c.cohort > greatest(g.t, g.cohort)) WHERE g.cohort = g.base + 1
  GROUP BY g.replicate, g.state, g.cohort, g.t, g.n, g.sw, g.w HAVING sum(c.n) >= 2),
ro_{name} AS (SELECT replicate, '{name}' AS variant, sum(att * n) / sum(n) AS v FROM rp_{name} WHERE e >= 0 GROUP BY 1)"""


@S.query("robustness_battery", with_sql(PANEL_SQL, CLEAN_SQL, _PT, _SPILL, *[_robust_sql(n, src) for n, src in _VAR.items()],
         "ra AS (" + " UNION ALL ".join(f"SELECT * FROM ro_{n}" for n in _VAR) + ")",
         "rn AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, count(DISTINCT unit) AS n_treated FROM {src} WHERE cohort IS NOT NULL" for n, src in _VAR.items()) + ")")
         + f"SELECT variant, n_treated, point AS overall_att, ci_lo, ci_hi, n_boot, excludes_0 FROM ({ci_sql('ra', 'v', 'variant', 4)}) JOIN rn USING (variant)")
def robustness_battery(spark, sf):
    """Each variant's overall effect with an interval of 300 draws of whole units."""
    clean = built(spark, sf)
    pts = R.panel_stage(spark, sf).select("unit", *R.point(F.col("uid"), 977, 1201)).distinct()
    variants = {"headline": clean, "spillover": es.drop_spillover(clean, pts, "unit", "cohort"), "loose": built(spark, sf, "loose"),
                "placebo": es.placebo_in_time(clean, "cohort", "year")}
    out = es.robustness(variants, "unit", "year", "rate", "state", "cohort", "pop", _ROBUST_REPS, SEED)
    return r6(out, "overall_att", "ci_lo", "ci_hi", n=4)


# ---- intervals of the staggered effects ------------------------------------------------------

ATT_REPS = 600


def _att_boot_sql(block: str, tag: str) -> str:
    """Overall effects, full and capped, of every replicate with whole blocks drawn."""
    return f"""
cb{tag} AS (SELECT c.*, {"unit" if block == "unit" else "county"} AS block FROM clean c JOIN (SELECT DISTINCT unit AS u, county FROM panel) ON u = unit),
ai{tag} AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS idx FROM (SELECT DISTINCT block FROM cb{tag})),
ak{tag} AS (SELECT b, CAST(floor({u_sql('h', 0)} * n) AS BIGINT) AS idx, count(*) AS times FROM (SELECT b, idx, n, md5('{SEED}|' || b || '|' || idx) AS h
  FROM range(0, {ATT_REPS}) r(b), ai{tag}, (SELECT count(*) AS n FROM ai{tag})) GROUP BY 1, 2),
at{tag} AS (SELECT b AS replicate, block, times FROM ak{tag} JOIN ai{tag} USING (idx) UNION ALL SELECT -1, block, 1 FROM ai{tag}),
ay{tag} AS (SELECT replicate, p.state, p.cohort, p.year AS t, b.year AS base, sum(p.pop * (p.rate - b.rate) * times) AS sw, sum(p.pop * times) AS w, sum(times) AS n
  FROM cb{tag} p JOIN (SELECT unit, year, rate FROM clean) b ON b.unit = p.unit AND b.year IN (SELECT DISTINCT cohort - 1 FROM clean WHERE cohort IS NOT NULL)
  JOIN at{tag} USING (block) WHERE p.year <> b.year GROUP BY 1, 2, 3, 4, 5),
ap{tag} AS (SELECT g.replicate, g.state, g.cohort, g.t - g.cohort AS e, g.n, g.sw / g.w - sum(c.sw) / sum(c.w) AS att FROM ay{tag} g JOIN ay{tag} c ON c.replicate = g.replicate AND c.state = g.state
  AND c.t = g.t AND c.base = g.base AND (c.cohort IS NULL OR c.cohort > greatest(g.t, g.cohort)) WHERE g.cohort = g.base + 1
  GROUP BY g.replicate, g.state, g.cohort, g.t, g.n, g.sw, g.w HAVING sum(c.n) >= 2),
ao{tag} AS (SELECT replicate, 'full' AS horizon, sum(att * n) / sum(n) AS v FROM ap{tag} WHERE e >= 0 GROUP BY 1
  UNION ALL SELECT replicate, 'capped', sum(att * n) / sum(n) FROM ap{tag} WHERE e BETWEEN 0 AND 1 GROUP BY 1
  UNION ALL SELECT replicate, 'e' || e, sum(att * n) / sum(n) FROM ap{tag} GROUP BY replicate, e HAVING count(DISTINCT (state, cohort)) >= 2)"""


_ATT_BOOT = (PANEL_SQL, CLEAN_SQL, _att_boot_sql("unit", "u"), _att_boot_sql("county", "c"),
             "ab AS (SELECT 'unit' AS block, * FROM aou UNION ALL SELECT 'county', * FROM aoc)")


def att_boot(spark, sf):
    """(block, horizon, replicate, v): overall effects, and the event path (horizon e-2, e-1, e0, ...), with whole units or whole counties drawn."""
    def build():
        county = R.panel_stage(spark, sf).select("unit", "county").distinct()
        clean = built(spark, sf).join(county, "unit")
        parts = []
        for kind in ("unit", "county"):
            p = clean.withColumn("block", F.col(kind))
            times = stage(resample.draw_counts(resample.block_index(p, "block"), "block", ATT_REPS, SEED), "att-times")
            att = stage(pn.att_gt(p, "unit", "year", "rate", "state", "cohort", "pop", times), "att-replicates")
            for horizon, most in (("full", None), ("capped", 1)):
                one = pn.overall_att(att, ["replicate"], most)
                parts.append(one.select(F.lit(kind).alias("block"), F.lit(horizon).alias("horizon"), "replicate", F.col("overall_att").alias("v")))
            path = pn.aggregate_event(att, "state", ["replicate"])
            parts.append(path.select(F.lit(kind).alias("block"), F.concat(F.lit("e"), "e").alias("horizon"), "replicate", F.col("att").alias("v")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    return R.once(spark, sf, "att-boot", build)


# an event time counts where a quarter of the replicates has it
@S.query("att_bootstrap", with_sql(*_ATT_BOOT) + f"SELECT * FROM ({ci_sql('ab', 'v', 'block, horizon', 4)}) WHERE n_boot >= {ATT_REPS} / 4")
def att_bootstrap(spark, sf):
    return ci(att_boot(spark, sf), "v", ["block", "horizon"], 4).where(F.col("n_boot") >= ATT_REPS / 4)


DR_REPS = 300


def dr_boot(spark, sf):
    """(block, replicate, v): the doubly-robust overall effect, refitted with whole units or whole counties drawn."""
    def build():
        county = R.panel_stage(spark, sf).select("unit", "county").distinct()
        clean = built(spark, sf).join(county, "unit")
        parts = []
        for kind in ("unit", "county"):
            p = clean.withColumn("block", F.col(kind))
            times = stage(resample.draw_counts(resample.block_index(p, "block"), "block", DR_REPS, SEED), "dr-times")
            att = pn.att_gt_dr_replicates(p, times, "block", "unit", "year", "rate", "state", "cohort", "pop", "pop")
            parts.append(pn.overall_att(att, ["replicate"]).select(F.lit(kind).alias("block"), "replicate", F.col("overall_att").alias("v")))
        return parts[0].unionByName(parts[1])

    return R.once(spark, sf, "dr-boot", build)


@S.query("att_dr_bootstrap")
def att_dr_bootstrap(spark, sf):
    """Its intervals; iterated fits of every replicate have no SQL, so tests compare them with refits on copied rows."""
    return ci(dr_boot(spark, sf), "v", ["block"], 4)


@S.query("verdict", with_sql(*_ATT_BOOT, att_sql("", "clean", "pop"), """
path AS (SELECT e, sum(att * n) / sum(n) AS a FROM att GROUP BY 1 HAVING count(DISTINCT (state, g)) >= 2),
x AS (SELECT block, horizon, max(v) FILTER (WHERE replicate = -1) AS ov, quantile_cont(v, 0.025) FILTER (WHERE replicate >= 0) AS lo, quantile_cont(v, 0.975) FILTER (WHERE replicate >= 0) AS hi,
  (SELECT sqrt(avg(a * a)) FROM path WHERE e < 0) AS rms, (SELECT count(DISTINCT unit) FROM clean WHERE cohort IS NOT NULL) AS n_treated FROM ab WHERE horizon IN ('full', 'capped') GROUP BY 1, 2)""") + """
SELECT block, horizon, pre_clean, CASE WHEN ex AND ov < 0 AND pre_clean THEN 'detected' WHEN ex AND ov < 0 THEN 'suggestive' WHEN ex AND ov > 0 THEN 'wrong-signed'
  WHEN NOT ex AND abs(ov) > 0 AND abs(CASE WHEN ov < 0 THEN hi ELSE lo END) < abs(ov) * 0.2 AND ov < 0 THEN 'borderline' ELSE 'none' END AS verdict,
  CASE WHEN n_treated >= 240 THEN 'powered' WHEN n_treated >= 110 THEN 'pilot' ELSE 'underpowered' END AS power_band
  FROM (SELECT *, lo > 0 OR hi < 0 AS ex, coalesce(abs(ov) > 0 AND rms < abs(ov) / 2, false) AS pre_clean FROM x)""")
def verdict(spark, sf):
    """The overall effect judged by its bootstrap interval, by units and by counties."""
    clean = built(spark, sf)
    boot = resample.intervals(att_boot(spark, sf).where(F.col("horizon").isin("full", "capped")), "v", ["block", "horizon"])
    pre = es.event_summary(_att(spark, sf), "state").select("pre_rms")
    size = clean.where(F.col("cohort").isNotNull()).agg(F.countDistinct("unit").alias("n_treated"))
    rows = boot.withColumnRenamed("point", "overall_att").join(F.broadcast(pre)).join(F.broadcast(size))  # one row each
    return pn.verdict(rows).select("block", "horizon", "pre_clean", "verdict", "power_band")


QUERIES, SQL = S.queries, S.sql
