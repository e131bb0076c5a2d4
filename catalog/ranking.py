"""Ranks, windows, demeaning, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import AREAS_SQL, DIMS, PANEL_SQL, SCORED_SQL, pct_sql, table, with_sql
from zonometry.operators import aggregates as agg
from zonometry.operators import panel as pn, rank, serve
from zonometry.plans import score as scoring
from zonometry.session import stage

S = Section()


@S.query("pct_rank_avg", f"SELECT o_orderkey, round({pct_sql('o_totalprice')}, 8) AS pctile FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderpriority = '5-LOW'")
def pct_rank_avg(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v"))
    return rank.with_percentile(o, "v", "pctile").select("o_orderkey", F.round("pctile", 8).alias("pctile"))


@S.query("pct_rank_by_group", f"SELECT l_orderkey, l_linenumber, round({pct_sql('l_quantity', 'g')}, 8) AS pctile FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS g FROM lineitem)")
def pct_rank_by_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("g"))
    return rank.with_percentile(li, "l_quantity", "pctile", ["g"]).select("l_orderkey", "l_linenumber", F.round("pctile", 8).alias("pctile"))


@S.query("ordinal_rank_stable", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem")
def ordinal_rank_stable(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = [F.col(c) for c in ("l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return rank.global_index(li, order, "pos").select("l_orderkey", "l_linenumber", "l_partkey", "pos")


@S.query("group_demean", with_sql(AREAS_SQL) + "SELECT area, round(m_balance - avg(m_balance) OVER (PARTITION BY county_fips), 6) AS m_balance_within, round(m_open - avg(m_open) OVER (PARTITION BY county_fips), 8) AS m_open_within FROM areas")
def group_demean(spark, sf):
    out = agg.subtract_group_mean(R.area_stage(spark, sf), "county_fips", ["m_balance", "m_open"])
    return out.select("area", F.round("m_balance_within", 6).alias("m_balance_within"), F.round("m_open_within", 8).alias("m_open_within"))


TWOWAY_SQL = "resid AS (SELECT unit, year, pop, rate - avg(rate) OVER (PARTITION BY unit) - avg(rate) OVER (PARTITION BY year) + avg(rate) OVER () AS r FROM panel)"


@S.query("twoway_demean", with_sql(PANEL_SQL, TWOWAY_SQL) + "SELECT unit, year, round(r, 6) AS r FROM resid")
def twoway_demean(spark, sf):
    out = pn.twoway_demean(R.panel_stage(spark, sf).select("unit", "year", "rate"), "unit", "year", ["rate"])
    return out.select("unit", "year", F.round("rate", 6).alias("r"))


def _iter_sql(passes: int = 12) -> str:
    ctes, prev = [], "panel"
    for i in range(passes):
        ctes.append(f"d{i}a AS (SELECT unit, state, year, rate - avg(rate) OVER (PARTITION BY unit) AS rate FROM {prev})")
        ctes.append(f"d{i}b AS (SELECT unit, state, year, rate - avg(rate) OVER (PARTITION BY state, year) AS rate FROM d{i}a)")
        prev = f"d{i}b"
    return ", ".join(ctes)


@S.query("iter_demean", with_sql(PANEL_SQL, _iter_sql()) + "SELECT unit, year, round(rate, 6) AS r FROM d11b")
def iter_demean(spark, sf):
    p = R.panel_stage(spark, sf).select("unit", "state", "year", "rate")
    return pn.iter_demean(p, ["unit"], ["state", "year"], ["rate"]).select("unit", "year", F.round("rate", 6).alias("r"))


@S.query("lag1_autocorr", with_sql(PANEL_SQL, TWOWAY_SQL) + """SELECT round(avg(c), 8) AS lag1, count(*) AS n_units FROM (SELECT unit, corr(r, p) AS c, count(*) AS n
  FROM (SELECT unit, r, lag(r) OVER (PARTITION BY unit ORDER BY year) AS p FROM resid) GROUP BY 1) WHERE n >= 4 AND NOT isnan(c)""")
def lag1_autocorr(spark, sf):
    p = pn.twoway_demean(R.panel_stage(spark, sf).select("unit", "year", "rate"), "unit", "year", ["rate"])
    return pn.lag1_autocorr(p, "unit", "year", "rate").select(F.round("lag1", 8).alias("lag1"), "n_units")


@S.query("variance_decomposition", with_sql(PANEL_SQL, TWOWAY_SQL) + """SELECT round(greatest(1.0, regr_intercept(v, inv)), 2) AS floor, round(greatest(0.0, regr_slope(v, inv)), 0) AS sampling, count(*) AS n_units
  FROM (SELECT unit, var_samp(r) AS v, 1.0 / max(pop) AS inv FROM resid WHERE pop > 0 GROUP BY 1) WHERE v IS NOT NULL""")
def variance_decomposition(spark, sf):
    p = pn.twoway_demean(R.panel_stage(spark, sf).select("unit", "year", "rate", "pop"), "unit", "year", ["rate"])
    out = pn.variance_decomposition(p, "unit", "rate", "pop")
    return out.select(F.round("floor", 2).alias("floor"), F.round("sampling", 0).alias("sampling"), "n_units")


FAMILY = {"score", "pctile", "mult", "mult_pctile", "pctile_within_state", "resid_pctile"}


@S.query("rankings_topk", with_sql(SCORED_SQL) + """SELECT area, state, city, county_name, score, tier, n_dims_scored, population FROM scored
  WHERE scoreable AND score IS NOT NULL AND NOT institutional AND NOT low_confidence AND n_dims_scored >= 3 ORDER BY score DESC, area LIMIT 50""")
def rankings_topk(spark, sf):
    keep = ["state", "city", "county_name", "score", "tier", "n_dims_scored", "population"]
    return serve.rankings(R.scored(spark, sf), "score", "area", keep, FAMILY, 50)


@S.query("rankings_state", with_sql(SCORED_SQL) + """SELECT area, state, need_pctile FROM scored WHERE scoreable AND need_pctile IS NOT NULL AND NOT institutional
  AND state = 'ASIA' ORDER BY need_pctile, area LIMIT 100""")
def rankings_state(spark, sf):
    return serve.rankings(R.scored(spark, sf), "need_pctile", "area", ["state"], FAMILY, 100, descending=False,
                          state="ASIA", include_low_confidence=True)


@S.query("quintile_bins", with_sql(AREAS_SQL) + f"""SELECT area, {' + '.join(f'CAST(population > q{i} AS INTEGER)' for i in range(1, 5))} AS bin FROM areas,
  (SELECT {', '.join(f'quantile_cont(population, {i / 5}) AS q{i}' for i in range(1, 5))} FROM areas)""")
def quintile_bins(spark, sf):
    return agg.with_quantile_class(R.area_stage(spark, sf), "population", 5, "bin", right_closed=True).select("area", "bin")


@S.query("rank_trend_delta", f"""WITH v AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS a,
  avg(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1),
r AS (SELECT o_custkey, {pct_sql('a')} AS pa, {pct_sql('b')} AS pb FROM v WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT o_custkey, round(pb - pa, 1) AS delta, abs(round(pb - pa, 1)) >= 5 AS moved FROM r""")
def rank_trend_delta(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    old = o.where(F.col("o_orderdate") < cut).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    new = o.where(F.col("o_orderdate") >= cut).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return rank.rank_trend(stage(old, "old"), stage(new, "new"), "o_custkey", "v").select("o_custkey", "delta", "moved")


LIVE_SQL = """
live AS (SELECT area, CASE WHEN scoreable THEN round((coalesce(need_pctile, 0.0) * 20 + coalesce(vulnerability_pctile, 0.0) * 25 + coalesce(access_pctile, 0.0) * 55)
    / (CASE WHEN need_pctile IS NOT NULL THEN 20.0 ELSE 0.0 END + CASE WHEN vulnerability_pctile IS NOT NULL THEN 25.0 ELSE 0.0 END + CASE WHEN access_pctile IS NOT NULL THEN 55.0 ELSE 0.0 END), 9) END AS live,
  NOT institutional AND NOT low_confidence AND n_dims_scored >= 3 AS eligible FROM scored),
idx AS (SELECT live FROM live WHERE eligible AND live IS NOT NULL)"""
LIVE_PCT = "SELECT area, live, round(CASE WHEN live IS NOT NULL THEN (SELECT count(*) FROM idx i WHERE i.live < l.live) * 100.0 / (SELECT count(*) FROM idx) END, 6) AS live_pctile FROM live l"


@S.query("live_percentile", with_sql(SCORED_SQL, LIVE_SQL) + LIVE_PCT)
def live_percentile(spark, sf):
    w = scoring.effective_weights({"need_pctile": 20.0, "vulnerability_pctile": 25.0, "access_pctile": 55.0})
    df = R.scored(spark, sf).withColumn("live", scoring.additive(w, F.col("scoreable")))
    ok = ~F.col("institutional") & ~F.col("low_confidence") & (F.col("n_dims_scored") >= 3)
    return rank.with_less_share(df, "live", ok, "p").select("area", "live", F.round("p", 6).alias("live_pctile"))


QUERIES, SQL = S.queries, S.sql
