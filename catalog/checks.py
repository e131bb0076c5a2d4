"""Quality gates and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.ranking import LIVE_PCT, LIVE_SQL, live_percentile
from catalog.roles import AREAS_SQL, DIMS, SCORED_SQL, table, with_sql
from catalog.scoring import BAND_DRAWS, CV_SQL, SIGMAS, band_sql, noisy
from zonometry.functions.labels import ordinal
from zonometry.operators import joins, quality, rank, serve
from zonometry.plans import score as scoring
from zonometry.plans import uncertainty as unc

S = Section()


@S.query("assert_key_format", with_sql(AREAS_SQL) + "SELECT count(*) AS n_rows, CAST(count_if(NOT regexp_matches(zip, '^[0-9]{5}$')) AS BIGINT) AS n_bad FROM areas")
def assert_key_format(spark, sf):
    return quality.key_format(R.area_stage(spark, sf), "zip")


_LIMITS = {**{d: (0.0, 100.0) for d in DIMS}, "score": (0.0, 100.0), "rate": (0.0, 1.0), "m_balance": (0.0, 1.0)}


@S.query("assert_ranges", with_sql(SCORED_SQL) + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", min({c}) AS "min", max({c}) AS "max", min({c}) >= {lo} - 0.001 AND max({c}) <= {hi} + 0.001 AND min({c}) >= -1e5 AS ok FROM scored'
    for c, (lo, hi) in _LIMITS.items()))
def assert_ranges(spark, sf):
    return quality.ranges(R.scored(spark, sf), _LIMITS)


@S.query("assert_logic", with_sql(SCORED_SQL) + """SELECT 'unpopulated_scored' AS rule, CAST(count_if(scoreable AND NOT coalesce(population > 0, false)) AS BIGINT) AS n_bad FROM scored
  UNION ALL SELECT 'unflagged_extreme', CAST(count_if(primary_per_1k > 5 AND NOT (low_confidence OR institutional)) AS BIGINT) FROM scored
  UNION ALL SELECT 'bad_county', CAST(count_if(county_fips IS NOT NULL AND NOT regexp_matches(county_fips, '^[0-9]{5}$')) AS BIGINT) FROM scored
  UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT zip) FROM scored""")
def assert_logic(spark, sf):
    pop = F.coalesce(F.col("population") > 0, F.lit(False))
    rules = {"unpopulated_scored": F.col("scoreable") & ~pop,
             "unflagged_extreme": (F.col("primary_per_1k") > 5) & ~(F.col("low_confidence") | F.col("institutional")),
             "bad_county": quality.county_code_bad(F.col("county_fips"))}
    return quality.logic(R.scored(spark, sf), "zip", rules)


@S.query("assert_volume", """SELECT measure, value, lo, hi, value BETWEEN lo AND hi AS ok FROM (SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value, 1000.0 AS lo, 1e12 AS hi FROM lineitem
  UNION ALL SELECT 'total_quantity', sum(l_quantity), 1e6, 1e15 FROM lineitem UNION ALL SELECT 'mean_price', round(avg(l_extendedprice), 4), 1.0, 10.0 FROM lineitem)""")
def assert_volume(spark, sf):
    return quality.volume(table(spark, sf, "lineitem"), {
        "rows": F.count(F.lit(1)), "total_quantity": F.sum("l_quantity"), "mean_price": F.round(F.avg("l_extendedprice"), 4)},
        {"rows": (1000, 1e12), "total_quantity": (1e6, 1e15), "mean_price": (1, 10)})


_RAW = "CASE id % 5 WHEN 0 THEN 'x' || id WHEN 1 THEN ' ' || (id + 7) WHEN 2 THEN lpad(CAST(id AS VARCHAR), 10, '0') ELSE CAST(id + 100 AS VARCHAR) END"


@S.query("batch_lookup", with_sql(SCORED_SQL, f"""
req AS (SELECT raw, CASE WHEN regexp_matches(trim(raw), '^[0-9]{{1,10}}$') THEN lpad(trim(raw), 10, '0') END AS area FROM (SELECT {_RAW} AS raw FROM areas))""")
         + "SELECT raw, req.area, round(score, 6) AS score, CASE WHEN req.area IS NULL THEN 'invalid' WHEN id IS NOT NULL THEN 'found' ELSE 'unknown' END AS status FROM req LEFT JOIN scored ON scored.area = req.area")
def batch_lookup(spark, sf):
    i = F.col("id").cast("string")
    m = F.col("id") % 5
    raw = F.when(m == 0, F.concat(F.lit("x"), i)).when(m == 1, F.concat(F.lit(" "), (F.col("id") + 7).cast("string"))).when(
        m == 2, F.lpad(i, 10, "0")).otherwise((F.col("id") + 100).cast("string"))
    req = R.area_stage(spark, sf).select(raw.alias("raw"))
    out = serve.batch_lookup(req, "raw", R.scored(spark, sf).select("area", "score"), "area", ["score"], width=10)
    return out.select("raw", "area", F.round("score", 6).alias("score"), "status")


@S.query("compare", with_sql(SCORED_SQL, """
sets AS (SELECT c_custkey // 4 AS set_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS area FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT -1, lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 0, '9999999999')""", LIVE_SQL, f"lp AS ({LIVE_PCT})")
         + "SELECT set_id, area, set_size, score, tier, round(rate, 6) AS rate, live_pctile, city, state, population, " + ", ".join(f"round({d}, 6) AS {d}" for d in DIMS) + " FROM sets JOIN scored USING (area) JOIN lp USING (area) JOIN (SELECT set_id, count(*) AS set_size FROM sets GROUP BY 1) USING (set_id)")
def compare(spark, sf):
    """Comparison sets with their records and the percentile under the weights that are set just now."""
    c = table(spark, sf, "customer")
    area = F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("area")
    sets = c.where(F.col("c_acctbal") > 0).select(F.floor(F.col("c_custkey") / 4).alias("set_id"), area)
    sets = sets.unionByName(c.where(F.col("c_acctbal") > 9500).select(F.lit(-1).cast("long").alias("set_id"), area))
    sets = sets.unionByName(spark.createDataFrame([(0, "9999999999")], "set_id long, area string"))
    live = live_percentile(spark, sf).select("area", "live_pctile")
    rec = R.scored(spark, sf).select("area", "score", "tier", F.round("rate", 6).alias("rate"), "city", "state", "population", *[F.round(d, 6).alias(d) for d in DIMS]).join(live, "area")
    return joins.compare_sets(sets, rec, "set_id", "area")


@S.query("table_summary", with_sql(SCORED_SQL) + "SELECT count(*) AS n_rows, count(score) AS n_scored, (SELECT string_agg(state, ',' ORDER BY state) FROM (SELECT DISTINCT state FROM scored)) AS states FROM scored")
def table_summary(spark, sf):
    return serve.table_summary(R.scored(spark, sf), "state", "score")


def bands(spark, sf):
    """Reliable range of each area's rank."""
    return R.once(spark, sf, "bands", lambda: unc.rank_band(noisy(spark, sf), "area", list(DIMS), SIGMAS, BAND_DRAWS))


def _ord(c):
    n = f"CAST(round({c}) AS BIGINT)"
    return (f"CASE WHEN {c} IS NOT NULL THEN {n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' "
            f"WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END END")


@S.query("comparison_frame", with_sql(SCORED_SQL, """
el AS (SELECT score FROM scored WHERE NOT institutional AND NOT low_confidence AND n_dims_scored >= 3 AND score IS NOT NULL),
cf AS (SELECT area, (SELECT count(*) FROM el WHERE el.score < s.score) * 100.0 / (SELECT count(*) FROM el) AS p, pctile_within_state AS ws, resid_pctile AS rp FROM scored s WHERE score IS NOT NULL)""", CV_SQL, band_sql("", True))
         + f"SELECT area, round(p, 6) AS national, CAST(least(10, greatest(1, ceil(p / 10))) AS INTEGER) AS live_tier, {_ord('round(ws, 6)')} AS within_state, {_ord('round(rp, 6)')} AS net_of_deprivation, round(rank_lo, 5) AS rank_lo, round(rank_hi, 5) AS rank_hi FROM cf LEFT JOIN (SELECT area, rank_lo, rank_hi FROM band) USING (area)")
def comparison_frame(spark, sf):
    df = R.scored(spark, sf).where(F.col("score").isNotNull())
    ok = ~F.col("institutional") & ~F.col("low_confidence") & (F.col("n_dims_scored") >= 3)
    p = rank.with_less_share(df, "score", ok, "p").join(bands(spark, sf), "area", "left")
    tier = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.col("p") / 10))).cast("int")
    return p.select("area", F.round("p", 6).alias("national"), tier.alias("live_tier"),
                    ordinal(F.round("pctile_within_state", 6)).alias("within_state"), ordinal(F.round("resid_pctile", 6)).alias("net_of_deprivation"),
                    F.round("rank_lo", 5).alias("rank_lo"), F.round("rank_hi", 5).alias("rank_hi"))


@S.query("metric_by_name", with_sql(SCORED_SQL) + "SELECT area, 'score' AS metric, score AS value FROM scored UNION ALL SELECT area, 'mult', mult FROM scored UNION ALL SELECT area, 'need_pctile', round(need_pctile, 9) FROM scored")
def metric_by_name(spark, sf):
    df = R.scored(spark, sf)
    values = {"score": scoring.additive(DIMS, F.col("scoreable")), "mult": scoring.geometric(DIMS, F.col("scoreable")), "need_pctile": F.round("need_pctile", 9)}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])).alias("s")
    return df.select("area", rows).select("area", "s.*")


QUERIES, SQL = S.queries, S.sql
