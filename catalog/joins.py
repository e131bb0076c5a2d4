"""Joins, spatial joins, crosswalks, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import AREAS_SQL, PANEL_SQL, SCORED_SQL, SITES_SQL, table, with_sql
from zonometry.operators import aggregates as agg
from zonometry.operators import crosswalk as xw
from zonometry.operators import joins, panel as pn, quality, spatial

S = Section()


@S.query("universe_left_join", """SELECT c_custkey, o.n, o.total, s.nation FROM customer
  LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o USING (c_custkey)
  LEFT JOIN (SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) s USING (c_custkey)""")
def universe_left_join(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    s = c.where(F.col("c_acctbal") > 0).join(n, "c_nationkey").select("c_custkey", "nation")
    return joins.universe_left_join(c.select("c_custkey"), "c_custkey", {"orders": o}, {"places": s, "absent": None})


@S.query("lookup_left_join_default", """SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'rush' WHEN '2-HIGH' THEN 'fast' END, 'other') AS class FROM orders""")
def lookup_left_join_default(spark, sf):
    codes = spark.createDataFrame([("1-URGENT", "rush"), ("2-HIGH", "fast")], "o_orderpriority string, class string")
    return joins.lookup_default(table(spark, sf, "orders"), codes, "o_orderpriority", "class", "other").select("o_orderkey", "class")


@S.query("broadcast_down", with_sql(AREAS_SQL) + """SELECT area, county_fips, v FROM areas LEFT JOIN (SELECT county_fips, round(avg(m_balance), 6) AS v
  FROM areas WHERE county_name NOT LIKE '%3' GROUP BY 1) USING (county_fips)""")
def broadcast_down(spark, sf):
    a = R.area_stage(spark, sf)
    v = a.where(~F.col("county_name").endswith("3")).groupBy("county_fips").agg(F.round(F.avg("m_balance"), 6).alias("v"))
    return joins.broadcast_down(a.select("area", "county_fips"), v, "county_fips").select("area", "county_fips", "v")


@S.query("inner_join_on_key", with_sql(SCORED_SQL) + "SELECT area, score, o_return FROM scored WHERE scoreable AND o_return > 0")
def inner_join_on_key(spark, sf):
    out = R.area_stage(spark, sf).where(F.col("o_return") > 0).select("area", "o_return")
    return R.scored(spark, sf).where("scoreable").select("area", "score").join(out, "area")


_VINTAGE_SQL = """
old AS (SELECT o_custkey AS k, count(*) AS n_old FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1),
new AS (SELECT o_custkey AS k, count(*) AS n_new FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
"""


def _vintages(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey").alias("k")
    old = o.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp")).groupBy(k).agg(F.count(F.lit(1)).alias("n_old"))
    new = o.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).groupBy(k).agg(F.count(F.lit(1)).alias("n_new"))
    return old, new


@S.query("full_outer_with_origin", with_sql(_VINTAGE_SQL) + """SELECT k, n_old, n_new, CASE WHEN n_old IS NULL THEN 'right_only'
  WHEN n_new IS NULL THEN 'left_only' ELSE 'both' END AS origin FROM old FULL JOIN new USING (k)""")
def full_outer_with_origin(spark, sf):
    return joins.outer_with_origin(*_vintages(spark, sf), "k")


@S.query("anti_semi_filter", with_sql(_VINTAGE_SQL) + "SELECT k, n_old FROM old WHERE k NOT IN (SELECT k FROM new) AND k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_semi_filter(spark, sf):
    old, new = _vintages(spark, sf)
    rich = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
    return joins.keep_keys(joins.drop_keys(old, new, "k"), rich, "k")


@S.query("fallback_chain_map", with_sql(AREAS_SQL) + """SELECT area, coalesce(f.score, c.score, 0.0) AS score FROM areas
  LEFT JOIN (SELECT area, m_balance AS score FROM areas WHERE id % 3 = 0) f USING (area)
  LEFT JOIN (SELECT county_fips, max(m_balance) AS score FROM areas WHERE county_fips NOT LIKE '01%' GROUP BY 1) c USING (county_fips)""")
def fallback_chain_map(spark, sf):
    a = R.area_stage(spark, sf)
    fine = a.where(F.col("id") % 3 == 0).select("area", F.col("m_balance").alias("score"))
    coarse = a.where(~F.col("county_fips").startswith("01")).groupBy("county_fips").agg(F.max("m_balance").alias("score"))
    return joins.fallback_chain(a.select("area", "county_fips"), fine, "area", coarse, F.col("county_fips"), "score").select("area", "score")


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_D_AA = HAVERSINE.format(a="a", b="b")


@S.query("knn_join", with_sql(AREAS_SQL, f"""
ranked AS (SELECT a.area, b.area AS near, {_D_AA} AS d FROM areas a, areas b),
nn AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY d, near) - 1 AS idx FROM ranked)""") + "SELECT area, near, round(d, 6) AS d, CAST(idx AS INTEGER) AS idx FROM nn WHERE idx < 10")
def knn_join(spark, sf):
    a = R.area_stage(spark, sf)
    nn = spatial.knn_join(a, a, "area", "area", 10)
    return nn.select("area", F.col("area_near").alias("near"), F.round("d", 6).alias("d"), "idx")


_D_AS = HAVERSINE.format(a="a", b="s")


@S.query("radius_join", with_sql(AREAS_SQL, SITES_SQL) + f"SELECT area, site, round(d, 6) AS d FROM (SELECT area, site, {_D_AS} AS d FROM areas a, sites s) WHERE d <= 25.0")
def radius_join(spark, sf):
    out = spatial.radius_join(R.area_stage(spark, sf), R.sites(spark, sf), "area", "site", 25.0)
    return out.withColumn("d", F.round("d", 6))


@S.query("radius_count", with_sql(AREAS_SQL, SITES_SQL) + f"""SELECT a.area, coalesce(n, 0) AS n FROM areas a LEFT JOIN
  (SELECT area, count(*) AS n FROM areas a, sites s WHERE {_D_AS} <= 16.0 GROUP BY 1) USING (area)""")
def radius_count(spark, sf):
    return spatial.radius_counts(R.area_stage(spark, sf), R.sites(spark, sf), "area", 16.0, "n")


@S.query("proximity", with_sql(AREAS_SQL, SITES_SQL) + f"""SELECT area, count(*) FILTER (WHERE d <= 16.0) AS sites_reachable,
  round(min(d), 1) AS nearest_km FROM (SELECT area, {_D_AS} AS d FROM areas a, sites s) GROUP BY 1""")
def proximity(spark, sf):
    return spatial.proximity(R.area_stage(spark, sf), R.sites(spark, sf), "area", "site", 16.0)


@S.query("nearest_area_join", with_sql(AREAS_SQL, SITES_SQL) + """SELECT site, area, round(d, 9) AS dist2 FROM (SELECT site, area, d,
  row_number() OVER (PARTITION BY site ORDER BY d, area) AS r FROM (SELECT site, area,
  pow(a.lon - s.lon, 2) + pow(a.lat - s.lat, 2) AS d FROM areas a, sites s)) WHERE r = 1""")
def nearest_area_join(spark, sf):
    out = spatial.nearest_centroid(R.sites(spark, sf), R.area_stage(spark, sf), "site", "area")
    return out.withColumn("dist2", F.round("dist2", 9))


@S.query("spillover_filter", with_sql(AREAS_SQL) + f"""SELECT a.area FROM areas a WHERE a.id % 40 <> 0 AND NOT EXISTS (
  SELECT 1 FROM areas b WHERE b.id % 40 = 0 AND {_D_AA} <= 10.0)""")
def spillover_filter(spark, sf):
    a = R.area_stage(spark, sf)
    treated, control = a.where(F.col("id") % 40 == 0), a.where(F.col("id") % 40 != 0)
    return spatial.far_controls(treated, control, "area", 10.0).select("area")


@S.query("interval_overlap_pairs", """WITH b AS (SELECT c_custkey // 5 AS set_id, c_custkey AS k, c_acctbal - 900 AS lo, c_acctbal + 900 AS hi FROM customer)
  SELECT x.set_id, x.k AS a, y.k AS b, 'tied' AS status FROM b x JOIN b y ON x.set_id = y.set_id AND x.k < y.k AND x.lo <= y.hi AND y.lo <= x.hi
  UNION ALL SELECT -1, NULL, NULL, 'refused' FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 5""")
def interval_overlap_pairs(spark, sf):
    c = table(spark, sf, "customer")
    sets = c.select(F.floor(F.col("c_custkey") / 5).alias("set_id"), F.col("c_custkey").alias("k"))
    sets = sets.unionByName(c.where(F.col("c_acctbal") > 9000).select(F.lit(-1).cast("long").alias("set_id"), F.col("c_custkey").alias("k")))
    bands = c.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") - 900).alias("lo"), (F.col("c_acctbal") + 900).alias("hi"))
    return joins.overlap_pairs(sets, bands, "set_id", "k", "lo", "hi")


_BASES = "(SELECT DISTINCT cohort - 1 AS base FROM panel WHERE cohort IS NOT NULL)"


@S.query("base_year_self_join", with_sql(PANEL_SQL) + f"""SELECT p.unit, p.year, b.year AS base, round(p.rate - b.rate, 6) AS dy FROM panel p
  JOIN panel b ON p.unit = b.unit AND b.year IN (SELECT base FROM {_BASES}) WHERE p.year <> b.year""")
def base_year_self_join(spark, sf):
    p = R.panel_stage(spark, sf)
    bases = p.where(F.col("cohort").isNotNull()).select((F.col("cohort") - 1).alias("base")).distinct()
    return pn.base_year_change(p, "unit", "year", "rate", bases).select("unit", "year", "base", F.round("dy", 6).alias("dy"))


@S.query("not_yet_treated_join", with_sql(PANEL_SQL) + f"""SELECT g.state, g.g, t.year AS t, count(DISTINCT c.unit) AS n_controls
  FROM (SELECT DISTINCT state, cohort AS g FROM panel WHERE cohort IS NOT NULL) g JOIN (SELECT DISTINCT year FROM panel) t ON t.year <> g.g - 1
  JOIN panel c ON c.state = g.state AND c.year = t.year AND (c.cohort IS NULL OR c.cohort > greatest(t.year, g.g)) GROUP BY 1, 2, 3""")
def not_yet_treated_join(spark, sf):
    p = R.panel_stage(spark, sf)
    cells = p.groupBy("state", "cohort", F.col("year").alias("t")).agg(F.countDistinct("unit").alias("n"))
    treated = cells.where(F.col("cohort").isNotNull()).select("state", F.col("cohort").alias("g")).distinct()
    ctrl = cells.select("state", "cohort", "t", "n")
    later = F.col("cohort").isNull() | (F.col("cohort") > F.greatest("t", "g"))
    return treated.join(ctrl, "state").where(later & (F.col("t") != F.col("g") - 1)).groupBy("state", "g", "t").agg(
        F.sum("n").alias("n_controls"))


# ---- crosswalks ------------------------------------------------------------------------------

XWALK_SQL = """
xwalk AS (SELECT o_custkey AS src, l_partkey AS dst, sum(l_quantity) AS w, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS w2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""


def _xwalk(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("dst"), "l_quantity", "l_returnflag")
    return li.join(o, "o_orderkey").groupBy("src", "dst").agg(
        F.sum("l_quantity").alias("w"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("w2"))


@S.query("dominant_overlap", with_sql(XWALK_SQL) + "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM xwalk) WHERE r = 1")
def dominant_overlap(spark, sf):
    return xw.dominant_overlap(_xwalk(spark, sf), "src", "dst", "w")


@S.query("area_weighted_mean", with_sql(XWALK_SQL) + """SELECT src AS area, round(CASE WHEN sum(w) > 0 THEN sum(coalesce(f.s, c.s, 0.0) * w) / sum(w) ELSE 0.0 END, 8) AS score
  FROM (SELECT src, w, dst, lpad(CAST(dst AS VARCHAR), 11, '0') AS tract FROM xwalk) x
  LEFT JOIN (SELECT p_partkey, max(p_size) AS s FROM part WHERE p_size > 25 GROUP BY 1) f ON p_partkey = dst
  LEFT JOIN (SELECT substr(lpad(CAST(p_partkey AS VARCHAR), 11, '0'), 1, 5) AS k, max(p_size) AS s FROM part WHERE p_size <= 5 GROUP BY 1) c ON substr(tract, 1, 5) = c.k
  GROUP BY 1""")
def area_weighted_mean(spark, sf):
    p = table(spark, sf, "part")
    tract = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    fine = p.where(F.col("p_size") > 25).select(F.lit("tract").alias("kind"), tract.alias("code"), F.col("p_size").cast("double").alias("score"))
    coarse = p.where(F.col("p_size") <= 5).select(F.lit("county").alias("kind"), F.substring(tract, 1, 5).alias("code"), F.col("p_size").cast("double").alias("score"))
    x = _xwalk(spark, sf).select(F.col("src").alias("area"), F.lpad(F.col("dst").cast("string"), 11, "0").alias("tract"), "w")
    out = xw.shortage_score(fine.unionByName(coarse), x, "area", "tract", "w")
    return out.withColumn("score", F.round("score", 8))


@S.query("pop_weighted_mean", with_sql(XWALK_SQL) + """SELECT src, round(sum(p_retailprice * w) / sum(w), 1) AS v FROM xwalk
  JOIN part ON dst = p_partkey WHERE w > 0 GROUP BY 1""")
def pop_weighted_mean(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("dst"), F.col("p_retailprice").alias("v"))
    out = xw.crosswalk_mean(_xwalk(spark, sf), v, "dst", "src", ["v"], "w")
    return out.withColumn("v", F.round("v", 1))


@S.query("crosswalk_wavg_nullaware", with_sql(XWALK_SQL) + """SELECT src, round(sum(a * wt) FILTER (WHERE a IS NOT NULL AND wt > 0) / sum(wt) FILTER (WHERE a IS NOT NULL AND wt > 0), 7) AS a,
  round(sum(b * wt) FILTER (WHERE b IS NOT NULL AND wt > 0) / sum(wt) FILTER (WHERE b IS NOT NULL AND wt > 0), 7) AS b
  FROM (SELECT src, coalesce(w2, w) AS wt, CASE WHEN p_size > 10 THEN p_retailprice END AS a, CASE WHEN p_type = 'PROMO' THEN CAST(p_size AS DOUBLE) END AS b
  FROM xwalk JOIN part ON dst = p_partkey) GROUP BY 1""")
def crosswalk_wavg_nullaware(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("dst"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("a"),
        F.when(F.col("p_type") == "PROMO", F.col("p_size").cast("double")).alias("b"))
    out = xw.crosswalk_mean(_xwalk(spark, sf), p, "dst", "src", ["a", "b"], "w", preferred="w2")
    return out.select("src", F.round("a", 7).alias("a"), F.round("b", 7).alias("b"))


@S.query("pooled_geoid_expand", """SELECT p_brand AS geoid, lpad(CAST(m AS VARCHAR), 11, '0') AS tract FROM (SELECT p_brand, unnest([p_partkey, p_partkey + 1, p_partkey + 7]) AS m FROM part)""")
def pooled_geoid_expand(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("geoid"), F.concat_ws(" , ", k, k + 1, k + 7).alias("members"))
    return xw.expand_members(p, "members", "tract", 11)


@S.query("wmean_by_group", with_sql(AREAS_SQL) + "SELECT county_fips, " + ", ".join(
    f"round(sum({c} * population) FILTER (WHERE {c} IS NOT NULL AND population > 0) / sum(population) FILTER (WHERE {c} IS NOT NULL AND population > 0), 6) AS {c}"
    for c in ("m_urgent", "m_open", "o_return")) + " FROM areas GROUP BY 1")
def wmean_by_group(spark, sf):
    cols = ["m_urgent", "m_open", "o_return"]
    out = xw.weighted_mean_by(R.area_stage(spark, sf), "county_fips", cols, "population")
    return out.select("county_fips", *[F.round(c, 6).alias(c) for c in cols])


# ---- set operations and row generation --------------------------------------------------------

@S.query("union_all", """SELECT 'order' AS kind, CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS v FROM orders
  UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def union_all(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return o.unionByName(c).unionByName(s)


_CELLS = """(SELECT o_custkey AS zip, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS county,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS n, o_orderstatus = 'P' AS censored FROM orders)"""


def _cells(spark, sf):
    p = F.col("o_orderstatus") == "P"
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("zip"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("county"),
        F.when(~p, F.col("o_totalprice")).alias("n"), p.alias("censored"))


@S.query("union_distinct_prefer", f"SELECT zip, year, n, censored FROM (SELECT *, row_number() OVER (PARTITION BY zip, year ORDER BY censored, n) AS r FROM {_CELLS}) WHERE r = 1")
def union_distinct_prefer(spark, sf):
    cells = _cells(spark, sf)
    parts = [cells.where(F.col("county") == c).drop("county") for c in ("F", "O", "P")]
    return agg.union_distinct_prefer(parts, ["zip", "year"], [F.col("censored"), F.col("n")])


@S.query("set_difference_check", with_sql(_VINTAGE_SQL) + "SELECT k, 'left_only' AS side FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, 'right_only' FROM new WHERE k NOT IN (SELECT k FROM old)")
def set_difference_check(spark, sf):
    return quality.key_differences(*_vintages(spark, sf), "k")


@S.query("placebo_shift", with_sql(PANEL_SQL) + """SELECT unit, year, rate, cohort - 3 AS cohort FROM panel WHERE cohort IS NOT NULL AND year < cohort
  UNION ALL SELECT unit, year, rate, NULL FROM panel WHERE cohort IS NULL""")
def placebo_shift(spark, sf):
    p = R.panel_stage(spark, sf).select("unit", "year", "rate", "cohort")
    return joins.placebo_shift(p, "cohort", "year", 3)


@S.query("balanced_sample", with_sql(AREAS_SQL) + """SELECT area, state FROM areas WHERE area IN (SELECT area FROM areas ORDER BY md5(area || '|0'), area LIMIT 200)
  OR area IN ('0000000007', '0000000011')""")
def balanced_sample(spark, sf):
    return agg.balanced_sample(R.area_stage(spark, sf).select("area", "state"), "area", 200, ["0000000007", "0000000011"])


QUERIES, SQL = S.queries, S.sql
