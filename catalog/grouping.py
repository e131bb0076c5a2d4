"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.columns import CLASS_SQL, _taxonomy_columns
from catalog.registry import Section
from catalog.roles import AREAS_SQL, PANEL_SQL, SCORED_SQL, table, with_sql
from zonometry.functions import keys, labels
from zonometry.operators import aggregates as agg
from zonometry.operators import joins, quality
from zonometry.operators.rank import exact_quantiles

S = Section()

PROVIDERS_SQL = f"""
prov AS (SELECT l_suppkey AS zip, {CLASS_SQL} AS pclass, CASE WHEN p_size % 9 <> 0 THEN p_brand END AS city
  FROM lineitem JOIN part ON l_partkey = p_partkey),
city AS (SELECT zip, city FROM (SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) AS r
  FROM prov WHERE city IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
"""


@S.query("filtered_counts", with_sql(PROVIDERS_SQL) + """SELECT zip, count(*) AS providers_total, count(*) FILTER (WHERE pclass = 'primary_care') AS providers_primary,
  count(*) FILTER (WHERE pclass = 'mental_health') AS providers_mental, count(*) FILTER (WHERE pclass = 'dental') AS providers_dental,
  count(*) FILTER (WHERE pclass = 'obgyn') AS providers_obgyn, max(c.city) AS city FROM prov LEFT JOIN city c USING (zip) GROUP BY 1""")
def filtered_counts(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), labels.provider_class(*_taxonomy_columns()).alias("pclass"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("city"))
    prov = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("zip")).join(part, "l_partkey")
    classes = {"providers_primary": "primary_care", "providers_mental": "mental_health", "providers_dental": "dental", "providers_obgyn": "obgyn"}
    counts = agg.class_counts(prov, "zip", "pclass", classes, "providers_total")
    return counts.join(agg.modal_value(prov, "zip", "city", "city"), "zip", "left")


@S.query("conditional_sums", """SELECT l_suppkey AS zip, count(*) AS n_providers, sum(l_quantity) AS benes, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS dual,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS benes_primary, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_primary,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS dual_share FROM lineitem GROUP BY 1""")
def conditional_sums(spark, sf):
    benes = F.col("l_quantity").cast("string").try_cast("double")
    primary = F.col("l_linestatus") == "O"
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("zip")).agg(
        F.count(F.lit(1)).alias("n_providers"), F.sum(benes).alias("benes"),
        F.sum(F.when(F.col("l_returnflag") == "R", benes).otherwise(0)).alias("dual"),
        F.sum(F.when(primary, benes).otherwise(0)).alias("benes_primary"), F.count_if(primary).alias("n_primary"))
    return g.withColumn("dual_share", F.round(F.when(F.col("benes") > 0, F.col("dual") / F.col("benes")), 9))


@S.query("group_max", "SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY 1")
def group_max(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("score"))


@S.query("count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders"))


@S.query("pooled_rates", """SELECT o_custkey, round(obs, 5) AS obs, round("exp", 5) AS "exp", n_periods, round(obs / "exp", 8) AS oe FROM (SELECT o_custkey,
  avg(o_totalprice) AS obs, avg(o_totalprice / 2 + 1000) AS "exp", count(DISTINCT year(o_orderdate)) AS n_periods FROM orders GROUP BY 1)""")
def pooled_rates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("ob"),
                                          (F.col("o_totalprice") / 2 + 1000).alias("ex"))
    out = agg.pooled_rates(o, "o_custkey", "y", "ob", "ex")
    return out.select("o_custkey", F.round("obs", 5).alias("obs"), F.round("exp", 5).alias("exp"), "n_periods", F.round("oe", 8).alias("oe"))


@S.query("first_event_year", """SELECT o_custkey, f AS first_year, n_sites, treat_year_loose, f BETWEEN 1996 AND 1998 AS newly_served,
  CASE WHEN f BETWEEN 1996 AND 1998 THEN f END AS treat_year, coalesce(n_name, m.st) AS state FROM (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS f, count(*) AS n_sites,
  CAST(min(year(o_orderdate)) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1998) AS INTEGER) AS treat_year_loose FROM orders GROUP BY 1)
  LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = o_custkey
  LEFT JOIN (SELECT o_custkey, o_orderpriority AS st FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r
    FROM orders GROUP BY 1, 2) WHERE r = 1) m USING (o_custkey)""")
def first_event_year(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(n, "c_nationkey").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("n_name")).alias("st1"))
    ev = agg.first_event(o, "o_custkey", "y", (1996, 1998)).join(c, "o_custkey", "left")
    ev = ev.join(agg.modal_value(o, "o_custkey", "o_orderpriority", "st2"), "o_custkey", "left")
    return ev.withColumn("state", F.coalesce("st1", "st2")).drop("st1", "st2")


@S.query("acsc_counts", """SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2-H%') AS flagged,
  count(*) AS n_total FROM orders GROUP BY 1, 2""")
def acsc_counts(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return agg.flagged_counts(o, ["o_custkey", "year"], keys.starts_with_any(F.col("o_orderpriority"), ["1", "2-H"]))


@S.query("cause_sum", "SELECT l_suppkey, sum(CASE WHEN l_quantity >= 5 THEN l_quantity END) AS deaths FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def cause_sum(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("n", F.when(F.col("l_quantity") < 5, "*").otherwise(F.col("l_quantity").cast("string")))
    return agg.sum_over_set(li, "l_suppkey", "l_returnflag", ["R", "A"], "n", "deaths")


@S.query("pivot_long_to_wide", """SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 8) AS "A", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 8) AS "N",
  round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 8) AS "R" FROM lineitem GROUP BY 1""")
def pivot_long_to_wide(spark, sf):
    out = agg.pivot_measures(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return out.select("l_suppkey", *[F.round(c, 8).alias(c) for c in "ANR"])


@S.query("having_min_members", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)")
def having_min_members(spark, sf):
    return joins.having_min_members(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


@S.query("coverage_filter", """WITH p AS (SELECT c_nationkey AS s, o_custkey AS u, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, u FROM p WHERE (s, u) IN (SELECT (s, u) FROM (SELECT s, u, count(DISTINCT y) AS seen FROM p GROUP BY 1, 2)
  JOIN (SELECT s, count(DISTINCT y) AS n FROM p GROUP BY 1) USING (s) WHERE seen >= ceil(0.8 * n))""")
def coverage_filter(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").alias("s"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("y")).join(c, "u")
    return joins.coverage_filter(o, "u", "y", "s", 0.8).select("o_orderkey", "u")


@S.query("drop_duplicates_prefer", """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1""")
def drop_duplicates_prefer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    out = agg.drop_duplicates_prefer(o, ["o_custkey"], [F.col("o_orderstatus") == "P", F.col("o_totalprice"), F.col("o_orderkey")])
    return out.drop("o_totalprice")


@S.query("definition_break_guard", "SELECT count(DISTINCT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'old' ELSE 'new' END) AS n_definitions, true AS mixed FROM orders")
def definition_break_guard(spark, sf):
    o = table(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "old").otherwise("new"))
    return agg.definition_groups(o, "g")


@S.query("bbox_by_group", with_sql(AREAS_SQL) + """SELECT state, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM areas GROUP BY 1
  UNION ALL SELECT '(all)', min(lon), min(lat), max(lon), max(lat) FROM areas WHERE lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50""")
def bbox_by_group(spark, sf):
    a = R.area_stage(spark, sf)
    whole = agg.continental_box(a, "lon", "lat").withColumn("state", F.lit("(all)"))
    return agg.bounding_boxes(a, "state", "lon", "lat").unionByName(whole)


@S.query("histogram", with_sql(SCORED_SQL) + """SELECT CASE WHEN score IS NULL THEN -1 ELSE CAST(least(43, greatest(0, floor(score / 100 * 44))) AS INTEGER) END AS bin, count(*) AS n,
  count(*) FILTER (WHERE score IS NOT NULL AND n_dims_scored < 3) AS n_partial FROM scored GROUP BY 1""")
def histogram(spark, sf):
    return agg.histogram(R.scored(spark, sf), "score", partial=F.col("n_dims_scored") < 3)


_BREAKS = ", ".join(f"quantile_cont(score, {i / 8}) AS b{i}" for i in range(1, 8))


@S.query("quantile_breaks", with_sql(SCORED_SQL) + f"""SELECT area, {' + '.join(f'CAST(score >= b{i} AS INTEGER)' for i in range(1, 8))} AS class
  FROM scored, (SELECT {_BREAKS} FROM scored)""")
def quantile_breaks(spark, sf):
    return agg.with_quantile_class(R.scored(spark, sf), "score", 8, "class").select("area", "class")


@S.query("score_quantiles", with_sql(SCORED_SQL) + "SELECT count(score) AS n, " + ", ".join(
    f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM scored")
def score_quantiles(spark, sf):
    ps = [5, 25, 50, 75, 95]
    q = exact_quantiles(R.scored(spark, sf), "score", [p / 100 for p in ps], names=[f"p{p}" for p in ps], domain=(0.0, 100.0))
    return q.select("n", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in ps])


@S.query("overlap_share", with_sql(AREAS_SQL) + "SELECT avg(CASE WHEN m_urgent IS NOT NULL OR m_open IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN m_urgent IS NOT NULL OR m_open IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 AS ok FROM areas")
def overlap_share(spark, sf):
    return quality.overlap_share(R.area_stage(spark, sf), ["m_urgent", "m_open"])


QUERIES, SQL = S.queries, S.sql
