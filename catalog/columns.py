"""Normalization, parsing, guarded arithmetic, labels (one query per column rule)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import AREAS_SQL, DIMS, SCORED_SQL, SITES_SQL, table, with_sql
from zonometry.functions import keys, labels, numeric, states
from zonometry.operators.aggregates import outlier_trim, standardize
from zonometry.operators.rank import with_percentile
from zonometry.plans import score as scoring

S = Section()


@S.query("norm_area_key", """SELECT c_custkey, lpad(substr(regexp_replace(trim(raw), '\\.0$', ''), 1, 5), 5, '0') AS zcta
  FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || '.0'
    WHEN 1 THEN ' ' || CAST(c_custkey AS VARCHAR) || ' ' ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-1234' END AS raw FROM customer)""")
def norm_area_key(spark, sf):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit(".0"))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(
        F.concat(F.lpad(k, 5, "0"), F.lit("-1234")))
    return table(spark, sf, "customer").select("c_custkey", keys.norm_area_key(raw).alias("zcta"))


@S.query("norm_postal_digits", """SELECT c_custkey, CASE WHEN regexp_matches(z, '^[0-9]{5}$') AND z <> '00000' THEN z END AS postal
  FROM (SELECT c_custkey, lpad(substr(regexp_replace(c_name || '-99', '[^0-9]', '', 'g'), 5, 5), 5, '0') AS z FROM customer)""")
def norm_postal_digits(spark, sf):
    raw = F.concat(F.substring(F.regexp_replace(F.concat("c_name", F.lit("-99")), "[^0-9]", ""), 5, 9), F.lit(" x"))
    return table(spark, sf, "customer").select("c_custkey", keys.postal_digits(raw).alias("postal"))


@S.query("norm_fips", """SELECT c_custkey, CASE WHEN regexp_matches(f, '^[0-9]{5}$') AND NOT f LIKE '%000' THEN f END AS fips FROM (
  SELECT c_custkey, CASE WHEN length(r) < 5 THEN lpad(r, 5, '0') ELSE r END AS f FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'US' || c_custkey ELSE CAST(c_custkey * 100 AS VARCHAR) END AS r FROM customer))""")
def norm_fips(spark, sf):
    raw = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("US"), "c_custkey")).otherwise(
        F.concat(F.lit(" "), (F.col("c_custkey") * 100).cast("string")))
    return table(spark, sf, "customer").select("c_custkey", keys.norm_fips(raw, 5, drop_state_totals=True).alias("fips"))


_SENT = "CASE c_custkey % 5 WHEN 0 THEN -666666666 WHEN 1 THEN -222222222 ELSE c_acctbal END"


def _sentinel_text():
    return F.when(F.col("c_custkey") % 5 == 0, "-666666666").when(F.col("c_custkey") % 5 == 1, "-222222222").when(
        F.col("c_custkey") % 5 == 2, F.col("c_acctbal").cast("string")).when(
        F.col("c_custkey") % 5 == 3, F.concat("c_acctbal", F.lit("x"))).otherwise(F.col("c_acctbal").cast("string"))


@S.query("scrub_sentinels", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (2, 4) THEN c_acctbal END AS v FROM customer")
def scrub_sentinels(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numeric.scrub_sentinels(_sentinel_text()).alias("v"))


@S.query("margin_magnitude", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (2, 4) THEN abs(c_acctbal) END AS moe FROM customer")
def margin_magnitude(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numeric.margin_magnitude(_sentinel_text()).alias("moe"))


@S.query("parse_suppressed_cell", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity < 5 THEN 0.0
  ELSE l_quantity * 1000 END AS value, l_quantity > 40 AS censored FROM lineitem""")
def parse_suppressed_cell(spark, sf):
    text = F.when(F.col("l_quantity") > 45, "*").when(F.col("l_quantity") > 40, " S ").when(
        F.col("l_quantity") < 5, "0").otherwise(F.concat(F.lit(" "), F.format_number(F.col("l_quantity") * 1000, 0)))
    value, censored = numeric.suppressed_cell(text)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), censored.alias("censored"))


@S.query("parse_ci_to_se", """SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN
  round(((c_acctbal + 12.5) - c_acctbal) / 3.92, 8) END AS se FROM customer""")
def parse_ci_to_se(spark, sf):
    lo, hi = F.round("c_acctbal", 2), F.round(F.col("c_acctbal") + 12.5, 2)
    text = F.when(F.col("c_custkey") % 6 == 0, "( n/a )").otherwise(
        F.concat(F.lit("( "), lo.cast("decimal(18,2)").cast("string"), F.lit(", "), hi.cast("decimal(18,2)").cast("string"), F.lit(")")))
    return table(spark, sf, "customer").select("c_custkey", F.round(numeric.interval_to_se(text), 8).alias("se"))


@S.query("parse_year_mdy", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS open_year FROM orders")
def parse_year_mdy(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, "13/45/20xx").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", numeric.year_mdy(text).alias("open_year"))


@S.query("strip_non_numeric", """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS county, abs(c_acctbal) AS rate
  FROM customer WHERE c_custkey % 4 <> 0""")
def strip_non_numeric(spark, sf):
    from zonometry.operators.aggregates import drop_duplicates_prefer

    text = F.when(F.col("c_custkey") % 4 == 0, "Suppressed").otherwise(
        F.concat(F.abs("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" (Unreliable)")))
    c = table(spark, sf, "customer")
    rows = c.unionByName(c).select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("county"), numeric.strip_non_numeric(text).alias("rate"))
    return drop_duplicates_prefer(rows.where(F.col("rate").isNotNull()), ["county"], [F.col("rate")])


@S.query("title_case_place", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'O''Fallon ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
  WHEN 1 THEN 'Winston-Salem' WHEN 2 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' 2Nd' END AS city FROM customer""")
def title_case_place(spark, sf):
    m = F.col("c_custkey") % 4
    raw = F.when(m == 0, F.concat(F.lit("O'FALLON "), "c_mktsegment")).when(m == 1, " WINSTON-SALEM ").when(
        m == 2, F.concat(F.col("c_mktsegment"), F.lit(" 2nd"))).otherwise("  ")
    return table(spark, sf, "customer").select("c_custkey", labels.title_case(raw).alias("city"))


def _taxonomy_columns():
    """Grouping, classification and specialization built from part columns."""
    t, b = F.col("p_type"), F.pmod(F.col("p_size"), F.lit(7))
    grouping = F.when(b == 0, "Dental Providers").when(b == 1, "Behavioral Health & Social Service Providers").otherwise(
        "Allopathic & Osteopathic Physicians")
    cls = (F.when(b == 0, F.when(t == "PROMO", "Dentist").otherwise("Dental Hygienist")).when(b == 1, "Counselor")
           .when(b == 2, "Family Medicine").when(b == 3, "Obstetrics & Gynecology").when(b == 4, "Psychiatry & Neurology")
           .when(b == 5, "Nurse Practitioner").otherwise("Surgery"))
    spec = F.when(t == "PROMO", "Psychiatry").when(t == "LARGE", "Psychiatric/Mental Health").otherwise("General")
    return grouping, cls, spec


CLASS_SQL = """CASE p_size % 7 WHEN 0 THEN CASE WHEN p_type = 'PROMO' THEN 'dental' ELSE 'other' END WHEN 1 THEN 'mental_health'
  WHEN 2 THEN 'primary_care' WHEN 3 THEN 'obgyn' WHEN 4 THEN CASE WHEN p_type = 'PROMO' THEN 'mental_health' ELSE 'specialist' END
  WHEN 5 THEN CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'mental_health' ELSE 'primary_care' END
  ELSE 'specialist' END"""


@S.query("classify_taxonomy", f"SELECT p_partkey, {CLASS_SQL} AS pclass FROM part")
def classify_taxonomy(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.provider_class(*_taxonomy_columns()).alias("pclass"))


@S.query("keyword_flags", "SELECT doc_id, " + ", ".join(
    f"({' OR '.join(f'''contains(lower(text), '{w}')''' for w in ws)}) AS {n}" for n, ws in labels.FACILITY_FLAGS.items()) + " FROM documents")
def keyword_flags(spark, sf):
    blob = F.to_json(F.struct("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in labels.facility_flags(blob).items()])


PREFIXES = ["ECON", "PRO", "MEDIUM A"]


@S.query("code_prefix_flag", "SELECT p_partkey, (" + " OR ".join(f"starts_with(upper(p_type), '{p}')" for p in PREFIXES) + ") AS hit FROM part")
def code_prefix_flag(spark, sf):
    return table(spark, sf, "part").select("p_partkey", keys.starts_with_any(F.lower("p_type"), PREFIXES).alias("hit"))


def _range_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN '{s}'" for s, lo, hi in states.PREFIX_RANGES) + " END"


def _code_case(col: str, field: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{r[0]}' THEN '{r[field]}'" for r in states.STATE_CODES) + " END"


@S.query("prefix_range_state", with_sql(AREAS_SQL) + f"SELECT area, {_range_case('CAST(substr(zip, 1, 3) AS INTEGER)')} AS state_guess FROM areas")
def prefix_range_state(spark, sf):
    return states.with_prefix_state(R.area_stage(spark, sf).select("area", "zip"), "zip", "state_guess").select("area", "state_guess")


@S.query("fips_state", with_sql(AREAS_SQL) + f"""SELECT area, {_code_case('substr(county_fips, 1, 2)', 1)} AS fips_state,
  {_code_case('substr(county_fips, 1, 2)', 2)} AS state_name FROM areas""")
def fips_state(spark, sf):
    df = R.area_stage(spark, sf).select("area", "county_fips")
    return states.with_fips_state(df, "county_fips").select("area", "fips_state", "state_name")


_NAMES = "CASE st " + " ".join(f"WHEN '{r[1]}' THEN '{r[2]}'" for r in states.STATE_CODES) + " END"


@S.query("state_coalesce", with_sql(AREAS_SQL) + f"""SELECT area, st AS state, {_NAMES} AS state_name FROM (SELECT area,
  coalesce({_code_case('substr(county_fips, 1, 2)', 1)}, {_range_case('CAST(substr(zip, 1, 3) AS INTEGER)')}) AS st FROM areas)""")
def state_coalesce(spark, sf):
    df = R.area_stage(spark, sf).select("area", "zip", "county_fips")
    return states.with_state(df, "zip", "county_fips").select("area", "state", "state_name")


@S.query("subset_by_prefix_ranges", with_sql(AREAS_SQL) + """SELECT area, zip FROM areas
  WHERE CAST(substr(zip, 1, 3) AS INTEGER) BETWEEN 750 AND 799 OR CAST(substr(zip, 1, 3) AS INTEGER) = 885""")
def subset_by_prefix_ranges(spark, sf):
    df = R.area_stage(spark, sf).select("area", "zip")
    return df.where(states.in_region(F.col("zip"), "tx"))


@S.query("geo_bounds_filter", with_sql(SITES_SQL) + "SELECT site, lat, lon FROM sites WHERE s_acctbal > 0 AND lat BETWEEN 17 AND 72 AND lon BETWEEN -180 AND -64")
def geo_bounds_filter(spark, sf):
    s = R.sites(spark, sf).withColumn("status", F.when(F.col("s_acctbal") > 0, " Active ").otherwise("Closed"))
    ok = (F.lower(F.trim("status")) == "active") & F.col("lat").between(17, 72) & F.col("lon").between(-180, -64)
    return s.where(ok).select("site", "lat", "lon")


_RATE = """SELECT o_orderkey, CASE WHEN d > 0 AND n IS NOT NULL THEN least(1.0, greatest(0.0, n / d)) END AS rate,
  CASE WHEN d > 0 AND n IS NOT NULL THEN least(1.0, greatest(0.0, (d - n) / d)) END AS complement FROM (
  SELECT o_orderkey, CASE WHEN r + a > 0 OR k > 2 THEN CAST(r + a AS DOUBLE) END AS n, CAST(k - (o_orderkey % 3) AS DOUBLE) AS d FROM (
  SELECT l_orderkey AS o_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
    count(*) AS k FROM lineitem GROUP BY 1))"""


@S.query("rate_from_members", _RATE)
def rate_from_members(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.count(F.lit(1)).alias("k"))
    known = (F.col("r") + F.col("a") > 0) | (F.col("k") > 2)
    members = [F.when(known, F.col(c).cast("double")) for c in ("r", "a")]
    den = (F.col("k") - F.col("o_orderkey") % 3).cast("double")
    return g.select("o_orderkey", numeric.member_rate(members, den).alias("rate"),
                    numeric.member_rate(members, den, complement=True).alias("complement"))


@S.query("ratio_guarded", "SELECT o_orderkey, CASE WHEN d > 0 THEN o_totalprice / d END AS ratio FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 4 - 1 AS d FROM orders)")
def ratio_guarded(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", numeric.guarded_ratio(F.col("o_totalprice"), F.col("o_orderkey") % 4 - 1).alias("ratio"))


@S.query("composition_shares", """SELECT l_orderkey, r / t AS pct_r, a / t AS pct_a, n / t AS pct_n FROM (SELECT l_orderkey,
  sum(l_quantity) AS t, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n FROM lineitem GROUP BY 1)""")
def composition_shares(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("t"), *[
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == v, F.col("l_quantity"))), F.lit(0.0)).alias(v.lower()) for v in "RAN"])
    return g.select("l_orderkey", *[numeric.member_rate([F.col(v)], F.col("t")).alias(f"pct_{v}") for v in "ran"])


@S.query("proportion_se", with_sql(AREAS_SQL) + """SELECT area, round(sqrt((n_orders*n_orders + 9.0) + rate*rate*16.0) / n_lines / 1.645, 9) AS se
  FROM areas WHERE n_lines > 0""")
def proportion_se(spark, sf):
    df = R.area_stage(spark, sf).where(F.col("n_lines") > 0)
    num = numeric.root_sum_square([F.col("n_orders").cast("double"), F.lit(3.0)])
    return df.select("area", F.round(numeric.proportion_se(num, F.lit(4.0), F.col("rate"), F.col("n_lines")), 9).alias("se"))


@S.query("input_cv", with_sql(AREAS_SQL) + """SELECT area, round(CASE WHEN k > 0 THEN s / k END, 9) AS cv FROM (SELECT area,
  coalesce(a, 0) + coalesce(b, 0) AS s, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS k FROM (SELECT area,
  CASE WHEN rate > 0 THEN least(2.0, greatest(0.0, rate_se / rate)) END AS a,
  CASE WHEN rate2 > 0 THEN least(2.0, greatest(0.0, rate2_se / rate2)) END AS b FROM areas))""")
def input_cv(spark, sf):
    cv = numeric.input_cv([(F.col("rate"), F.col("rate_se")), (F.col("rate2"), F.col("rate2_se"))])
    return R.area_stage(spark, sf).select("area", F.round(cv, 9).alias("cv"))


@S.query("per_capita_flags", with_sql(SCORED_SQL) + "SELECT area, round(primary_per_1k, 6) AS primary_per_1k, low_confidence, institutional FROM scored")
def per_capita_flags(spark, sf):
    df = scoring.with_flags(R.area_stage(spark, sf), "population", "providers_total", "providers_primary", 600.0)
    return df.select("area", F.round("primary_per_1k", 6).alias("primary_per_1k"), "low_confidence", "institutional")


@S.query("safetynet_barrier", with_sql(AREAS_SQL) + f"SELECT area, round({R.pct_sql('m_price')} / 100.0 * rate, 9) AS barrier FROM areas WHERE m_price IS NOT NULL")
def safetynet_barrier(spark, sf):
    df = with_percentile(R.area_stage(spark, sf).select("area", "m_price", "rate"), "m_price", "p")
    return df.where(F.col("m_price").isNotNull()).select("area", F.round(F.col("p") / 100.0 * F.col("rate"), 9).alias("barrier"))


@S.query("orient", with_sql(AREAS_SQL) + "SELECT area, -m_balance AS balance, (SELECT max(o_price) FROM areas) - o_price AS price_worse FROM areas")
def orient(spark, sf):
    df = R.area_stage(spark, sf)
    top = df.agg(F.max("o_price").alias("top"))
    return df.join(F.broadcast(top)).select("area", (-F.col("m_balance")).alias("balance"), (F.col("top") - F.col("o_price")).alias("price_worse"))


@S.query("tier", with_sql(SCORED_SQL) + "SELECT area, tier FROM scored")
def tier(spark, sf):
    return R.scored(spark, sf).select("area", numeric.tier(F.col("pctile"), F.col("scoreable")).cast("int").alias("tier"))


def _band(c):
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} >= 66 THEN 'high' WHEN {c} <= 33 THEN 'low' ELSE 'moderate' END"


@S.query("band_labels", with_sql(SCORED_SQL) + f"""SELECT area, {_band('need_pctile')} AS need_band, CASE WHEN pctile IS NULL THEN NULL
  WHEN pctile >= 80 THEN 'Highest' WHEN pctile >= 60 THEN 'High' WHEN pctile >= 40 THEN 'Moderate' WHEN pctile >= 20 THEN 'Low'
  ELSE 'Lowest' END AS severity FROM scored""")
def band_labels(spark, sf):
    return R.scored(spark, sf).select("area", labels.band(F.col("need_pctile")).alias("need_band"), labels.severity(F.col("pctile")).alias("severity"))


_PROFILE = """SELECT area, CASE WHEN access_pctile IS NULL OR need IS NULL THEN NULL WHEN need - access_pctile >= 15 THEN 'need-driven'
  WHEN need - access_pctile <= -15 THEN 'access-driven' ELSE 'both' END AS kind FROM (SELECT area, access_pctile,
  (coalesce(need_pctile, 0) * 0.35 + coalesce(vulnerability_pctile, 0) * 0.3) / nullif(CASE WHEN need_pctile IS NULL THEN 0.0 ELSE 0.35 END
  + CASE WHEN vulnerability_pctile IS NULL THEN 0.0 ELSE 0.3 END, 0) AS need FROM scored)"""


@S.query("profile_kind", with_sql(SCORED_SQL) + _PROFILE)
def profile_kind(spark, sf):
    kind = labels.profile_kind([(F.col("need_pctile"), 0.35), (F.col("vulnerability_pctile"), 0.30)], F.col("access_pctile"))
    return R.scored(spark, sf).select("area", kind.alias("kind"))


_PARTS = [("health need", "need_pctile", 0.35), ("social vulnerability", "vulnerability_pctile", 0.3), ("barriers to care", "access_pctile", 0.35)]
DRIVER_CTE = "drv AS (SELECT area, label, pos, score, coalesce(v, 0.0) * w / wsum AS c FROM (SELECT area, score, label, pos, v, w, " \
    "sum(CASE WHEN v IS NULL THEN 0.0 ELSE w END) OVER (PARTITION BY area) AS wsum FROM (" + " UNION ALL ".join(
        f"SELECT area, score, '{lab}' AS label, {i} AS pos, {c} AS v, {w} AS w FROM scored" for i, (lab, c, w) in enumerate(_PARTS)) + ")))"


@S.query("driver_sentence", with_sql(SCORED_SQL, DRIVER_CTE, """
top AS (SELECT area, max(label) FILTER (WHERE r = 1) AS l1, max(label) FILTER (WHERE r = 2) AS l2, max(c) FILTER (WHERE r = 1) / sum(c) AS s0,
  max(c) FILTER (WHERE r = 2) / sum(c) AS s1, max(c) FILTER (WHERE r = 3) / sum(c) AS s2
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY c DESC, pos) AS r FROM drv WHERE score IS NOT NULL) GROUP BY area)""") + f"""
SELECT area, upper(substr(a, 1, 1)) || substr(a, 2) || ' health need, ' || b || ' social vulnerability, and ' || d ||
 ' barriers to care. The access disadvantage here is ' || CASE WHEN s0 IS NULL THEN 'driven by several factors together'
 WHEN s0 - s1 >= 0.1 THEN 'driven mostly by ' || l1 WHEN s0 - s2 < 0.1 THEN 'driven roughly equally across the dimensions'
 ELSE 'driven mainly by ' || l1 || ' and ' || l2 END || '.' AS sentence FROM (SELECT area, {_band('need_pctile')} AS a,
 {_band('vulnerability_pctile')} AS b, {_band('access_pctile')} AS d FROM scored) LEFT JOIN top USING (area)""")
def driver_sentence(spark, sf):
    parts = scoring.contributions(DIMS, F.col("score"))
    tail = labels.driver_tail([(lab, parts[c]) for lab, c, _ in _PARTS])
    s = labels.sentence(F.col("need_pctile"), F.col("vulnerability_pctile"), F.col("access_pctile"), tail)
    return R.scored(spark, sf).select("area", s.alias("sentence"))


@S.query("standardize", with_sql(AREAS_SQL) + """SELECT area, round((m_balance - m) / s, 8) AS z FROM areas,
  (SELECT avg(m_balance) AS m, stddev_samp(m_balance) AS s FROM areas)""")
def standardize_query(spark, sf):
    return standardize(R.area_stage(spark, sf), "m_balance", "z").select("area", F.round("z", 8).alias("z"))


@S.query("outlier_trim", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_totalprice < (SELECT quantile_cont(o_totalprice, 0.999) FROM orders)")
def outlier_trim_query(spark, sf):
    return outlier_trim(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


QUERIES, SQL = S.queries, S.sql
