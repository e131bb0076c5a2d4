"""Correlation, reliability, weighting and audit reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import AREAS_SQL, DIMS, MODEL, OUTCOMES, SCORED_SQL, SUBS, pct_sql, table, with_sql
from zonometry.operators import crosswalk as xw
from zonometry.operators import resample, stats
from zonometry.operators.joins import having_min_members
from zonometry.operators.rank import exact_quantiles
from zonometry.plans import validate as val

S = Section()
D = list(DIMS)


def good(spark, sf):
    return R.scored(spark, sf).where("scoreable").withColumn("o_blend", F.col("o_price") + 25 * F.col("m_unit"))


GOOD_SQL = "good AS (SELECT *, o_price + 25 * m_unit AS o_blend FROM scored WHERE scoreable)"


def r6(df, *cols, n=6):
    """Round the named columns, keep the rest."""
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


@S.query("pearson", with_sql(SCORED_SQL, GOOD_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(CASE WHEN regr_count({x}, {y}) >= 100 THEN corr({x}, {y}) END, 6) AS r, CAST(regr_count({x}, {y}) AS BIGINT) AS n FROM good"
    for x in ["score", *D] for y in OUTCOMES))
def pearson(spark, sf):
    return r6(stats.correlations(good(spark, sf), ["score", *D], OUTCOMES, min_pairs=100), "r")


def _wcorr_sql(x, y, w, frm, floor):
    return f"""(SELECT CASE WHEN count(*) >= {floor} THEN sum(w * (a - am) * (b - bm)) / sqrt(sum(w * (a - am) * (a - am)) * sum(w * (b - bm) * (b - bm))) END FROM
  (SELECT {x} AS a, {y} AS b, {w} AS w, sum({x} * {w}) OVER () / sum({w}) OVER () AS am, sum({y} * {w}) OVER () / sum({w}) OVER () AS bm
   FROM {frm} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {w} > 0))"""


@S.query("weighted_pearson", with_sql(SCORED_SQL, GOOD_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, 'o_price' AS y, round({_wcorr_sql(x, 'o_price', 'population', 'good', 50)}, 6) AS r" for x in ["score", *D]))
def weighted_pearson(spark, sf):
    out = stats.weighted_correlations(good(spark, sf), [(x, "o_price") for x in ["score", *D]], "population")
    return r6(out.select("x", "y", "r"), "r")


def partial_sql(y, c, z1, z2, frm):
    """First-order partials of y, c and z2 given z1, then given z2."""
    return f"""(SELECT (ryc - ry2 * rc2) / sqrt((1 - ry2 * ry2) * (1 - rc2 * rc2)) FROM (SELECT
   (yc - y1 * c1) / sqrt((1 - y1 * y1) * (1 - c1 * c1)) AS ryc, (y2 - y1 * z12) / sqrt((1 - y1 * y1) * (1 - z12 * z12)) AS ry2,
   (c2 - c1 * z12) / sqrt((1 - c1 * c1) * (1 - z12 * z12)) AS rc2 FROM (SELECT corr({y}, {c}) AS yc, corr({y}, {z1}) AS y1, corr({c}, {z1}) AS c1,
   corr({y}, {z2}) AS y2, corr({c}, {z2}) AS c2, corr({z1}, {z2}) AS z12 FROM {frm}
   WHERE {y} IS NOT NULL AND {c} IS NOT NULL AND {z1} IS NOT NULL AND {z2} IS NOT NULL)))"""


@S.query("partial_corr", with_sql(SCORED_SQL, GOOD_SQL) + " UNION ALL ".join(
    f"SELECT '{y}' AS outcome, round({partial_sql(y, D[2], D[0], D[1], 'good')}, 6) AS partial_r" for y in OUTCOMES))
def partial_corr(spark, sf):
    g = good(spark, sf)
    parts = [stats.partial_corr(g, y, D[2], D[:2]).select(F.lit(y).alias("outcome"), F.round("partial_r", 6).alias("partial_r")) for y in OUTCOMES]
    return reduce(lambda a, b: a.unionByName(b), parts)


_COMPLETE = "(SELECT * FROM scored WHERE " + " AND ".join(f"{d} IS NOT NULL" for d in D) + ")"


@S.query("corr_matrix", with_sql(SCORED_SQL) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {_COMPLETE}" for i, a in enumerate(D) for b in D[i + 1:]))
def corr_matrix(spark, sf):
    return r6(val.corr_matrix(R.scored(spark, sf), D), "r")


EIG_SQL = f"""
cm AS (SELECT corr({D[0]}, {D[1]}) AS a, corr({D[0]}, {D[2]}) AS b, corr({D[1]}, {D[2]}) AS c,
  corr({D[0]}, score) AS r0, corr({D[1]}, score) AS r1, corr({D[2]}, score) AS r2 FROM {_COMPLETE} WHERE score IS NOT NULL),
ev AS (SELECT *, 1 + 2 * p * cos(acos(greatest(-1.0, least(1.0, 2 * a * b * c / (p * p * p) / 2))) / 3) AS l
  FROM (SELECT *, sqrt(2 * (a * a + b * b + c * c) / 6) AS p FROM cm)),
vec AS (SELECT *, a * c - b * (1 - l) AS v0, a * b - (1 - l) * c AS v1, (1 - l) * (1 - l) - a * a AS v2 FROM ev)
"""


@S.query("effective_dims", with_sql(SCORED_SQL, EIG_SQL) + "SELECT round(l / 3, 6) AS pc1_share, round(9 / (3 + 2 * (a * a + b * b + c * c)), 6) AS participation_ratio FROM vec")
def effective_dims(spark, sf):
    return r6(val.effective_dimensions(R.scored(spark, sf), D, "score").select("pc1_share", "participation_ratio"), "pc1_share", "participation_ratio")


@S.query("pc1_corr", with_sql(SCORED_SQL, EIG_SQL) + "SELECT round(abs(v0 * r0 + v1 * r1 + v2 * r2) / sqrt(v0 * v0 + v1 * v1 + v2 * v2) / sqrt(l), 6) AS pc1_corr, abs(v0 * r0 + v1 * r1 + v2 * r2) / sqrt(v0 * v0 + v1 * v1 + v2 * v2) / sqrt(l) > 0.99 AS composite_is_pc1 FROM vec")
def pc1_corr(spark, sf):
    out = val.effective_dimensions(R.scored(spark, sf), D, "score")
    return out.select(F.round("pc1_corr", 6).alias("pc1_corr"), (F.col("pc1_corr") > 0.99).alias("composite_is_pc1"))


@S.query("outcome_anchor", with_sql(SCORED_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, round(corr({x}, o_price), 6) AS r FROM {_COMPLETE} WHERE scoreable AND o_price IS NOT NULL" for x in ["score", *D]))
def outcome_anchor(spark, sf):
    full = good(spark, sf).dropna(subset=["score", "o_price", *D])
    return r6(stats.correlations(full, ["score", *D], ["o_price"], min_pairs=100).select("x", "r"), "r")


@S.query("lens_diag", with_sql(SCORED_SQL, GOOD_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM good" for x in ("resid_pctile", D[2]) for y in (D[0], D[1], "o_price")))
def lens_diag(spark, sf):
    out = stats.correlations(good(spark, sf), ["resid_pctile", D[2]], [D[0], D[1], "o_price"], min_pairs=101)
    return r6(out.select("x", "y", "r"), "r")


_LONG_R = "lr AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, CASE WHEN regr_count({x}, {y}) >= 100 THEN corr({x}, {y}) END AS r FROM good" for x in ["score", *SUBS] for y in OUTCOMES) + ")"


@S.query("mean_r", with_sql(SCORED_SQL, GOOD_SQL, _LONG_R) + "SELECT x, round(avg(r), 6) AS mean_r FROM lr GROUP BY 1")
def mean_r(spark, sf):
    return r6(val.mean_r(stats.correlations(good(spark, sf), ["score", *SUBS], OUTCOMES, min_pairs=100), "x"), "mean_r")


@S.query("mean_abs_r", with_sql(SCORED_SQL, GOOD_SQL, _LONG_R) + "SELECT x, round(avg(abs(r)), 6) AS mean_abs_r FROM lr GROUP BY 1")
def mean_abs_r(spark, sf):
    return r6(val.mean_r(stats.correlations(good(spark, sf), ["score", *SUBS], OUTCOMES, min_pairs=100), "x", absolute=True), "mean_abs_r")


def _mean_of(cols):
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    return f"round((0 + {' + '.join(f'coalesce({c}, 0.0)' for c in cols)}) / ({n}), 9)"


VARIANTS = {"full": D, **{f"drop_{d}": [c for c in D if c != d] for d in D}}
VARIANT_SQL = "vr AS (" + " UNION ALL ".join(f"SELECT area, {', '.join(OUTCOMES)}, '{n}' AS variant, {_mean_of(c)} AS v FROM good" for n, c in VARIANTS.items()) + ")"


@S.query("drop_one_margin", with_sql(SCORED_SQL, GOOD_SQL, VARIANT_SQL, f"""
vp AS (SELECT *, {pct_sql('v', 'variant')} AS p FROM vr WHERE v IS NOT NULL),
vm AS (SELECT variant, ({' + '.join(f'corr(p, {o})' for o in OUTCOMES)}) / {len(OUTCOMES)} AS m FROM vp GROUP BY 1)""") + "SELECT variant, round(m, 6) AS mean_r, round((SELECT m FROM vm WHERE variant = 'full') - m, 6) AS margin FROM vm")
def drop_one_margin(spark, sf):
    return r6(val.drop_one(good(spark, sf), D, OUTCOMES), "mean_r", "margin")


@S.query("subscore_signal", with_sql(SCORED_SQL, GOOD_SQL, _LONG_R) + "SELECT x, round(avg(abs(r)), 6) AS mean_abs_r, coalesce(bool_or(r < -0.05), false) AS wrong_sign FROM lr WHERE x <> 'score' GROUP BY 1")
def subscore_signal(spark, sf):
    return r6(val.subscore_signal(good(spark, sf), SUBS, OUTCOMES), "mean_abs_r")


COUNTY_SQL = "cty AS (SELECT county_fips, " + ", ".join(
    f"sum({c} * population) FILTER (WHERE {c} IS NOT NULL AND population > 0) / sum(population) FILTER (WHERE {c} IS NOT NULL AND population > 0) AS {c}"
    for c in ["score", *D, *SUBS, *OUTCOMES, "m_unit", "o_blend"]) + ", sum(population) AS cpop FROM good GROUP BY 1)"


def counties(spark, sf):
    def build():
        g = good(spark, sf)
        means = xw.weighted_mean_by(g, "county_fips", ["score", *D, *SUBS, *OUTCOMES, "m_unit", "o_blend"], "population")
        return means.join(g.groupBy("county_fips").agg(F.sum("population").alias("cpop")), "county_fips")

    return R.once(spark, sf, "county-stage", build)


@S.query("group_collapsed_r", with_sql(SCORED_SQL, GOOD_SQL, "cm AS (SELECT county_fips, avg(score) AS score, " + ", ".join(f"avg({o}) AS {o}" for o in OUTCOMES) + " FROM good GROUP BY 1)") + " UNION ALL ".join(
    f"SELECT '{o}' AS y, round(corr(score, {o}), 6) AS r, count(*) AS n FROM cm" for o in OUTCOMES))
def group_collapsed_r(spark, sf):
    out = val.group_collapsed(good(spark, sf), "county_fips", "score", OUTCOMES, min_pairs=10)
    return r6(out.select("y", "r", "n"), "r")


ITEMS = [m.column for _, m in MODEL.measures]
SPLITS = 200


def split_sql(value_sql: str, items: list[str], splits: int, seed: int) -> str:
    lit = "[" + ", ".join(f"'{i}'" for i in items) + "]"
    return f"""
asg AS (SELECT split, item, CASE WHEN row_number() OVER (PARTITION BY split ORDER BY md5('{seed}|' || split || '|' || item), item) <= {len(items) // 2} THEN 0 ELSE 1 END AS half
  FROM range(0, {splits}) s(split), unnest({lit}) t(item)),
hm AS (SELECT split, area, avg(pctile) FILTER (WHERE half = 0) AS a, avg(pctile) FILTER (WHERE half = 1) AS b FROM ({value_sql}) JOIN asg USING (item) GROUP BY 1, 2),
sh AS (SELECT split, corr(a, b) AS r FROM hm WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
"""


@S.query("split_half", with_sql(SCORED_SQL, split_sql("SELECT area, item, pctile FROM mem", ITEMS, SPLITS, 7)) + "SELECT CAST(split AS INTEGER) AS split, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS stepped FROM sh")
def split_half(spark, sf):
    from catalog.scoring import _members

    out = resample.split_half(_members(spark, sf), "area", "item", "pctile", ITEMS, SPLITS, 7)
    return r6(out.select("split", "r", "stepped"), "r", "stepped")


_LOW = "SELECT mem.area, mem.item, mem.pctile FROM mem JOIN scored ON scored.area = mem.area WHERE scored.population < (SELECT quantile_cont(population, 0.5) FROM scored)"


@S.query("reliability", with_sql(SCORED_SQL, split_sql("SELECT area, item, pctile FROM mem", ITEMS, SPLITS, 7),
         split_sql(_LOW, ITEMS, SPLITS, 7).replace("asg AS", "asg2 AS").replace("JOIN asg USING", "JOIN asg2 USING").replace("hm AS", "hm2 AS").replace("FROM hm WHERE", "FROM hm2 WHERE").replace("sh AS", "sh2 AS"))
         + "SELECT 'overall' AS areas, round(avg(2 * r / (1 + r)), 6) AS stepped, count(*) AS n_splits FROM sh UNION ALL SELECT 'low population', round(avg(2 * r / (1 + r)), 6), count(*) FROM sh2")
def reliability(spark, sf):
    """Mean stepped-up split-half r, of all areas and of those below the median population."""
    from catalog.scoring import _members

    members = _members(spark, sf)
    areas = R.scored(spark, sf).select("area", "population")
    middle = exact_quantiles(areas, "population", [0.5], names=["middle"]).select("middle")
    low = areas.join(F.broadcast(middle)).where("population < middle").select("area")  # one row
    parts = []
    for name, rows in (("overall", members), ("low population", members.join(low, "area", "left_semi"))):
        halves = resample.split_half(rows, "area", "item", "pctile", ITEMS, SPLITS, 7)
        parts.append(halves.agg(F.avg("stepped").alias("stepped"), F.count("stepped").alias("n_splits")).withColumn("areas", F.lit(name)))
    return r6(parts[0].unionByName(parts[1]), "stepped").select("areas", "stepped", "n_splits")


RULERS = ["m_unit", "o_blend", "o_price"]
_RULERS = [("m_unit", "o_blend"), ("m_unit", "o_price"), ("o_blend", "o_price")]
_PF_SQL = "pf AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_wcorr_sql(x, y, 'cpop', 'cty', 10)} AS r" for x, y in _RULERS) + ")"
_REL_SQL = """
rl AS (SELECT (SELECT r FROM pf WHERE x = 'm_unit' AND y = 'o_blend') AS ub, (SELECT r FROM pf WHERE x = 'm_unit' AND y = 'o_price') AS up,
  (SELECT r FROM pf WHERE x = 'o_blend' AND y = 'o_price') AS bp),
rel AS (SELECT 'm_unit' AS ruler, least(1.0, greatest(0.0, ub * up / bp)) AS reliability FROM rl WHERE bp > 0
  UNION ALL SELECT 'o_blend', least(1.0, greatest(0.0, ub * bp / up)) FROM rl WHERE up > 0
  UNION ALL SELECT 'o_price', least(1.0, greatest(0.0, up * bp / ub)) FROM rl WHERE ub > 0)
"""


@S.query("parallel_forms", with_sql(SCORED_SQL, GOOD_SQL, COUNTY_SQL, _PF_SQL, _REL_SQL) + "SELECT ruler, round(reliability, 6) AS reliability FROM rel")
def parallel_forms(spark, sf):
    pairs = stats.weighted_correlations(counties(spark, sf), _RULERS, "cpop", min_pairs=10)
    return r6(val.parallel_forms(pairs), "reliability")


@S.query("disattenuate", with_sql(SCORED_SQL, GOOD_SQL, COUNTY_SQL, _PF_SQL, _REL_SQL, split_sql("SELECT area, item, pctile FROM mem", ITEMS, SPLITS, 7), """
ix AS (SELECT 2 * m / (1 + m) AS ir FROM (SELECT avg(r) AS m FROM sh)),
ob AS (""" + " UNION ALL ".join(f"SELECT '{o}' AS ruler, {_wcorr_sql('score', o, 'cpop', 'cty', 10)} AS r" for o in RULERS) + ")") + """
SELECT ruler, round(r, 6) AS r, round(reliability, 6) AS reliability, round(least(1.0, r / sqrt(abs(ir) * reliability)), 5) AS disattenuated FROM ob JOIN rel USING (ruler), ix WHERE reliability > 0""")
def disattenuate(spark, sf):
    from catalog.scoring import _members

    c = counties(spark, sf)
    rel = val.parallel_forms(stats.weighted_correlations(c, _RULERS, "cpop", min_pairs=10))
    halves = resample.split_half(_members(spark, sf), "area", "item", "pctile", ITEMS, SPLITS, 7).agg(F.avg("r").alias("m"))
    index = halves.select(F.abs(2 * F.col("m") / (1 + F.col("m"))).alias("index_reliability"))
    obs = stats.weighted_correlations(c, [("score", o) for o in RULERS], "cpop", min_pairs=10).select(F.col("y").alias("ruler"), "r")
    out = val.disattenuate(obs, rel, index).withColumn("disattenuated", F.round("disattenuated", 5))
    return r6(out.select("ruler", "r", "reliability", "disattenuated"), "r", "reliability")


_ANCHOR = "anc AS (" + " UNION ALL ".join(
    f"SELECT '{o}' AS anchor, '{d}' AS dim, corr({d}, {o}) AS r, {_wcorr_sql(d, o, 'cpop', 'cty', 10)} AS r_popw FROM cty" for o in OUTCOMES for d in D) + ")"


def _floor(c):
    v = f"greatest({c}, 0.0)"
    t = f"sum({v}) OVER (PARTITION BY anchor)"
    return f"round(5 + 85 * CASE WHEN {t} > 0 THEN {v} / {t} ELSE 1.0 / 3 END, 1)"


@S.query("floor_weights", with_sql(SCORED_SQL, GOOD_SQL, COUNTY_SQL, _ANCHOR) + f"SELECT anchor, dim, {_floor('r')} AS weight FROM anc")
def floor_weights(spark, sf):
    long = stats.correlations(counties(spark, sf), D, OUTCOMES, min_pairs=10).select(F.col("y").alias("anchor"), F.col("x").alias("dim"), "r")
    return stats.floor_weights(long, "anchor", "r", "weight").select("anchor", "dim", "weight")


_OTHER = "oth AS (" + " UNION ALL ".join(
    f"SELECT '{o}' AS anchor, '{kind}' AS kind, '{x}' AS item, corr({x}, {o}) AS r, {_wcorr_sql(x, o, 'cpop', 'cty', 10)} AS r_popw FROM cty"
    for o in OUTCOMES for kind, xs in (("composite", ["score"]), ("subscore", SUBS)) for x in xs) + ")"


@S.query("anchor_report", with_sql(SCORED_SQL, GOOD_SQL, COUNTY_SQL, _ANCHOR, _OTHER) + f"""SELECT anchor, 'dimension' AS kind, dim AS item, round(r, 6) AS r, round(r_popw, 6) AS r_popw, {_floor('r')} AS weight, {_floor('r_popw')} AS weight_popw FROM anc
  UNION ALL SELECT anchor, kind, item, round(r, 6), round(r_popw, 6), NULL, NULL FROM oth""")
def anchor_report(spark, sf):
    """Per outcome: r and population-weighted r of dimensions, composite and sub-scores; weights of the dimensions."""
    c = counties(spark, sf)
    others = ["score", *SUBS]
    plain = stats.correlations(c, others, OUTCOMES, min_pairs=10).select(F.col("y").alias("anchor"), F.col("x").alias("item"), "r")
    popw = stats.weighted_correlations(c, [(x, o) for x in others for o in OUTCOMES], "cpop", min_pairs=10).select(F.col("y").alias("anchor"), F.col("x").alias("item"), F.col("r").alias("r_popw"))
    rest = plain.join(popw, ["anchor", "item"], "left").select(
        "anchor", F.when(F.col("item") == "score", "composite").otherwise("subscore").alias("kind"), "item", "r", "r_popw", *[F.lit(None).cast("double").alias(w) for w in ("weight", "weight_popw")])
    a = stats.correlations(c, D, OUTCOMES, min_pairs=10).select(F.col("y").alias("anchor"), F.col("x").alias("dim"), "r")
    b = stats.weighted_correlations(c, [(d, o) for d in D for o in OUTCOMES], "cpop", min_pairs=10).select(
        F.col("y").alias("anchor"), F.col("x").alias("dim"), F.col("r").alias("r_popw"))
    both = stats.floor_weights(a.join(b, ["anchor", "dim"]), "anchor", "r", "weight")
    dims = stats.floor_weights(both, "anchor", "r_popw", "weight_popw").select("anchor", F.lit("dimension").alias("kind"), F.col("dim").alias("item"), "r", "r_popw", "weight", "weight_popw")
    return r6(dims.unionByName(rest), "r", "r_popw")


def active_sets_sql(src: str, keys: str) -> str:
    """Coefficients on standardized predictors for every active set of three, from correlations."""
    r = {(0, 1): "r01", (0, 2): "r02", (1, 2): "r12"}
    rows = [f"SELECT {keys}, " + ", ".join(f"ry{j} AS b{j}" if j == i else f"0.0 AS b{j}" for j in range(3)) + f", ry{i} * ry{i} AS gain FROM {src}" for i in range(3)]
    for (i, j), rho in r.items():
        bi, bj = f"(ry{i} - {rho} * ry{j}) / (1 - {rho} * {rho})", f"(ry{j} - {rho} * ry{i}) / (1 - {rho} * {rho})"
        b = {i: bi, j: bj}
        rows.append(f"SELECT {keys}, " + ", ".join(f"{b.get(q, '0.0')} AS b{q}" for q in range(3)) + f", {bi} * ry{i} + {bj} * ry{j} AS gain FROM {src}")
    det = "(1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12)"
    b0 = f"(ry0 * (1 - r12 * r12) - ry1 * (r01 - r02 * r12) + ry2 * (r01 * r12 - r02)) / {det}"
    b1 = f"(ry1 * (1 - r02 * r02) - ry0 * (r01 - r02 * r12) + ry2 * (r01 * r02 - r12)) / {det}"
    b2 = f"(ry2 * (1 - r01 * r01) + ry0 * (r01 * r12 - r02) + ry1 * (r01 * r02 - r12)) / {det}"
    rows.append(f"SELECT {keys}, {b0} AS b0, {b1} AS b1, {b2} AS b2, {b0} * ry0 + {b1} * ry1 + {b2} * ry2 AS gain FROM {src}")
    return (f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE b0 >= 0 AND b1 >= 0 AND b2 >= 0 AND b0 + b1 + b2 > 0 "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC) = 1")


def _fit_rows(o: str) -> str:
    return (f"SELECT '{o}' AS outcome, state, {D[0]} AS x0, {D[1]} AS x1, {D[2]} AS x2, {o} AS y FROM good WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in [*D, o]))


_MOMENTS = ("count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}, corr(x{i}, y) AS ry{i}" for i in range(3))
            + ", corr(x0, x1) AS r01, corr(x0, x2) AS r02, corr(x1, x2) AS r12")
_FIT_SQL = "fr AS (" + " UNION ALL ".join(_fit_rows(o) for o in OUTCOMES) + ")"


@S.query("nnls_fit", with_sql(SCORED_SQL, GOOD_SQL, _FIT_SQL, f"mo AS (SELECT outcome, {_MOMENTS} FROM fr GROUP BY 1 HAVING count(*) >= 200)", f"bs AS ({active_sets_sql('mo', 'outcome')})")
         + "SELECT outcome, n, round(gain, 6) AS r2, " + ", ".join(f"round(CASE WHEN b0 IS NOT NULL THEN 5 + 85 * b{i} / (b0 + b1 + b2) END, 5) AS w_{d}" for i, d in enumerate(D)) + " FROM mo LEFT JOIN bs USING (outcome)")
def nnls_fit(spark, sf):
    g = good(spark, sf)
    parts = [val.nnls_fit(g, D, o).withColumn("outcome", F.lit(o)) for o in OUTCOMES]
    out = r6(reduce(lambda a, b: a.unionByName(b), parts), "r2")
    return r6(out, *[f"w_{d}" for d in D], n=5)


@S.query("loso_cv", with_sql(SCORED_SQL, GOOD_SQL, _FIT_SQL, f"""
mo AS (SELECT outcome, u, {_MOMENTS} FROM fr JOIN (SELECT DISTINCT outcome AS oo, state AS u FROM fr) ON oo = outcome AND u <> state GROUP BY 1, 2 HAVING count(*) >= 100),
bs AS ({active_sets_sql('mo', 'outcome, u')}),
pd AS (SELECT fr.outcome, fr.y, my + sy * (b0 * (x0 - m0) / s0 + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2) AS p FROM fr JOIN mo ON mo.outcome = fr.outcome AND mo.u = fr.state JOIN bs ON bs.outcome = mo.outcome AND bs.u = mo.u),
sc AS (SELECT outcome, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS cv_r2, count(*) AS n FROM pd GROUP BY 1),
wt AS (SELECT outcome, count(*) AS n_folds, """ + ", ".join(f"avg(5 + 85 * b{i} / (b0 + b1 + b2)) AS mean_{d}, stddev_pop(5 + 85 * b{i} / (b0 + b1 + b2)) AS sd_{d}" for i, d in enumerate(D)) + " FROM bs GROUP BY 1)")
    + "SELECT outcome, round(cv_r2, 6) AS cv_r2, n_folds, n, " + ", ".join(f"round(mean_{d}, 5) AS mean_{d}, round(sd_{d}, 4) AS sd_{d}" for d in D) + " FROM sc JOIN wt USING (outcome)")
def loso_cv(spark, sf):
    g = good(spark, sf)
    parts = [val.loso_cv(g, D, o, "state").withColumn("outcome", F.lit(o)) for o in OUTCOMES]
    out = r6(reduce(lambda a, b: a.unionByName(b), parts).where(F.col("n_folds") > 0), "cv_r2")
    return r6(r6(out, *[f"mean_{d}" for d in D], n=5), *[f"sd_{d}" for d in D], n=4)


@S.query("density_confound", with_sql(SCORED_SQL, GOOD_SQL, "dq AS (SELECT *, " + " + ".join(f"CAST(population > q{i} AS INTEGER)" for i in range(1, 5)) + """ AS quintile FROM good,
 (SELECT """ + ", ".join(f"quantile_cont(population, {i / 5}) AS q{i}" for i in range(1, 5)) + " FROM good WHERE open_pctile IS NOT NULL) WHERE open_pctile IS NOT NULL AND population IS NOT NULL)") + "SELECT quintile, round(CASE WHEN regr_count(open_pctile, o_price) >= 100 THEN corr(open_pctile, o_price) END, 6) AS r FROM dq GROUP BY 1")
def density_confound(spark, sf):
    return r6(val.density_confound(good(spark, sf), "open_pctile", "o_price", "population").select("quintile", "r"), "r")


@S.query("cohen_d", with_sql(SCORED_SQL) + """SELECT n_in, n_out, CASE WHEN n_in >= 30 AND n_out >= 30 THEN round((ma - mb) / sqrt(((n_in - 1) * va + (n_out - 1) * vb) / (n_in + n_out - 2)), 6) END AS d FROM (SELECT
  avg(o_price) FILTER (WHERE low_confidence) AS ma, avg(o_price) FILTER (WHERE NOT low_confidence) AS mb, var_samp(o_price) FILTER (WHERE low_confidence) AS va,
  var_samp(o_price) FILTER (WHERE NOT low_confidence) AS vb, count(o_price) FILTER (WHERE low_confidence) AS n_in, count(o_price) FILTER (WHERE NOT low_confidence) AS n_out FROM scored)""")
def cohen_d(spark, sf):
    return r6(stats.cohen_d(R.scored(spark, sf), "o_price", F.col("low_confidence")), "d")


_PART, _FULL = "(scoreable AND n_dims_scored = 2)", "(scoreable AND n_dims_scored >= 3)"
_MISS = {
    "n_scoreable": "count_if(scoreable)", "n_non_scoreable": "count_if(NOT scoreable)",
    "non_scoreable_pop_share": "coalesce(sum(population) FILTER (WHERE NOT scoreable), 0) / sum(population)",
    "n_full": f"count_if({_FULL})", "n_partial": f"count_if({_PART})", "partial_share": f"count_if({_PART}) / count_if(scoreable)",
    **{f"missing_{d}": f"count_if({_PART} AND {d} IS NULL)" for d in D},
    "low_confidence_share_partial": f"avg(low_confidence::INT) FILTER (WHERE {_PART})", "low_confidence_share_full": f"avg(low_confidence::INT) FILTER (WHERE {_FULL})",
    "median_pop_partial": f"median(population) FILTER (WHERE {_PART})", "median_pop_full": f"median(population) FILTER (WHERE {_FULL})",
}


@S.query("missingness_audit", with_sql(SCORED_SQL) + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM scored" for n, e in _MISS.items()))
def missingness_audit(spark, sf):
    return r6(val.missingness(R.scored(spark, sf), D, "population"), "value")


_MEMBERS = {s.key: [m.column for m in s.measures] for _, s in MODEL.subscores}


@S.query("member_completeness", with_sql(SCORED_SQL, GOOD_SQL) + " UNION ALL ".join(
    f"SELECT '{k}' AS subscore, {len(c)} AS n_members, round(avg(p / {len(c)}), 6) AS mean_frac_present, round(avg((p = {len(c)})::INT), 6) AS pct_full FROM (SELECT {' + '.join(f'({x} IS NOT NULL)::INT' for x in c)} AS p FROM good) WHERE p > 0"
    for k, c in _MEMBERS.items()))
def member_completeness(spark, sf):
    return r6(val.member_completeness(good(spark, sf), _MEMBERS), "mean_frac_present", "pct_full")


@S.query("bh_fdr", """WITH c AS (SELECT o_orderpriority || '|' || o_orderstatus AS k, (1 + count(*) FILTER (WHERE o_totalprice < 20000)) / (1.0 + count(*)) / 4 AS p FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM c)
SELECT k, round(least(1.0, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q_value FROM r""")
def bh_fdr(spark, sf):
    k = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    p = (1 + F.count_if(F.col("o_totalprice") < 20000)) / (1.0 + F.count(F.lit(1))) / 4
    c = table(spark, sf, "orders").groupBy(k.alias("k")).agg(p.alias("p"))
    return r6(stats.bh_fdr(c, "k", "p").select("k", "q_value"), "q_value", n=8)


WITHIN_SQL = "wi AS (SELECT *, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY county_fips) AS {c}_w" for c in ["score", *D, *OUTCOMES, "m_balance"]) + " FROM (SELECT * FROM good QUALIFY count(*) OVER (PARTITION BY county_fips) >= 3))"


@S.query("within_r", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS pooled, round(corr({x}_w, {y}_w), 6) AS within, round({_wcorr_sql(f'{x}_w', f'{y}_w', 'population', 'wi', 50)}, 6) AS within_weighted FROM wi"
    for x in ["score", *D] for y in OUTCOMES))
def within_r(spark, sf):
    out = val.within_r(good(spark, sf), ["score", *D], OUTCOMES, "county_fips", "population", min_members=3)
    return r6(out.drop("n"), "pooled", "within", "within_weighted")


def _p1(x, y, z, frm):
    return f"""(SELECT (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) FROM (SELECT corr({x}, {y}) AS a, corr({x}, {z}) AS b, corr({y}, {z}) AS c FROM {frm}
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {z} IS NOT NULL))"""


@S.query("age_adjusted_within_r", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL) + " UNION ALL ".join(
    f"SELECT '{x}' AS x, round({_p1(f'{x}_w', 'o_price_w', 'm_balance_w', 'wi')}, 6) AS r" for x in ["score", *D]))
def age_adjusted_within_r(spark, sf):
    out = val.adjusted_within_r(good(spark, sf), ["score", *D], "o_price", "m_balance", "county_fips")
    return r6(out.select("x", "r"), "r")


@S.query("wrong_sign_share", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL) + """SELECT count(r) AS n, round(median(r), 6) AS median_r, avg((r < 0)::INT) AS negative_share FROM (SELECT state, corr(access_pctile_w, o_price_w) AS r
  FROM wi GROUP BY 1 HAVING count(DISTINCT county_fips) >= 5 AND regr_count(access_pctile_w, o_price_w) >= 50)""")
def wrong_sign_share(spark, sf):
    return r6(val.wrong_sign_share(good(spark, sf), D[2], "o_price", "county_fips", "state"), "median_r")


@S.query("scorecard", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL) + " UNION ALL ".join(
    f"SELECT '{o}' AS source, count(*) AS n, count(DISTINCT county_fips) AS counties, round(corr(score_w, {o}_w), 6) AS composite_within_r, round(corr(access_pctile_w, {o}_w), 6) AS access_within_r FROM wi" for o in OUTCOMES))
def scorecard(spark, sf):
    g = having_min_members(good(spark, sf), "county_fips", 3)
    size = g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("county_fips").alias("counties"))
    parts = []
    for o in OUTCOMES:
        w = val.within_r(g, ["score", D[2]], [o], "county_fips", min_members=3)
        row = w.groupBy(F.col("y").alias("source")).agg(
            F.max(F.when(F.col("x") == "score", F.col("within"))).alias("composite_within_r"),
            F.max(F.when(F.col("x") == D[2], F.col("within"))).alias("access_within_r"))
        parts.append(row.join(F.broadcast(size)))  # one row
    return r6(reduce(lambda a, b: a.unionByName(b), parts), "composite_within_r", "access_within_r")


@S.query("placebo_differential", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL) + " UNION ALL ".join(
    f"SELECT x, round(a, 6) AS r_sensitive, round(b, 6) AS r_placebo, round(a - b, 6) AS differential FROM (SELECT '{x}' AS x, {_p1(f'{x}_w', 'o_price_w', 'm_balance_w', 'wi')} AS a, {_p1(f'{x}_w', 'o_tax_w', 'm_balance_w', 'wi')} AS b)"
    for x in ["score", *D]))
def placebo_differential(spark, sf):
    out = val.placebo_differential(good(spark, sf), ["score", *D], "o_price", "o_tax", "m_balance", "county_fips")
    return r6(out, "r_sensitive", "r_placebo", "differential")


FS_SQL = """
fs AS (SELECT *, 100.0 * (y1 - y0) / y0 AS ch FROM (SELECT o_custkey AS id, CAST(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS DOUBLE) AS y0,
  CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS DOUBLE) AS y1 FROM orders GROUP BY 1) JOIN scored USING (id) WHERE y0 > 1),
fw AS (SELECT *, ch - avg(ch) OVER (PARTITION BY county_fips) AS ch_w, count(*) OVER (PARTITION BY county_fips) >= 3 AS big, rate2 - avg(rate2) OVER (PARTITION BY county_fips) AS rate2_w, score - avg(score) OVER (PARTITION BY county_fips) AS score_w FROM fs),
md AS (SELECT median(rate2) AS cut FROM fs)
"""
_FS = {"mean_change": "avg(ch)", "total_change": "100.0 * (sum(y1) - sum(y0)) / sum(y0)", "dose_r": "corr(ch, rate2)", "score_r": "corr(ch, score)",
       "mean_change_high_dose": "avg(ch) FILTER (WHERE rate2 >= (SELECT cut FROM md))", "mean_change_low_dose": "avg(ch) FILTER (WHERE rate2 < (SELECT cut FROM md))",
       "n": "count(*)", "p10_change": "quantile_cont(ch, 0.1)", "p50_change": "quantile_cont(ch, 0.5)", "p90_change": "quantile_cont(ch, 0.9)",
       "within_score_r": "corr(ch_w, score_w) FILTER (WHERE big)", "within_dose_r": "corr(ch_w, rate2_w) FILTER (WHERE big)"}


@S.query("first_stage_report", with_sql(SCORED_SQL, FS_SQL) + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM fw" for n, e in _FS.items())
         + f" UNION ALL SELECT 'dose_r_weighted', round({_wcorr_sql('ch', 'rate2', 'y0', 'fs', 50)}, 6) UNION ALL SELECT 'score_r_weighted', round({_wcorr_sql('ch', 'score', 'y0', 'fs', 50)}, 6)")
def first_stage_report(spark, sf):
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(cut).cast("double").alias("y0"), F.count_if(~cut).cast("double").alias("y1"))
    df = o.join(R.scored(spark, sf).select("id", "county_fips", "rate2", "score"), "id")
    return r6(val.first_stage(df, "y0", "y1", "rate2", "score", "county_fips", min_before=1), "value")


QUERIES, SQL = S.queries, S.sql
