"""Bootstraps and band gates. Draws hash to md5, so SQL can repeat them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import Section
from catalog.roles import AREAS_SQL, DIMS, MODEL, OUTCOMES, PANEL_SQL, SCORED_SQL, pct_sql, with_sql
from catalog.scoring import BAND_DRAWS, CV_SQL, SIGMAS, band_sql, noisy, u_sql
from catalog.statistics import GOOD_SQL, VARIANT_SQL, WITHIN_SQL, good, partial_sql, r6
from zonometry.functions.numeric import clip, guarded_ratio
from zonometry.operators import aggregates as agg
from zonometry.operators import panel as pn, resample, stats
from zonometry.operators.joins import having_min_members
from zonometry.operators.rank import exact_quantiles
from zonometry.plans import score as scoring
from zonometry.plans import uncertainty as unc
from zonometry.plans import validate as val
from zonometry.session import stage

S = Section()
D = list(DIMS)
REPS, RANK_REPS, SEED = 1000, 1000, 11


def blocked(spark, sf, level="county"):
    def build():
        key = resample.cluster_key(level, F.col("area"), F.col("state"), F.when(F.col("id") % 50 != 0, F.col("county_name")))
        return good(spark, sf).withColumn("block", key)

    return R.once(spark, sf, f"blocked-{level}", build)


def block_draws(spark, sf, level="county", reps=REPS):
    """The draws of the blocks, one vector a block, shared by the statistics of a level."""
    def build():
        return resample.draw_vectors(resample.block_index(blocked(spark, sf, level), "block"), "block", reps, SEED)

    return R.once(spark, sf, f"draws-{level}-{reps}", build)


_KEY = {"county": "CASE WHEN state IS NULL OR id % 50 = 0 THEN '__solo_' || area ELSE state || '|' || county_name END",
        "state": "coalesce(state, '__solo_' || area)"}


def block_sql(level: str, tag: str = "", reps: int = REPS) -> str:
    return f"""
blk{tag} AS (SELECT *, {_KEY[level]} AS block FROM good),
bi{tag} AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS idx FROM (SELECT DISTINCT block FROM blk{tag})),
pk{tag} AS (SELECT b, CAST(floor({u_sql('h', 0)} * n) AS BIGINT) AS idx, count(*) AS times FROM (SELECT b, idx, n, md5('{SEED}|' || b || '|' || idx) AS h
  FROM range(0, {reps}) r(b), bi{tag}, (SELECT count(*) AS n FROM bi{tag})) GROUP BY 1, 2),
tm{tag} AS (SELECT b AS replicate, block, times FROM pk{tag} JOIN bi{tag} USING (idx) UNION ALL SELECT -1, block, 1 FROM bi{tag})
"""


def moment_sql(tag: str, src: str, times: str, cols: list[str], least: int = 100) -> str:
    """Weighted correlations of every pair of ``cols`` per replicate of ``least`` rows or more, as columns r01, r02, ..."""
    k = len(cols)
    raw = ", ".join([f"sum(times * c{i}) AS s{i}" for i in range(k)] + [f"sum(times * c{i} * c{j}) AS s{i}{j}" for i in range(k) for j in range(i, k)])
    pick = ", ".join(f"{c} - (SELECT avg({c}) FROM {src}) AS c{i}" for i, c in enumerate(cols))
    cov = lambda i, j: f"(s{i}{j} - s{i} * s{j} / n)"
    rs = ", ".join(f"{cov(i, j)} / sqrt({cov(i, i)} * {cov(j, j)}) AS r{i}{j}" for i in range(k) for j in range(i + 1, k))
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""
mm{tag} AS (SELECT replicate, sum(times) AS n, {raw} FROM (SELECT block, {pick} FROM {src} WHERE {where}) JOIN {times} USING (block) GROUP BY 1 HAVING sum(times) >= {least}),
rr{tag} AS (SELECT replicate, {rs} FROM mm{tag})
"""


_P1 = "((r{a}{b} - r{az} * r{bz}) / sqrt((1 - r{az} * r{az}) * (1 - r{bz} * r{bz})))"


def partial2() -> str:
    """r01 given columns 2 and 3."""
    ab = "((r01 - r02 * r12) / sqrt((1 - r02 * r02) * (1 - r12 * r12)))"
    a3 = "((r03 - r02 * r23) / sqrt((1 - r02 * r02) * (1 - r23 * r23)))"
    b3 = "((r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)))"
    return f"(({ab} - {a3} * {b3}) / sqrt((1 - {a3} * {a3}) * (1 - {b3} * {b3})))"


def partial1() -> str:
    return "((r01 - r02 * r12) / sqrt((1 - r02 * r02) * (1 - r12 * r12)))"


def ci_sql(src: str, value: str, key: str = "", digits: int = 5) -> str:
    by = f"{key}, " if key else ""
    grp = f" GROUP BY {key}" if key else ""
    return f"""SELECT {by}round(max({value}) FILTER (WHERE replicate = -1), {digits}) AS point, round(quantile_cont({value}, 0.025) FILTER (WHERE replicate >= 0), {digits}) AS ci_lo,
  round(quantile_cont({value}, 0.975) FILTER (WHERE replicate >= 0), {digits}) AS ci_hi, count({value}) FILTER (WHERE replicate >= 0) AS n_boot,
  avg(({value} > 0)::INT) FILTER (WHERE replicate >= 0) AS share_positive,
  quantile_cont({value}, 0.025) FILTER (WHERE replicate >= 0) > 0 OR quantile_cont({value}, 0.975) FILTER (WHERE replicate >= 0) < 0 AS excludes_0 FROM {src}{grp}"""


def ci(statistics, value, by=None, digits=5):
    return r6(resample.intervals(statistics, value, by), "point", "ci_lo", "ci_hi", n=digits)


@S.query("cluster_key", with_sql(SCORED_SQL, GOOD_SQL) + f"SELECT area, {_KEY['county']} AS county_block, {_KEY['state']} AS state_block FROM good")
def cluster_key(spark, sf):
    county = F.when(F.col("id") % 50 != 0, F.col("county_name"))
    keys = [resample.cluster_key(lv, F.col("area"), F.col("state"), county).alias(f"{lv}_block") for lv in ("county", "state")]
    return good(spark, sf).select("area", *keys)


@S.query("block_bootstrap_ci", with_sql(SCORED_SQL, GOOD_SQL, block_sql("county"), moment_sql("", "blk", "tm", ["score", "o_price"], 0)) + ci_sql("rr", "r01"))
def block_bootstrap_ci(spark, sf):
    g = resample.bootstrap_grams(blocked(spark, sf).select("block", "score", "o_price"), ["score", "o_price"], "block", REPS, SEED, vectors=block_draws(spark, sf))
    return ci(g.select("replicate", stats.corr_of(0, 1).alias("r")), "r")


_PC = ["o_price", "access_pctile", "need_pctile", "vulnerability_pctile"]


def _partial_boot(df, cols, reps=REPS, vectors=None):
    return resample.bootstrap_partials(df, cols, "block", reps, SEED, vectors=vectors)


def rank_sql(tag: str, reps: int, outcomes: list[str]) -> str:
    """Re-ranked correlations per replicate, variant and outcome."""
    union = " UNION ALL ".join(f"SELECT replicate, variant, '{o}' AS outcome, a, CAST(times AS DOUBLE) AS w, {o} AS b FROM rk{tag} WHERE {o} IS NOT NULL" for o in outcomes)
    return block_sql("county", tag, reps) + f""",
dr{tag} AS (SELECT vr.*, replicate, times FROM vr JOIN blk{tag} USING (area) JOIN tm{tag} USING (block) WHERE v IS NOT NULL),
rk{tag} AS (SELECT *, sum(times) OVER (PARTITION BY replicate, variant ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(times) OVER (PARTITION BY replicate, variant, v) + (sum(times) OVER (PARTITION BY replicate, variant, v) + 1) / 2.0 AS a FROM dr{tag}),
lo{tag} AS ({union}),
ce{tag} AS (SELECT *, sum(a * w) OVER (PARTITION BY replicate, variant, outcome) / sum(w) OVER (PARTITION BY replicate, variant, outcome) AS am,
  sum(b * w) OVER (PARTITION BY replicate, variant, outcome) / sum(w) OVER (PARTITION BY replicate, variant, outcome) AS bm FROM lo{tag}),
rb{tag} AS (SELECT replicate, variant, outcome, sum(w * (a - am) * (b - bm)) / sqrt(sum(w * (a - am) * (a - am)) * sum(w * (b - bm) * (b - bm))) AS r FROM ce{tag} GROUP BY 1, 2, 3)
"""


def ranked(spark, sf):
    def build():
        df = blocked(spark, sf)
        return resample.ranked_replicates(df, block_draws(spark, sf, reps=RANK_REPS), "block", val.dimension_variants(D), OUTCOMES)

    return R.once(spark, sf, "ranked-replicates", build)


_RANKED = (SCORED_SQL, GOOD_SQL, VARIANT_SQL, rank_sql("q", RANK_REPS, OUTCOMES))
_MARGIN = f"""
mv AS (SELECT replicate, variant, avg(r) AS m FROM rbq GROUP BY 1, 2),
mg AS (SELECT d.replicate, d.variant, f.m - d.m AS margin FROM mv d JOIN mv f ON f.replicate = d.replicate AND f.variant = 'full' WHERE d.variant <> 'full')
"""


def _margins(spark, sf):
    m = ranked(spark, sf).groupBy("replicate", "variant").agg(F.avg("r").alias("m"))
    full = m.where(F.col("variant") == "full").select("replicate", F.col("m").alias("f"))
    return m.where(F.col("variant") != "full").join(full, "replicate").select("replicate", "variant", (F.col("f") - F.col("m")).alias("margin"))


def paired_sql(tag: str, xs: list[str], outcomes: list[str], times: str) -> str:
    """Correlations of columns with outcomes, as they are, in every replicate of 100 rows or more."""
    rows = " UNION ALL ".join(f"SELECT block, '{x}' AS x, '{o}' AS outcome, {x} - avg({x}) OVER () AS a, {o} - avg({o}) OVER () AS b FROM blkq WHERE {x} IS NOT NULL AND {o} IS NOT NULL" for x in xs for o in outcomes)
    return f"""
ps{tag} AS (SELECT block, x, outcome, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM ({rows}) GROUP BY 1, 2, 3),
pr{tag} AS (SELECT replicate, x, outcome, (sum(ab * times) - sum(a * times) * sum(b * times) / sum(n * times)) / sqrt((sum(aa * times) - pow(sum(a * times), 2) / sum(n * times)) * (sum(bb * times) - pow(sum(b * times), 2) / sum(n * times))) AS r
  FROM ps{tag} JOIN {times} USING (block) GROUP BY 1, 2, 3 HAVING sum(n * times) >= 100)
"""


_GATE = ci_sql("gr", "v", "stat, variant")


@S.query("gate_report", with_sql(*_RANKED, _MARGIN.rstrip(), paired_sql("g", ["score", *R.SUBS], OUTCOMES, "tmq"), """
gr AS (SELECT replicate, 'margin' AS stat, variant, margin AS v FROM mg UNION ALL SELECT replicate, 'mean_r', variant, m FROM mv
  UNION ALL SELECT replicate, 'r_' || outcome, variant, r FROM rbq
  UNION ALL SELECT replicate, 'composite_mean_r', x, avg(r) FROM prg WHERE x = 'score' GROUP BY replicate, x
  UNION ALL SELECT replicate, 'subscore_mean_abs_r', x, avg(abs(r)) FROM prg WHERE x <> 'score' GROUP BY replicate, x)""")
         + f"SELECT g.*, (SELECT count(*) FROM biq) AS n_clusters, (SELECT count(*) FROM good) AS n_rows FROM ({_GATE}) g")
def gate_report(spark, sf):
    """Margins of the full composite over each drop, mean and single r of the full and each drop, mean r of the composite as it
    is, mean absolute r of each sub-score, all with intervals; and how many clusters and rows they are drawn from."""
    r = ranked(spark, sf)
    margins = _margins(spark, sf).select("replicate", F.lit("margin").alias("stat"), "variant", F.col("margin").alias("v"))
    means = r.groupBy("replicate", "variant").agg(F.avg("r").alias("v")).select("replicate", F.lit("mean_r").alias("stat"), "variant", "v")
    single = r.select("replicate", F.concat(F.lit("r_"), "outcome").alias("stat"), "variant", F.col("r").alias("v"))
    rows = blocked(spark, sf)
    paired = resample.paired_replicates(rows, ["score", *R.SUBS], OUTCOMES, "block", RANK_REPS, SEED, vectors=block_draws(spark, sf, reps=RANK_REPS))
    own = F.col("x") == "score"
    kind = F.when(own, "composite_mean_r").otherwise("subscore_mean_abs_r")
    paired = paired.groupBy("replicate", kind.alias("stat"), F.col("x").alias("variant")).agg(F.avg(F.when(own, F.col("r")).otherwise(F.abs("r"))).alias("v"))
    counts = rows.agg(F.countDistinct("block").alias("n_clusters"), F.count(F.lit(1)).alias("n_rows"))
    every = stage(margins.unionByName(means).unionByName(single).unionByName(paired), "gate-replicates")
    return ci(every, "v", ["stat", "variant"]).join(F.broadcast(counts))  # one row


_FOCUS_SQL = """
am AS (SELECT d.replicate, 'marginal' AS stat, f.r - d.r AS v FROM rbq d JOIN rbq f ON f.replicate = d.replicate AND f.variant = 'full' AND f.outcome = 'o_price'
  WHERE d.variant = 'drop_access_pctile' AND d.outcome = 'o_price'),
"""


@S.query("amenable_focus", with_sql(*_RANKED, _FOCUS_SQL.strip().rstrip(","), block_sql("county", "p", RANK_REPS), moment_sql("p", "blkp", "tmp", _PC),
         f"ap AS (SELECT replicate, 'partial' AS stat, {partial2()} AS v FROM rrp UNION ALL SELECT * FROM am)") + ci_sql("ap", "v", "stat"))
def amenable_focus(spark, sf):
    r = ranked(spark, sf).where(F.col("outcome") == "o_price")
    full = r.where(F.col("variant") == "full").select("replicate", F.col("r").alias("f"))
    marg = r.where(F.col("variant") == "drop_access_pctile").join(full, "replicate").select(
        "replicate", F.lit("marginal").alias("stat"), (F.col("f") - F.col("r")).alias("v"))
    part = _partial_boot(blocked(spark, sf), _PC, RANK_REPS, block_draws(spark, sf, reps=RANK_REPS)).select("replicate", F.lit("partial").alias("stat"), F.col("stat").alias("v"))
    return ci(marg.unionByName(part), "v", ["stat"])


@S.query("spatial_sensitivity", with_sql(SCORED_SQL, GOOD_SQL, block_sql("county", "c"), moment_sql("c", "blkc", "tmc", _PC), block_sql("state", "s"), moment_sql("s", "blks", "tms", _PC),
         f"sp AS (SELECT replicate, 'county' AS level, {partial2()} AS v FROM rrc UNION ALL SELECT replicate, 'state', {partial2()} FROM rrs)") + ci_sql("sp", "v", "level"))
def spatial_sensitivity(spark, sf):
    parts = [_partial_boot(blocked(spark, sf, lv), _PC, vectors=block_draws(spark, sf, lv)).select("replicate", F.lit(lv).alias("level"), F.col("stat").alias("v")) for lv in ("county", "state")]
    return ci(reduce(lambda a, b: a.unionByName(b), parts), "v", ["level"])


@S.query("retained_fraction", with_sql(*_RANKED, """
rf AS (SELECT d.replicate, d.outcome, d.r / f.r AS v FROM rbq d JOIN rbq f ON f.replicate = d.replicate AND f.variant = 'full' AND f.outcome = d.outcome
  WHERE d.variant = 'drop_need_pctile' AND f.r <> 0)""") + ci_sql("rf", "v", "outcome", 3))
def retained_fraction(spark, sf):
    r = ranked(spark, sf)
    full = r.where((F.col("variant") == "full") & (F.col("r") != 0)).select("replicate", "outcome", F.col("r").alias("f"))
    rf = r.where(F.col("variant") == "drop_need_pctile").join(full, ["replicate", "outcome"]).select("replicate", "outcome", (F.col("r") / F.col("f")).alias("v"))
    return ci(rf, "v", ["outcome"], 3)


_SUBS = ["open_pctile", "late_pctile"]


@S.query("subscore_partials", with_sql(SCORED_SQL, GOOD_SQL, block_sql("county"), *[
    moment_sql(str(i), "blk", "tm", ["o_price", s, "need_pctile", "vulnerability_pctile"]) for i, s in enumerate(_SUBS)],
    "sps AS (" + " UNION ALL ".join(f"SELECT replicate, '{s}' AS x, {partial2()} AS v FROM rr{i}" for i, s in enumerate(_SUBS)) + ")",
    """pv AS (SELECT x, max(v) FILTER (WHERE replicate = -1) AS partial_r, (1.0 + count(*) FILTER (WHERE replicate >= 0 AND v <= 0)) / (1 + count(v) FILTER (WHERE replicate >= 0)) AS p FROM sps GROUP BY 1),
qv AS (SELECT *, row_number() OVER (ORDER BY p, x) AS i, count(*) OVER () AS m FROM pv)""")
    + "SELECT x, round(partial_r, 6) AS partial_r, round(p, 6) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM qv")
def subscore_partials(spark, sf):
    parts = [_partial_boot(blocked(spark, sf), ["o_price", s, *D[:2]], vectors=block_draws(spark, sf)).withColumn("x", F.lit(s)) for s in _SUBS]
    boot = reduce(lambda a, b: a.unionByName(b), parts)
    drawn = F.col("replicate") >= 0
    p = boot.groupBy("x").agg(
        F.max(F.when(~drawn, F.col("stat"))).alias("partial_r"),
        ((1.0 + F.count_if(drawn & (F.col("stat") <= 0))) / (1 + F.count(F.when(drawn, F.col("stat"))))).alias("p"))
    return r6(stats.bh_fdr(p, "x", "p").select("x", "partial_r", "p", "q_value"), "partial_r", "p", "q_value")


@S.query("placebo_bootstrap", with_sql(SCORED_SQL, GOOD_SQL, WITHIN_SQL, "good2 AS (SELECT *, county_fips AS block FROM wi)", f"""
bi AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS idx FROM (SELECT DISTINCT block FROM good2)),
pk AS (SELECT b, CAST(floor({u_sql('h', 0)} * n) AS BIGINT) AS idx, count(*) AS times FROM (SELECT b, idx, n, md5('{SEED}|' || b || '|' || idx) AS h
  FROM range(0, {REPS}) r(b), bi, (SELECT count(*) AS n FROM bi)) GROUP BY 1, 2),
tm AS (SELECT b AS replicate, block, times FROM pk JOIN bi USING (idx) UNION ALL SELECT -1, block, 1 FROM bi)""",
    moment_sql("a", "good2", "tm", ["score_w", "o_price_w", "m_balance_w"], 0), moment_sql("b", "good2", "tm", ["score_w", "o_tax_w", "m_balance_w"], 0),
    f"df AS (SELECT replicate, a.v - b.v AS v FROM (SELECT replicate, {partial1()} AS v FROM rra) a JOIN (SELECT replicate, {partial1()} AS v FROM rrb) b USING (replicate))") + ci_sql("df", "v"))
def placebo_bootstrap(spark, sf):
    cols = ["score", "o_price", "o_tax", "m_balance"]
    wide = having_min_members(good(spark, sf).select("county_fips", *cols), "county_fips", 3)
    w = agg.subtract_group_mean(wide, "county_fips", cols).withColumnRenamed("county_fips", "block")
    w = stage(w, "placebo-within")
    a = _partial_boot(w, ["score_within", "o_price_within", "m_balance_within"]).select("replicate", F.col("stat").alias("a"))
    b = _partial_boot(w, ["score_within", "o_tax_within", "m_balance_within"]).select("replicate", F.col("stat").alias("b"))
    return ci(a.join(b, "replicate").select("replicate", (F.col("a") - F.col("b")).alias("v")), "v")


def _band_sql(tag: str, q: float) -> str:
    """Quantile of the partial r over the replicates of one moment table."""
    return f"(SELECT quantile_cont(v, {q}) FROM (SELECT {partial2()} AS v FROM rr{tag} WHERE replicate >= 0))"


_ACCEPT = "CASE WHEN n_orders > 0 THEN least(1.5, greatest(0.0, providers_primary / n_orders)) END"


@S.query("acceptance_ratio", with_sql(SCORED_SQL, GOOD_SQL, block_sql("county", "a"), f"ar AS (SELECT *, {_ACCEPT} AS acceptance FROM blka)", moment_sql("a", "ar", "tma", ["o_price", "acceptance", D[0], D[1]]))
         + f"SELECT count(acceptance) AS n, round(avg(acceptance), 8) AS mean_acceptance, round({partial_sql('o_price', 'acceptance', D[0], D[1], 'ar')}, 6) AS partial_r, round({_band_sql('a', 0.025)}, 5) AS ci_lo, round({_band_sql('a', 0.975)}, 5) AS ci_hi FROM ar")
def acceptance_ratio(spark, sf):
    g = blocked(spark, sf).withColumn("acceptance", clip(guarded_ratio(F.col("providers_primary"), F.col("n_orders")), 0.0, 1.5))
    size = g.agg(F.count("acceptance").alias("n"), F.round(F.avg("acceptance"), 8).alias("mean_acceptance"))
    boot = resample.intervals(_partial_boot(g, ["o_price", "acceptance", *D[:2]]), "stat")
    part = boot.select(F.round("point", 6).alias("partial_r"), F.round("ci_lo", 5).alias("ci_lo"), F.round("ci_hi", 5).alias("ci_hi"))
    return size.join(F.broadcast(part))  # one row each


_CAND = ["m_balance", "m_discount", "m_quantity"]
CAND_REPS = 500


@S.query("hrsn_gate", with_sql(SCORED_SQL, GOOD_SQL, "gw AS (SELECT *, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY county_fips) AS {c}_w" for c in [*_CAND, "o_return"]) + " FROM (SELECT *, count(*) OVER (PARTITION BY county_fips) >= 3 AS big FROM good))",
         block_sql("county", "h", CAND_REPS), *[moment_sql(f"h{i}", "blkh", "tmh", ["o_price", c, D[0], D[1]]) for i, c in enumerate(_CAND)]) + " UNION ALL ".join(
    f"""SELECT x, round(raw_r, 6) AS raw_r, round(partial_r, 6) AS partial_r, round(within_r, 6) AS within_r, round(max_dim_r, 6) AS max_dim_r, round(lo, 5) AS ci_lo, round(hi, 5) AS ci_hi, CASE WHEN partial_r > 0.05 AND lo > 0 THEN 'survives' ELSE 'collapses' END AS verdict FROM (
    SELECT '{c}' AS x, corr({c}, o_price) AS raw_r, {partial_sql('o_price', c, D[0], D[1], 'good')} AS partial_r, corr({c}_w, o_return_w) FILTER (WHERE big) AS within_r, greatest(abs(corr({c}, {D[0]})), abs(corr({c}, {D[1]}))) AS max_dim_r,
    {_band_sql(f'h{i}', 0.025)} AS lo, {_band_sql(f'h{i}', 0.975)} AS hi FROM gw)""" for i, c in enumerate(_CAND)))
def hrsn_gate(spark, sf):
    out = val.candidate_gate(blocked(spark, sf), _CAND, "o_price", D[:2], "o_return", "county_fips", "block", CAND_REPS, SEED)
    return r6(out.withColumns({c: F.round(c, 5) for c in ("ci_lo", "ci_hi")}), "raw_r", "partial_r", "within_r", "max_dim_r")


PANEL_REPS = 1000


def panel_times_sql(block: str, tag: str = "") -> str:
    return f"""
pbi{tag} AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS idx FROM (SELECT DISTINCT {block} AS block FROM panel)),
ppk{tag} AS (SELECT b, CAST(floor({u_sql('h', 0)} * n) AS BIGINT) AS idx, count(*) AS times FROM (SELECT b, idx, n, md5('{SEED}|' || b || '|' || idx) AS h
  FROM range(0, {PANEL_REPS}) r(b), pbi{tag}, (SELECT count(*) AS n FROM pbi{tag})) GROUP BY 1, 2),
ptm{tag} AS (SELECT b AS replicate, block, times FROM ppk{tag} JOIN pbi{tag} USING (idx) UNION ALL SELECT -1, block, 1 FROM pbi{tag}),
cop{tag} AS (SELECT replicate, p.unit || '__' || c AS unit, year, rate, barrier * (year >= 1998)::INT AS px FROM panel p JOIN ptm{tag} ON ptm{tag}.block = p.{block}, range(1, 1000) q(c) WHERE c <= times)
"""


def did_sql(src: str, tag: str) -> str:
    """Difference-in-differences slope per replicate of a panel with ``px``."""
    return f"""
dm{tag} AS (SELECT replicate, rate - avg(rate) OVER (PARTITION BY replicate, unit) - avg(rate) OVER (PARTITION BY replicate, year) + avg(rate) OVER (PARTITION BY replicate) AS y,
  px - avg(px) OVER (PARTITION BY replicate, unit) - avg(px) OVER (PARTITION BY replicate, year) + avg(px) OVER (PARTITION BY replicate) AS x FROM {src}),
dd{tag} AS (SELECT replicate, sum(x * y) / sum(x * x) AS v FROM dm{tag} GROUP BY 1)"""


def did_boot(spark, sf, block: str):
    """(replicate, did) with whole units or whole counties drawn."""
    def build():
        p = R.panel_stage(spark, sf).select("unit", "year", "rate", "barrier", F.col(block).alias("block"))
        times = resample.draw_counts(resample.block_index(p, "block"), "block", PANEL_REPS, SEED)
        return pn.did_replicates(p, stage(times, "panel-times"), "block", "unit", "year", "rate", "barrier", 1998)

    return R.once(spark, sf, f"did-boot-{block}", build)


_DID_CI = " UNION ALL ".join(f"SELECT replicate, '{b}' AS block, v FROM dd{t}" for b, t in (("unit", ""), ("county", "k")))


@S.query("panel_cluster_bootstrap", with_sql(PANEL_SQL, panel_times_sql("unit"), panel_times_sql("county", "k"), did_sql("cop", ""), did_sql("copk", "k"), f"db AS ({_DID_CI})") + ci_sql("db", "v", "block", 4))
def panel_cluster_bootstrap(spark, sf):
    both = [did_boot(spark, sf, b).select("replicate", F.lit(b).alias("block"), "did") for b in ("unit", "county")]
    return ci(both[0].unionByName(both[1]), "did", ["block"], 4)


# ---- band gates ------------------------------------------------------------------------------

@S.query("band_gate_differentiation", with_sql(SCORED_SQL, CV_SQL, band_sql("", True), """
mw AS (SELECT median(rank_hi - rank_lo) FILTER (WHERE low_confidence) AS low, median(rank_hi - rank_lo) FILTER (WHERE NOT low_confidence) AS high FROM band)""")
    + "SELECT round(low, 4) AS low, round(high, 4) AS high, round(low / high, 4) AS ratio, low / high >= 1.6 AS ok FROM mw")
def band_gate_differentiation(spark, sf):
    df = noisy(spark, sf)
    bands = unc.rank_band(df, "area", D, SIGMAS, BAND_DRAWS).join(df.select("area", "low_confidence"), "area")
    return r6(unc.differentiation_gate(bands, "low_confidence"), "low", "high", "ratio", n=4)


@S.query("band_gate_shrinkage", with_sql(SCORED_SQL, CV_SQL, band_sql("a", True), "sig2 AS (SELECT * REPLACE (s0 * 1.5 AS s0, s1 * 1.5 AS s1, s2 * 1.5 AS s2) FROM sig)",
    band_sql("b", True).replace("FROM sig,", "FROM sig2,")) + """SELECT round(a, 4) AS width_on, round(b, 4) AS width_off, a < b AS ok FROM
 (SELECT median(rank_hi - rank_lo) AS a FROM banda WHERE low_confidence), (SELECT median(rank_hi - rank_lo) AS b FROM bandb WHERE low_confidence)""")
def band_gate_shrinkage(spark, sf):
    df = noisy(spark, sf)
    flags = df.select("area", "low_confidence")
    on = unc.rank_band(df, "area", D, SIGMAS, BAND_DRAWS).join(flags, "area")
    louder = df.withColumns({s: F.col(s) * 1.5 for s in SIGMAS})
    off = unc.rank_band(louder, "area", D, SIGMAS, BAND_DRAWS).join(flags, "area")
    return r6(unc.shrinkage_gate(on, off, "low_confidence"), "width_on", "width_off", n=4)


@S.query("band_gate_calibration")
def band_gate_calibration(spark, sf):
    """Members of the access dimension; the open share has a published error, the late share has none."""
    from catalog.scoring import _members

    df = R.scored(spark, sf)
    specs = [(s.key, m.column, m.direction) for d, s in MODEL.subscores if d.key == "access" and s.scored for m in s.measures]
    items = [c for _, c, _ in specs]
    oriented = scoring.stack(df, "area", {c: F.col(c) * k for _, c, k in specs})
    subs = {c: k for k, c, _ in specs}
    base = _members(spark, sf).where(F.col("item").isin(items)).withColumn("subscore", scoring.lookup(subs, F.col("item")))
    sub_means = base.groupBy("area", "subscore").agg(F.round(F.avg("pctile"), 9).alias("raw"))
    dim_raw = F.round((F.coalesce("open_pctile", F.lit(0.0)) + F.coalesce("late_pctile", F.lit(0.0)))
                      / (F.col("open_pctile").isNotNull().cast("int") + F.col("late_pctile").isNotNull().cast("int")), 9)
    dim_means = df.where(F.coalesce("open_pctile", "late_pctile").isNotNull()).select(F.lit("access").alias("dim"), dim_raw.alias("raw"))
    se = df.select("area", F.lit("m_open").alias("item"), F.col("rate2_se").alias("se"))
    samples = base.join(df.where("scoreable").select("area"), "area", "left_semi").join(oriented, ["area", "item"]).join(se, ["area", "item"], "left")
    samples = samples.select("area", "item", "subscore", F.lit("access").alias("dim"), F.col("pctile").alias("base"), "value", "se")
    sd = unc.resample_sd(samples, oriented.select("item", F.round("value", 9).alias("value")), sub_means.select("subscore", "raw"), dim_means, "area", BAND_DRAWS, 5)
    sig = noisy(spark, sf).select("area", F.lit("access").alias("dim"), F.col("sigma_access_pctile").alias("sigma"))
    return unc.calibration_gate(stage(sd, "resampled-sd"), sig, "area")


QUERIES, SQL = S.queries, S.sql
