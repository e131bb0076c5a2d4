"""Validation reports: the index against independent outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.operators.aggregates import subtract_group_mean, with_quantile_class
from zonometry.operators.joins import having_min_members
from zonometry.operators.rank import exact_quantiles, with_percentile
from zonometry.operators.resample import bootstrap_partials, intervals
from zonometry.operators.stats import (
    centred, correlations, corr_of, floored, gram, matrix_of, nonneg_ls, partials, safe_corr, solve_rows, weighted_correlations,
)
from zonometry.session import stage


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise correlations on rows where every column is known: (a, b, r)."""
    g = gram(centred(df, cols), cols)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr_of(i, j).alias("r"))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return g.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def effective_dimensions(df: DataFrame, dims: list[str], composite: str) -> DataFrame:
    """First-component share, participation ratio and |r| of the composite with that component."""
    import numpy as np

    cols = [*dims, composite]
    k = len(dims)

    def fit(row):
        _, _, m = matrix_of(row, k + 1)
        sd = np.sqrt(np.diag(m))
        r = m / np.outer(sd, sd)
        values, vectors = np.linalg.eigh(r[:k, :k])
        first = vectors[:, -1]
        return {"pc1_share": float(values[-1] / values.sum()),
                "participation_ratio": float(values.sum() ** 2 / (values ** 2).sum()),
                "pc1_corr": float(abs(first @ r[:k, k]) / np.sqrt(values[-1]))}

    return solve_rows(gram(centred(df, cols), cols), [], "pc1_share double, participation_ratio double, pc1_corr double", fit)


def mean_r(long: DataFrame, by: str, absolute: bool = False) -> DataFrame:
    """Mean (absolute) r over outcomes."""
    r = F.abs("r") if absolute else F.col("r")
    return long.groupBy(by).agg(F.avg(r).alias("mean_abs_r" if absolute else "mean_r"))


def dimension_variants(dims: list[str]) -> dict[str, Column]:
    """FULL and drop-one means of the present dimensions."""

    def mean(cols):
        total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in cols)
        n = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols)
        return F.when(n > 0, total / n)

    return {"full": mean(dims), **{f"drop_{d}": mean([c for c in dims if c != d]) for d in dims}}


def drop_one(df: DataFrame, dims: list[str], outcomes: list[str], min_pairs: int = 100) -> DataFrame:
    """Mean r of the re-ranked mean, full and without each dimension, and the margin."""
    rows = df.select(*outcomes, F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), v.alias("v")) for n, v in dimension_variants(dims).items()])).alias("s"))
    rows = stage(rows.select(*outcomes, "s.variant", F.round("s.v", 9).alias("v")), "variants")
    ranked = with_percentile(rows, "v", "p", ["variant"], (0.0, 100.0))
    means = mean_r(correlations(ranked, ["p"], outcomes, ["variant"], min_pairs), "variant")
    full = means.where(F.col("variant") == "full").select(F.col("mean_r").alias("full_r"))
    return means.join(F.broadcast(full)).withColumn("margin", F.col("full_r") - F.col("mean_r")).drop("full_r")


def subscore_signal(df: DataFrame, subs: list[str], outcomes: list[str], min_pairs: int = 100) -> DataFrame:
    """Mean |r| per sub-score and whether any outcome reads the wrong sign."""
    return correlations(df, subs, outcomes, min_pairs=min_pairs).groupBy("x").agg(
        F.avg(F.abs("r")).alias("mean_abs_r"), F.max(F.coalesce(F.col("r") < -0.05, F.lit(False))).alias("wrong_sign"))


def group_collapsed(df: DataFrame, group: str, x: str, outcomes: list[str], min_pairs: int = 100) -> DataFrame:
    """r between group means: the agreement at the outcome's own resolution."""
    g = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in [x, *outcomes]])
    return correlations(g, [x], outcomes, min_pairs=min_pairs)


def within_r(df: DataFrame, scores: list[str], outcomes: list[str], group: str, weight: str | None = None,
             min_members: int = 2, min_pairs: int = 50) -> DataFrame:
    """Pooled and within-group r (optionally precision-weighted) of every score with every outcome."""
    d = having_min_members(df, group, min_members)
    w = subtract_group_mean(d, group, [*scores, *outcomes])
    pooled = correlations(w, scores, outcomes, min_pairs=min_pairs).select("x", "y", F.col("r").alias("pooled"), "n")
    inside = correlations(w, [f"{s}_within" for s in scores], [f"{o}_within" for o in outcomes], min_pairs=min_pairs)
    strip = [F.regexp_replace(c, "_within$", "").alias(c) for c in ("x", "y")]
    out = pooled.join(inside.select(*strip, F.col("r").alias("within")), ["x", "y"])
    if weight:
        pairs = [(f"{s}_within", f"{o}_within") for s in scores for o in outcomes]
        ww = weighted_correlations(w, pairs, weight, min_pairs=min_pairs).select(*strip, F.col("r").alias("within_weighted"))
        out = out.join(ww, ["x", "y"])
    return out


def adjusted_within_r(df: DataFrame, scores: list[str], outcome: str, adjust: str, group: str,
                      by: list[str] | None = None, min_members: int = 3, min_pairs: int = 50) -> DataFrame:
    """Within-group r after both sides are also residualized on ``adjust``.

    Residualizing two columns on a third and correlating is their partial correlation, so it comes
    from the Gram sums of the group-demeaned columns.
    """
    d = having_min_members(df, group, min_members)
    w = stage(subtract_group_mean(d, group, [*scores, outcome, adjust]), "within")
    # one Gram row per score, each on its own complete rows
    k = len(scores)
    cols = [*[f"{s}_within" for s in scores], f"{outcome}_within", f"{adjust}_within"]
    parts = []
    for i, s in enumerate(scores):
        g = gram(w, [cols[i], cols[k], cols[k + 1]], by).where(F.col("n") >= min_pairs)
        parts.append(g.withColumn("x", F.lit(s)))
    grams = reduce(lambda a, b: a.unionByName(b), parts)
    return partials(grams, 3, ["x", *list(by or [])], {"r": (0, 1, [2])})


def placebo_differential(df: DataFrame, scores: list[str], sensitive: str, placebo: str, adjust: str, group: str) -> DataFrame:
    a = adjusted_within_r(df, scores, sensitive, adjust, group).select("x", F.col("r").alias("r_sensitive"))
    b = adjusted_within_r(df, scores, placebo, adjust, group).select("x", F.col("r").alias("r_placebo"))
    return a.join(b, "x").withColumn("differential", F.col("r_sensitive") - F.col("r_placebo"))


def wrong_sign_share(df: DataFrame, x: str, outcome: str, group: str, state: str, min_groups: int = 5,
                     min_members: int = 3, min_pairs: int = 50) -> DataFrame:
    """Per state within-group r; share of states below zero and the median."""
    d = having_min_members(df, group, min_members)
    w = subtract_group_mean(d, group, [x, outcome])
    states = w.groupBy(state).agg(F.countDistinct(group).alias("__g")).where(F.col("__g") >= min_groups).select(state)
    rs = correlations(w.join(states, state, "left_semi"), [f"{x}_within"], [f"{outcome}_within"], [state], min_pairs)
    med = exact_quantiles(rs, "r", [0.5], names=["median_r"])
    share = rs.where(F.col("r").isNotNull()).agg(F.avg((F.col("r") < 0).cast("double")).alias("negative_share"))
    return med.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).join(F.broadcast(share))  # one row each


def nnls_fit(df: DataFrame, dims: list[str], outcome: str, min_rows: int = 200) -> DataFrame:
    """Non-negative weights of the standardized dimensions on an outcome, floored, with R2."""
    import numpy as np

    cols = [*dims, outcome]
    k = len(dims)

    def fit(row):
        n, _, m = matrix_of(row, k + 1)
        sd = np.sqrt(np.diag(m)[:k] / n)
        xx, xy, yy = m[:k, :k] / np.outer(sd, sd), m[:k, k] / sd, m[k, k]
        coef = nonneg_ls(xx, xy)
        empty = coef.sum() == 0
        w = floored(coef)
        r2 = float((2 * coef @ xy - coef @ xx @ coef) / yy) if yy > 0 else 0.0
        return {"n": int(n), "r2": None if empty else r2,
                **{f"w_{d}": None if empty else float(v) for d, v in zip(dims, w)}}

    schema = "n bigint, r2 double, " + ", ".join(f"`w_{d}` double" for d in dims)
    return solve_rows(gram(centred(df, cols), cols).where(F.col("n") >= min_rows), [], schema, fit)


def loso_cv(df: DataFrame, dims: list[str], outcome: str, group: str, min_train: int = 100, min_rows: int = 200,
            min_groups: int = 5) -> DataFrame:
    """Leave-one-group-out fit: pooled out-of-sample R2 and the weights' mean and SD over folds.

    One Gram row per group; a fold trains on the total minus its own row and its prediction error
    is again a quadratic form of that row, so no row of data is read twice.
    """
    import numpy as np

    cols = [*dims, outcome]
    k = len(dims)
    names = [c for c in gram(df.limit(0), cols).columns]
    per = gram(centred(df.where(F.col(group).isNotNull()), cols), cols, [group])
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in names], F.count(F.lit(1)).alias("groups"))
    both = per.join(F.broadcast(total)).where((F.col("t_n") >= min_rows) & (F.col("groups") >= min_groups))

    def fold(row):
        train = {c: row[f"t_{c}"] - row[c] for c in names}
        none = {"ok": 0, "sse": 0.0, "sy": 0.0, "syy": 0.0, "rows": 0.0, **{f"w_{i}": None for i in range(k)}}
        if train["n"] < min_train:
            return none
        n, s, m = matrix_of(train, k + 1)
        sd = np.sqrt(np.clip(np.diag(m)[:k] / n, 0, None))
        sd = np.where(sd > 0, sd, 1.0)
        coef = nonneg_ls(m[:k, :k] / np.outer(sd, sd), m[:k, k] / sd)
        if coef.sum() == 0:
            return none
        nt, st, mt = matrix_of(row, k + 1, centre=False)
        # error of y - (a + b.x): a quadratic form in (1, x, y) of the held-out sums
        b = coef / sd
        a = s[k] / n - b @ (s[:k] / n)
        v = np.concatenate([-b, [1.0]])
        sse = v @ mt @ v - 2 * a * (v @ st) + a * a * nt
        w = floored(coef)
        return {"ok": 1, "sse": float(sse), "sy": float(st[k]), "syy": float(mt[k, k]), "rows": float(nt),
                **{f"w_{i}": float(w[i]) for i in range(k)}}

    schema = "ok int, sse double, sy double, syy double, rows double, " + ", ".join(f"w_{i} double" for i in range(k))
    folds = solve_rows(both, [], schema, fold).where(F.col("ok") == 1)
    tot = F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("rows")
    aggs = [(1 - F.sum("sse") / tot).alias("cv_r2"), F.count(F.lit(1)).alias("n_folds"), F.sum("rows").cast("long").alias("n")]
    for i, d in enumerate(dims):
        aggs += [F.avg(f"w_{i}").alias(f"mean_{d}"), F.stddev_pop(f"w_{i}").alias(f"sd_{d}")]
    return folds.agg(*aggs)


def parallel_forms(long: DataFrame) -> DataFrame:
    """Reliability of each ruler from pairwise r (rows x, y, r for both orders of every pair).

    Each ruler is triangulated with its first two partners in name order.
    """
    from pyspark.sql import Window

    both = long.select("x", "y", "r").unionByName(long.select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    w = Window.partitionBy("x").orderBy("y")
    near = both.withColumn("i", F.row_number().over(w)).where(F.col("i") <= 2)  # a handful of rulers
    pair = near.groupBy("x").agg(
        F.max(F.when(F.col("i") == 1, F.col("y"))).alias("j"), F.max(F.when(F.col("i") == 2, F.col("y"))).alias("k"),
        F.max(F.when(F.col("i") == 1, F.col("r"))).alias("rij"), F.max(F.when(F.col("i") == 2, F.col("r"))).alias("rik"))
    rjk = both.select(F.col("x").alias("j"), F.col("y").alias("k"), F.col("r").alias("rjk"))
    rel = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rij") * F.col("rik") / F.col("rjk")))
    return pair.join(rjk, ["j", "k"]).where(F.col("rjk") > 0).select(F.col("x").alias("ruler"), rel.alias("reliability"))


def disattenuate(observed: DataFrame, rulers: DataFrame, index_reliability: DataFrame) -> DataFrame:
    """Observed r over sqrt(rel_x * rel_y), at most 1: (ruler, r, reliability, disattenuated, recoverable)."""
    joined = observed.join(rulers, "ruler").join(F.broadcast(index_reliability))  # one row
    d = F.least(F.lit(1.0), F.col("r") / F.sqrt(F.col("index_reliability") * F.col("reliability")))
    out = joined.where(F.col("reliability") > 0).withColumn("disattenuated", d)
    return out.withColumn("recoverable", F.col("disattenuated") - F.col("r"))


def density_confound(df: DataFrame, supply: str, outcome: str, population: str, min_pairs: int = 100) -> DataFrame:
    """r of supply with an outcome inside each population quintile."""
    known = df.where(F.col(supply).isNotNull() & F.col(population).isNotNull())
    binned = with_quantile_class(known, population, 5, "quintile", right_closed=True)
    return correlations(binned, [supply], [outcome], ["quintile"], min_pairs)


def member_completeness(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Per sub-score: members, mean share present and share complete, where any is present."""
    rows = F.explode(F.array(*[F.struct(
        F.lit(g).alias("subscore"), F.lit(len(cols)).alias("n_members"),
        sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols).alias("present")) for g, cols in groups.items()])).alias("s")
    each = df.select(rows).select("s.*").where(F.col("present") > 0)
    return each.groupBy("subscore", "n_members").agg(
        F.avg(F.col("present") / F.col("n_members")).alias("mean_frac_present"),
        F.avg((F.col("present") == F.col("n_members")).cast("double")).alias("pct_full"))


def missingness(df: DataFrame, dims: list[str], population: str) -> DataFrame:
    """Audit rows (metric, value): who is unscored, who has two of three dimensions, and how they differ."""
    sc, pop = F.col("scoreable"), F.col(population)
    part, full = sc & (F.col("n_dims_scored") == 2), sc & (F.col("n_dims_scored") >= 3)
    low = F.col("low_confidence").cast("double")
    measures = {
        "n_scoreable": F.count_if(sc), "n_non_scoreable": F.count_if(~sc),
        "non_scoreable_pop_share": F.coalesce(F.sum(F.when(~sc, pop)), F.lit(0.0)) / F.sum(pop),
        "n_full": F.count_if(full), "n_partial": F.count_if(part), "partial_share": F.count_if(part) / F.count_if(sc),
        **{f"missing_{d}": F.count_if(part & F.col(d).isNull()) for d in dims},
        "low_confidence_share_partial": F.avg(F.when(part, low)), "low_confidence_share_full": F.avg(F.when(full, low)),
    }
    wide = df.agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    out = wide.unpivot([], list(measures), "metric", "value")
    tagged = df.where(part | full).select(pop.cast("double").alias("p"), F.when(part, "median_pop_partial").otherwise("median_pop_full").alias("metric"))
    med = exact_quantiles(tagged, "p", [0.5], ["metric"], ["value"]).select("metric", "value")
    return out.unionByName(med)


def first_stage(df: DataFrame, before: str, after: str, dose: str, score: str, group: str, min_members: int = 3,
                min_before: float = 0.0) -> DataFrame:
    """Percent change and its dose response: rows (metric, value)."""
    d = df.where(F.col(before).isNotNull() & F.col(after).isNotNull() & (F.col(before) > min_before))
    d = stage(d.withColumn("change", 100.0 * (F.col(after) - F.col(before)) / F.col(before)), "first-stage")
    cut = exact_quantiles(d, dose, [0.5], names=["__cut"]).select("__cut")
    marked = d.join(F.broadcast(cut))
    measures = {
        "mean_change": F.avg("change"), "total_change": 100.0 * (F.sum(after) - F.sum(before)) / F.sum(before),
        "dose_r": safe_corr("change", dose), "score_r": safe_corr("change", score),
        "mean_change_high_dose": F.avg(F.when(F.col(dose) >= F.col("__cut"), F.col("change"))),
        "mean_change_low_dose": F.avg(F.when(F.col(dose) < F.col("__cut"), F.col("change"))), "n": F.count(F.lit(1)),
    }
    rows = marked.agg(*[m.cast("double").alias(n) for n, m in measures.items()]).unpivot([], list(measures), "metric", "value")
    q = exact_quantiles(d, "change", [0.1, 0.5, 0.9], names=["p10_change", "p50_change", "p90_change"]).drop("n")
    rows = rows.unionByName(q.unpivot([], q.columns, "metric", "value"))
    wt = weighted_correlations(d, [("change", dose), ("change", score)], before)
    rows = rows.unionByName(wt.select(F.when(F.col("y") == dose, "dose_r_weighted").otherwise("score_r_weighted").alias("metric"), F.col("r").alias("value")))
    inside = within_r(d, [score, dose], ["change"], group, min_members=min_members)
    return rows.unionByName(inside.select(F.when(F.col("x") == score, "within_score_r").otherwise("within_dose_r").alias("metric"), F.col("within").alias("value")))


def candidate_gate(df: DataFrame, candidates: list[str], outcome: str, dims: list[str], within_outcome: str, group: str,
                   block: str, replicates: int, seed: int, min_partial: float = 0.05, min_members: int = 3) -> DataFrame:
    """Per candidate measure: raw, partial (with its block-bootstrap interval) and within-group r, strongest dimension r, verdict.

    A candidate survives if its partial r passes ``min_partial`` and the interval lies above 0.
    """
    raw = correlations(df, candidates, [outcome], min_pairs=100).select("x", F.col("r").alias("raw_r"))
    dimr = correlations(df, candidates, dims, min_pairs=100).groupBy("x").agg(F.max(F.abs("r")).alias("max_dim_r"))
    inside = within_r(df, candidates, [within_outcome], group, min_members=min_members).select("x", F.col("within").alias("within_r"))
    parts = [bootstrap_partials(df, [outcome, c, *dims], block, replicates, seed).withColumn("x", F.lit(c)) for c in candidates]
    boot = intervals(reduce(lambda a, b: a.unionByName(b), parts), "stat", ["x"]).select("x", F.col("point").alias("partial_r"), "ci_lo", "ci_hi")
    out = raw.join(boot, "x").join(inside, "x").join(dimr, "x")
    survives = (F.col("partial_r") > min_partial) & (F.col("ci_lo") > 0)
    return out.withColumn("verdict", F.when(survives, "survives").otherwise("collapses"))
