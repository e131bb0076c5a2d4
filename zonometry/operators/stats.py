"""Correlation, regression and effect-size statistics from additive sums.

Anything that can be read off sums of products is reduced to one row per group first; the small
solves then run on those rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonometry.operators.rank import value_positions


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Null-pairwise correlation aggregate; null without spread (the built-in one divides by zero)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def pearson(x: Column, y: Column, min_pairs: int = 50) -> Column:
    """Null-pairwise correlation aggregate with a pair floor; zero variance gives null."""
    return F.when(F.count_if(x.isNotNull() & y.isNotNull()) >= min_pairs, safe_corr(x, y))


def correlations(df: DataFrame, xs: list[str], ys: list[str], by: list[str] | None = None,
                 min_pairs: int = 50) -> DataFrame:
    """Every (x, y) correlation in one scan: rows ``by, x, y, r, n``."""
    by = list(by or [])
    aggs, pairs = [], [(x, y) for x in xs for y in ys]
    for i, (x, y) in enumerate(pairs):
        aggs += [safe_corr(x, y).alias(f"__r{i}"),
                 F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias(f"__n{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"),
                 F.when(F.col(f"__n{i}") >= min_pairs, F.col(f"__r{i}")).alias("r"), F.col(f"__n{i}").alias("n"))
        for i, (x, y) in enumerate(pairs)])).alias("s")
    return wide.select(*by, rows).select(*by, "s.*")


def weighted_correlations(df: DataFrame, pairs: list[tuple[str, str]], weight: str, by: list[str] | None = None,
                          min_pairs: int = 50) -> DataFrame:
    """Precision-weighted correlation per pair (w > 0), in one scan: rows ``by, x, y, r, n``.

    Columns are centred on their overall means (one row), so that plain sums keep their digits; every pair
    is then six sums of the map-side combine, and no data row is copied or shuffled.
    """
    by = list(by or [])
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    w = F.col(weight).cast("double")
    rows = df.where(F.col(weight) > 0)
    means = rows.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)])
    d = {c: F.col(c) - F.coalesce(F.col(f"__m{i}"), F.lit(0.0)) for i, c in enumerate(cols)}
    flat = rows.select(*by, w.alias("__w"), *cols).join(F.broadcast(means))  # one row
    wide = flat.groupBy(*by).agg(*[F.struct(*_weighted_sums(d[x], d[y], F.col("__w"))).alias(f"__s{i}") for i, (x, y) in enumerate(pairs)])
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"__s{i}").alias("s")) for i, (x, y) in enumerate(pairs)])).alias("p")
    long = wide.select(*by, parts).select(*by, "p.x", "p.y", "p.s.*").where(F.col("n") > 0)
    return long.select(*by, "x", "y", weighted_r(min_pairs).alias("r"), "n")


def _weighted_sums(a: Column, b: Column, w: Column) -> list[Column]:
    both = a.isNotNull() & b.isNotNull()
    terms = {"sw": w, "sa": w * a, "sb": w * b, "saa": w * a * a, "sbb": w * b * b, "sab": w * a * b}
    return [F.count_if(both).alias("n")] + [F.sum(F.when(both, t)).alias(k) for k, t in terms.items()]


def weighted_r(min_pairs: int) -> Column:
    """Correlation of weighted sums; null without spread beyond rounding."""
    c = F.col("sab") - F.col("sa") * F.col("sb") / F.col("sw")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("sw"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("sw")
    spread = (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    return F.when((F.col("n") >= min_pairs) & spread, c / F.sqrt(va * vb))


# ---- Gram sums -----------------------------------------------------------------------------

def centred(df: DataFrame, cols: list[str]) -> DataFrame:
    """Complete rows with each column minus its overall mean (keeps later sums well scaled)."""
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    means = whole.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    out = whole.join(F.broadcast(means))  # one row
    return out.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def gram(df: DataFrame, cols: list[str], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """``n``, sums ``s_i`` and cross sums ``s_i_j`` (i <= j) of complete rows per group."""
    w = F.lit(1.0) if weight is None else weight
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    aggs = [F.sum(w).alias("n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(w * F.col(a)).alias(f"s_{i}"))
        aggs += [F.sum(w * F.col(a) * F.col(cols[j])).alias(f"s_{i}_{j}") for j in range(i, len(cols))]
    return whole.groupBy(*list(by or [])).agg(*aggs)


def gram_names(k: int) -> list[str]:
    names = ["n"]
    for i in range(k):
        names.append(f"s_{i}")
        names += [f"s_{i}_{j}" for j in range(i, k)]
    return names


def sum_grams(df: DataFrame, k: int, by: list[str], times: Column | None = None) -> DataFrame:
    t = F.lit(1.0) if times is None else times
    return df.groupBy(*by).agg(*[F.sum(t * F.col(c)).alias(c) for c in gram_names(k)])


def cov_of(i: int, j: int) -> Column:
    """Centred cross sum of a Gram row."""
    i, j = min(i, j), max(i, j)
    return F.col(f"s_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")


def corr_of(i: int, j: int) -> Column:
    v = cov_of(i, i) * cov_of(j, j)
    return F.when(v > 0, cov_of(i, j) / F.sqrt(v))


def partials(grams: DataFrame, k: int, keep: list[str], wanted: dict[str, tuple[int, int, list[int]]]) -> DataFrame:
    """Partial correlations of Gram rows: ``keep, n`` plus one column per (i, j, controls).

    Read off the inverse of the small correlation matrix, one row per group at a time.
    """
    import numpy as np

    types = dict(grams.dtypes)

    def fit(row):
        n, _, m = matrix_of(row, k)
        out = {"n": int(round(n))}
        for name, (i, j, controls) in wanted.items():
            idx = [i, j, *controls]
            sub = m[np.ix_(idx, idx)]
            sd = np.sqrt(np.diag(sub))
            out[name] = None
            if (sd > 0).all():
                r = sub / np.outer(sd, sd)
                if controls:
                    zz = r[2:, 2:]
                    fit_z = np.linalg.lstsq(zz, r[2:, :2], rcond=None)[0]
                    r = r[:2, :2] - r[:2, 2:] @ fit_z
                v = r[0, 0] * r[1, 1]
                out[name] = float(r[0, 1] / np.sqrt(v)) if v > 1e-24 else None
        return out

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n bigint"] + [f"`{w}` double" for w in wanted])
    return solve_rows(grams, keep, schema, fit)


def partial_corr(df: DataFrame, y: str, c: str, controls: list[str], by: list[str] | None = None,
                 min_rows: int = 100) -> DataFrame:
    cols = [y, c, *controls]
    g = gram(centred(df, cols), cols, by).where(F.col("n") >= min_rows)
    return partials(g, len(cols), list(by or []), {"partial_r": (0, 1, list(range(2, len(cols))))})


def solve_rows(df: DataFrame, keep: list[str], schema: str, fit: Callable[[dict], dict]) -> DataFrame:
    """Apply a small solve to each Gram row; rows are already one per group."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{**{k: row[k] for k in keep}, **fit(row)} for row in pdf.to_dict("records")],
                               columns=names)

    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    return df.mapInPandas(run, schema)


def matrix_of(row: dict, k: int, centre: bool = True):
    """(n, sums, cross-product matrix) of a Gram row; centred around its own means on request."""
    import numpy as np

    m = np.zeros((k, k))
    s = np.array([row[f"s_{i}"] for i in range(k)], float)
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"s_{i}_{j}"]
    n = float(row["n"])
    return n, s, (m - np.outer(s, s) / n) if centre else m


def ols_residual(df: DataFrame, y: str, xs: list[str], out: str, min_rows: int = 100) -> DataFrame:
    """y minus its least-squares fit on xs and an intercept, on complete rows; null elsewhere.

    One Gram aggregate, a k x k solve on that row, one projection.
    """
    import numpy as np

    cols = [*xs, y]
    k = len(xs)

    def fit(row):
        n, s, m = matrix_of(row, k + 1)
        beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
        return {**{f"__b{i}": float(beta[i]) for i in range(k)}, "__a": float((s[k] - beta @ s[:k]) / n)}

    schema = ", ".join([f"__b{i} double" for i in range(k)] + ["__a double"])
    coef = solve_rows(gram(df, cols).where(F.col("n") > min_rows), [], schema, fit)
    joined = df.join(F.broadcast(coef), how="left")  # at most one row
    fitted = reduce(lambda a, b: a + b, [F.col(x) * F.col(f"__b{i}") for i, x in enumerate(xs)]) + F.col("__a")
    return joined.withColumn(out, F.col(y) - fitted).drop("__a", *[f"__b{i}" for i in range(k)])


def nonneg_ls(xx, xy, tol: float = 1e-12):
    """Non-negative least squares from Gram sums, by growing and shrinking the set of positive coefficients.

    The predictor with the steepest gradient enters; where the fit of the set then turns negative, the step stops at the first
    zero and that predictor leaves. It ends when no gradient outside the set is positive, the condition of the optimum, so
    many predictors cost no more than a few solves each.
    """
    import numpy as np

    k = len(xy)
    x, inside = np.zeros(k), np.zeros(k, bool)
    least = tol * max(1.0, float(np.abs(xy).max(initial=0.0)))

    def fit():
        out = np.zeros(k)
        out[inside] = np.linalg.lstsq(xx[np.ix_(inside, inside)], xy[inside], rcond=None)[0]
        return out

    for _ in range(50 * k + 50):
        slope = np.where(inside, -np.inf, xy - xx @ x)
        if not k or slope.max() <= least:
            return x
        inside[slope.argmax()] = True
        aim = fit()
        while inside.any() and aim[inside].min() <= 0:
            low = inside & (aim <= 0)
            share = np.min(x[low] / np.maximum(x[low] - aim[low], 1e-300))
            x = np.where(inside, x + share * (aim - x), 0.0)
            gone = inside & ((x <= 1e-14 * max(1.0, np.abs(x).max())) & low)
            inside &= ~gone
            x[~inside] = 0.0
            aim = fit()
        x = aim
    raise ArithmeticError("non-negative least squares does not settle")


def floored(values, floor: float = 5.0):
    """Non-negative scores to weights summing to 100, each at least ``floor``."""
    import numpy as np

    v = np.clip(np.asarray(values, float), 0, None)
    share = v / v.sum() if v.sum() > 0 else np.full(len(v), 1 / len(v))
    return floor + (100 - floor * len(v)) * share


def floor_weights(long: DataFrame, group: str, value: str, out: str, floor: float = 5.0) -> DataFrame:
    """The same rule on a long (group, item, value) table; groups hold a handful of items."""
    w = Window.partitionBy(group)
    v = F.greatest(F.col(value), F.lit(0.0))
    total, k = F.sum(v).over(w), F.count(F.lit(1)).over(w)
    share = F.when(total > 0, v / total).otherwise(1.0 / k)
    return long.withColumn(out, F.round(floor + (100 - floor * k) * share, 1))


def cohen_d(df: DataFrame, value: str, inside: Column, by: list[str] | None = None, min_each: int = 30) -> DataFrame:
    """(mean inside - mean outside) / pooled SD."""
    a, b = F.when(inside, F.col(value)), F.when(~inside, F.col(value))
    g = df.groupBy(*list(by or [])).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
        F.count(a).alias("n_in"), F.count(b).alias("n_out"))
    na, nb = F.col("n_in"), F.col("n_out")
    sp = F.sqrt(((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / F.when(na + nb > 2, na + nb - 2))
    d = F.when((na >= min_each) & (nb >= min_each) & (sp > 0), (F.col("ma") - F.col("mb")) / sp)
    return g.select(*list(by or []), "n_in", "n_out", d.alias("d"))


def bh_fdr(df: DataFrame, key: str, p: str, q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p over a candidate set (one row per candidate; null p drops).

    Equal p share their last rank, so the work is on distinct values: their places, then the smallest
    p * n / rank from each value upwards, inside slices of [0, 1] and over the slices' minima.
    """
    slices = 1024
    known = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p)))
    raw = F.col(p) * F.col("n") / (F.col("before") + F.col("c"))
    slot = F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor(F.col(p) * slices))).cast("int")
    each = value_positions(known, p, domain=(0.0, 1.0)).select(F.col(p).alias("__p"), raw.alias("__raw"), slot.alias("__s"))
    above = Window.orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows
    later = each.groupBy("__s").agg(F.min("__raw").alias("__low")).select("__s", F.min("__low").over(above).alias("__after"))
    down = Window.partitionBy("__s").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = each.withColumn("__in", F.min("__raw").over(down)).join(later, "__s")
    adjusted = adjusted.select("__p", F.least(F.lit(1.0), F.col("__in"), F.col("__after")).alias("q_value"))
    out = known.join(adjusted, F.col(p) == F.col("__p")).drop("__p")
    return out.withColumn("survives", F.col("q_value") <= q)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square: the regularized upper incomplete gamma at (df/2, x/2)."""
    import math

    a, z = df / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        i = a
        while abs(term) > abs(total) * 1e-15:
            i += 1
            term *= z / i
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
