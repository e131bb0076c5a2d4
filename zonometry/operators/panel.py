"""Panel estimators: fixed effects, difference-in-differences, event studies, group-time effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonometry.operators.stats import gram, matrix_of, safe_corr, solve_rows
from zonometry.session import stage


def _minus_means(df: DataFrame, keys: list[str], cols: list[str], sign: float = -1.0) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    joined = df.join(means, keys) if keys else df.join(F.broadcast(means))
    return joined.withColumns({c: F.col(c) + sign * F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def twoway_demean(df: DataFrame, unit: str, period: str, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """x - unit mean - period mean + grand mean (exact on a balanced panel)."""
    by = list(by or [])

    def means(keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*by, *keys).agg(*[F.avg(c).alias(f"__{tag}_{c}") for c in cols])

    out = df.join(means([unit], "u"), [*by, unit]).join(means([period], "t"), [*by, period])
    grand = means([], "g")
    out = out.join(grand, by) if by else out.join(F.broadcast(grand))
    return out.withColumns({
        c: F.col(c) - F.col(f"__u_{c}") - F.col(f"__t_{c}") + F.col(f"__g_{c}") for c in cols
    }).drop(*[f"__{t}_{c}" for t in "utg" for c in cols])


LEVELS, PAIRS = 2048, 1 << 20  # of the smaller factor, up to which its equations are solved as one matrix


def iter_demean(df: DataFrame, first: list[str], second: list[str], cols: list[str], tol: float = 1e-12) -> DataFrame:
    """Residuals of ``cols`` on two non-nested factors, as alternating demeaning would reach in the end.

    The larger factor is eliminated: what is left are normal equations between the levels of the smaller one, coupled by
    the levels of the larger that have rows in both. They are solved by a matrix while they are few, else by conjugate
    gradients over the table of coupled pairs, down to a residual of ``tol``; then two joins put the solution on the rows. A row with a null among ``cols``
    takes no part and has no residuals.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    rows = df.where(known)
    n1, n2 = rows.agg(F.count_distinct(*first), F.count_distinct(*second)).first()
    big, small = (first, second) if n1 >= n2 else (second, first)
    own = stage(_minus_means(rows, big, cols), "own-deviations")
    load = stage(own.groupBy(*small).agg(F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(c).alias(f"__r_{c}") for c in cols]), "factor-loads")
    per = own.groupBy(*big, *small).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    all_of = per.groupBy(*big).agg(F.sum("__n").alias("__all"))
    side = lambda tag: per.select(*big, *[F.col(c).alias(f"__{tag}_{c}") for c in small], F.col("__n").alias(f"__n{tag}"))
    ends = [f"__{tag}_{c}" for tag in "ab" for c in small]
    pairs = side("a").join(side("b"), big).join(all_of, big).groupBy(*ends).agg(F.sum(F.col("__na") * F.col("__nb") / F.col("__all")).alias("__w"))
    pairs = stage(pairs, "factor-pairs")
    solve = _solve_levels if load.count() <= LEVELS and pairs.count() <= PAIRS else _descend_levels
    beta = solve(load, pairs, small, cols, tol)
    out = own.join(beta, small).withColumns({c: F.col(c) - F.col(f"__b_{c}") for c in cols}).drop(*[f"__b_{c}" for c in cols])
    out = _minus_means(out, big, cols).select(*df.columns)
    lost = df.where(~known).withColumns({c: F.lit(None).cast("double") for c in cols})
    return out.unionByName(lost)


def _solve_levels(load: DataFrame, pairs: DataFrame, small: list[str], cols: list[str], tol: float) -> DataFrame:
    """Least-squares solution of the factor equations as one matrix: rows ``small, __b_*``, ``LEVELS`` at most."""
    import numpy as np

    told = load.collect()
    place = {tuple(r[c] for c in small): i for i, r in enumerate(told)}
    m = np.diag([r["__n"] for r in told]) if told else np.zeros((0, 0))
    for r in pairs.collect():
        m[place[tuple(r[f"__a_{c}"] for c in small)], place[tuple(r[f"__b_{c}"] for c in small)]] -= r["__w"]
    right = np.array([[r[f"__r_{c}"] for c in cols] for r in told]).reshape(len(told), len(cols))
    beta = np.linalg.lstsq(m, right, rcond=1e-10)[0] if told else right
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in load.select(*small).schema] + [f"`__b_{c}` double" for c in cols])
    return F.broadcast(load.sparkSession.createDataFrame([(*k, *map(float, b)) for k, b in zip(place, beta)], schema))


def _descend_levels(load: DataFrame, pairs: DataFrame, small: list[str], cols: list[str], tol: float) -> DataFrame:
    """The same by conjugate gradients; a round joins the pairs with the current direction and ends with one row of sums."""
    now = load.select(*small, "__n", *[x for c in cols for x in (
        F.lit(0.0).alias(f"__b_{c}"), F.col(f"__r_{c}"), F.col(f"__r_{c}").alias(f"__p_{c}"))])
    norms = lambda d: [v or 0.0 for v in d.agg(*[F.sum(F.col(f"__r_{c}") * F.col(f"__r_{c}")) for c in cols]).first()]
    now = stage(now, "factor-round")
    start = rr = norms(now)
    rounds = 0
    while any(r > tol * tol * s for r, s in zip(rr, start)):
        if (rounds := rounds + 1) > 10_000:
            raise ArithmeticError("the factor equations do not settle")
        there = now.select(*[F.col(c).alias(f"__b_{c}") for c in small], *[F.col(f"__p_{c}").alias(f"__v{i}") for i, c in enumerate(cols)])
        moved = pairs.join(there, [f"__b_{c}" for c in small]).groupBy(*[F.col(f"__a_{c}").alias(c) for c in small]).agg(
            *[F.sum(F.col("__w") * F.col(f"__v{i}")).alias(f"__w{i}") for i in range(len(cols))])
        step = stage(now.join(moved, small).withColumns({f"__w{i}": F.col("__n") * F.col(f"__p_{c}") - F.col(f"__w{i}") for i, c in enumerate(cols)}), "factor-step")
        bent = [v or 0.0 for v in step.agg(*[F.sum(F.col(f"__p_{c}") * F.col(f"__w{i}")) for i, c in enumerate(cols)]).first()]
        alpha = [r / b if b > 0 and r > tol * tol * s else 0.0 for r, b, s in zip(rr, bent, start)]
        step = step.withColumns({x: y for i, c in enumerate(cols) for x, y in (
            (f"__b_{c}", F.col(f"__b_{c}") + alpha[i] * F.col(f"__p_{c}")), (f"__r_{c}", F.col(f"__r_{c}") - alpha[i] * F.col(f"__w{i}")))})
        new = norms(step)
        if all(a == 0 for a in alpha):
            break
        turn = [n / r if r > 0 else 0.0 for n, r in zip(new, rr)]
        now = stage(step.select(*small, "__n", *[x for i, c in enumerate(cols) for x in (
            F.col(f"__b_{c}"), F.col(f"__r_{c}"), (F.col(f"__r_{c}") + turn[i] * F.col(f"__p_{c}")).alias(f"__p_{c}"))]), "factor-round")
        rr = new
    return now.select(*small, *[f"__b_{c}" for c in cols])


def slopes(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """No-intercept least squares of y on xs per group, from one Gram row each."""
    import numpy as np

    by = list(by or [])
    k = len(xs)
    g = gram(df, [*xs, y], by, weight)
    types = dict(g.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + [f"`{x}` double" for x in xs])

    def fit(row):
        _, _, m = matrix_of(row, k + 1, centre=False)
        beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
        return {x: float(b) for x, b in zip(xs, beta)}

    return solve_rows(g, by, schema, fit)


def did_frame(panel: DataFrame, barrier: str, period: str, start: int) -> DataFrame:
    return panel.withColumn("post_x", F.col(barrier) * (F.col(period) >= start).cast("double"))


def did_coef(panel: DataFrame, unit: str, period: str, y: str, barrier: str, start: int,
             by: list[str] | None = None) -> DataFrame:
    """Slope of y on barrier x post after two-way demeaning."""
    by = list(by or [])
    dm = twoway_demean(did_frame(panel, barrier, period, start), unit, period, [y, "post_x"], by)
    num, den = F.sum(F.col("post_x") * F.col(y)), F.sum(F.col("post_x") * F.col("post_x"))
    return dm.groupBy(*by).agg(F.when(den > 0, num / den).alias("did"))


def event_study(panel: DataFrame, unit: str, period: str, y: str, barrier: str, periods: list[int], base: int,
                by: list[str] | None = None) -> DataFrame:
    """barrier x period coefficients with ``base`` left out: rows ``by, period, beta``."""
    by = list(by or [])
    ks = [p for p in periods if p != base]
    xs = [f"x_{p}" for p in ks]
    work = panel.withColumns({x: F.col(barrier) * (F.col(period) == p).cast("double") for x, p in zip(xs, ks)})
    wide = slopes(twoway_demean(work, unit, period, [y, *xs], by), xs, y, by)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(x).alias("beta")) for x, p in zip(xs, ks)]))
    return wide.select(*by, rows.alias("s")).select(*by, "s.*")


def replicated_slopes(panel: DataFrame, times: DataFrame, block: str, unit: str, period: str, y: str, xs: list[str]) -> DataFrame:
    """``slopes`` of ``y`` on ``xs`` after two-way demeaning, in every replicate of ``times``: rows ``replicate, xs``.

    A block drawn twice stands for two sets of units. Units keep their means whatever is drawn, so the demeaned
    cross products are those of the deviations from unit means, less what the replicate's period means take away; both come
    from sums per block and period. The panel is read once and never copied.
    """
    import numpy as np
    import pandas as pd

    from zonometry.operators.resample import drawn_sums

    cols, k = [y, *xs], len(xs) + 1
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    work = panel.where(known).select(block, unit, F.col(period).cast("long").alias(period), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    means = work.groupBy(unit).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)])
    own = work.join(means, unit).withColumns({f"u{i}": F.col(f"x{i}") - F.col(f"m{i}") for i in range(k)})
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = own.groupBy(block, period).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)], *[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)],
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"g{i}_{j}") for i, j in pairs])
    names = ["n", *[f"s{i}" for i in range(k)], *[f"u{i}" for i in range(k)], *[f"g{i}_{j}" for i, j in pairs]]
    drawn = drawn_sums(stage(sums, "panel-sums"), times, block, period, names).where("n > 0")
    each = drawn.groupBy("replicate").agg(F.collect_list(F.struct(*names)).alias("t"))  # a row a period

    def solve(batches):
        for pdf in batches:
            out = []
            for replicate, rows in zip(pdf["replicate"], pdf["t"]):
                v = np.array([[r[c] for c in names] for r in rows])
                n, s, u = v[:, :1], v[:, 1 : 1 + k], v[:, 1 + k : 1 + 2 * k]
                c = s / n - s.sum(0) / n.sum()
                g = np.zeros((k, k))
                for (i, j), total in zip(pairs, v[:, 1 + 2 * k :].sum(0)):
                    g[i, j] = g[j, i] = total
                g = g - c.T @ u - u.T @ c + (n * c).T @ c
                beta = np.linalg.lstsq(g[1:, 1:], g[1:, 0], rcond=None)[0] if np.diag(g)[1:].max() > 0 else np.full(k - 1, np.nan)
                out.append((replicate, *beta))
            yield pd.DataFrame(out, columns=["replicate", *xs])

    solved = each.mapInPandas(solve, "replicate int, " + ", ".join(f"`{x}` double" for x in xs))
    return solved.select("replicate", *[F.nanvl(F.col(x), F.lit(None).cast("double")).alias(x) for x in xs])


def did_replicates(panel: DataFrame, times: DataFrame, block: str, unit: str, period: str, y: str, barrier: str, start: int) -> DataFrame:
    """``did_coef`` in every replicate: rows ``replicate, did``."""
    rows = replicated_slopes(did_frame(panel, barrier, period, start), times, block, unit, period, y, ["post_x"])
    return rows.withColumnRenamed("post_x", "did")


def event_replicates(panel: DataFrame, times: DataFrame, block: str, unit: str, period: str, y: str, barrier: str, periods: list[int], base: int) -> DataFrame:
    """``event_study`` in every replicate: rows ``replicate, period, beta``."""
    ks = [p for p in periods if p != base]
    work = panel.withColumns({f"x_{p}": F.col(barrier) * (F.col(period) == p).cast("double") for p in ks})
    wide = replicated_slopes(work, times, block, unit, period, y, [f"x_{p}" for p in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"x_{p}").alias("beta")) for p in ks]))
    return wide.select("replicate", rows.alias("s")).select("replicate", "s.*")


def triple_diff(panel: DataFrame, unit: str, period: str, state: str, y: str, barrier: str, start: int, treated: str) -> DataFrame:
    """Coefficient on barrier x post x treated with unit and state-period effects."""
    post = (F.col(period) >= start).cast("double")
    work = panel.withColumn("bp", F.col(barrier) * post).withColumn(
        "bpt", F.col(barrier) * post * (F.col(state) == treated).cast("double"))
    dm = iter_demean(work.select(unit, state, period, y, "bp", "bpt"), [unit], [state, period], [y, "bp", "bpt"])
    return slopes(dm, ["bp", "bpt"], y)


# ---- staggered adoption ----------------------------------------------------------------------

def base_year_change(panel: DataFrame, unit: str, period: str, y: str, bases: DataFrame) -> DataFrame:
    """y_t - y_base per unit for every base period in ``bases(base)``."""
    then = panel.select(F.col(unit), F.col(period).alias("base"), F.col(y).alias("y_base")).join(bases, "base", "left_semi")
    return panel.join(then, unit).where(F.col(period) != F.col("base")).withColumn("dy", F.col(y) - F.col("y_base"))


def att_gt(panel: DataFrame, unit: str, period: str, y: str, state: str, cohort: str, weight: str | None = None,
           times: DataFrame | None = None, block: str = "block") -> DataFrame:
    """Group-time effects within state: rows ``state, g, t, e, att, n``.

    Changes since the base period g-1 are first summed per (state, cohort, t, base); treated
    and control means are then read from that small table, controls being the cohorts later
    than max(t, g) and the never treated (null cohort). With ``times`` (replicate, block, times) the
    sums are kept per block and multiplied by its draws, so rows also have ``replicate`` and a
    bootstrap costs cells x blocks, whatever the panel's size.
    """
    rep, per = ([], []) if times is None else (["replicate"], [block])
    bases = panel.where(F.col(cohort).isNotNull()).select((F.col(cohort) - 1).cast("int").alias("base")).distinct()
    work = panel.withColumn(period, F.col(period).cast("int"))
    dy = base_year_change(work, unit, period, y, bases)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = dy.where(F.col("dy").isNotNull()).groupBy(*per, state, cohort, F.col(period).alias("t"), "base").agg(
        F.sum(w * F.col("dy")).alias("sw"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    cells = stage(cells, "att-cells")
    if times is not None:
        drawn = cells.join(times, block).groupBy("replicate", state, cohort, "t", "base")
        cells = stage(drawn.agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("sw", "w", "n")]), "att-drawn")
    treated = cells.where(F.col(cohort) == F.col("base") + 1).select(
        *rep, state, F.col(cohort).cast("int").alias("g"), "t", "base", (F.col("sw") / F.col("w")).alias("mt"), "n")
    ctrl = cells.select(*rep, state, "t", "base", F.col(cohort).alias("__c"), "sw", "w", F.col("n").alias("nc"))
    later = F.col("__c").isNull() | (F.col("__c") > F.greatest("t", "g"))
    pooled = treated.join(ctrl, [*rep, state, "t", "base"]).where(later).groupBy(*rep, state, "g", "t", "mt", "n").agg(
        (F.sum("sw") / F.sum("w")).alias("mc"), F.sum("nc").alias("nc")).where(F.col("nc") >= 2)
    return pooled.select(*rep, state, "g", "t", (F.col("t") - F.col("g")).alias("e"),
                         (F.col("mt") - F.col("mc")).alias("att"), "n")


def aggregate_event(att: DataFrame, state: str, by: list[str] | None = None, min_cohorts: int = 2) -> DataFrame:
    """Size-weighted effect by event time; needs ``min_cohorts`` (state, cohort) cells."""
    by = list(by or [])
    g = att.groupBy(*by, "e").agg(
        (F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"),
        F.countDistinct(state, "g").alias("n_cohorts"), F.sum("n").alias("n_treated"))
    return g.where(F.col("n_cohorts") >= min_cohorts)


def overall_att(att: DataFrame, by: list[str] | None = None, horizon: int | None = None) -> DataFrame:
    post = att.where(F.col("e") >= 0)
    if horizon is not None:
        post = post.where(F.col("e") <= horizon)
    return post.groupBy(*list(by or [])).agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("overall_att"))


def pre_window_covariates(panel: DataFrame, unit: str, period: str, y: str, state: str, min_slope: int = 3) -> DataFrame:
    """(unit, before): mean and slope of y over the periods strictly before ``before``."""
    cuts = panel.select(state, F.col(period).alias("before")).distinct()
    seen = panel.select(state, period).distinct().join(cuts, state).where(F.col(period) < F.col("before"))
    window = seen.groupBy(state, "before").agg(F.count(F.lit(1)).alias("n_window"))
    past = panel.join(cuts, state).where(F.col(period) < F.col("before")).groupBy(state, unit, "before").agg(
        F.avg(y).alias("pre_level"), F.count(y).alias("n_obs"), F.regr_slope(y, period).alias("__slope"))
    ok = (F.col("n_window") >= min_slope) & (F.col("n_obs") >= min_slope)
    return past.join(window, [state, "before"]).select(
        state, unit, "before", "pre_level", F.when(ok, F.col("__slope")).alias("pre_slope"), "n_obs", "n_window")


def _dr_rows(panel: DataFrame, unit: str, period: str, y: str, state: str, cohort: str, pop: str, weight: str | None,
             statics: list[str] | None, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """(one row for each (state, g, t) cell and each of its treated and control units, names of the raw covariates)."""
    work = panel.withColumn(period, F.col(period).cast("int"))
    cohorts = work.where(F.col(cohort).isNotNull()).select(
        F.col(state), F.col(cohort).cast("int").alias("g")).distinct()
    periods = work.select(state, F.col(period).alias("t")).distinct()
    have_base = periods.select(state, F.col("t").alias("__b"))
    cells = cohorts.join(have_base, [cohorts[state] == have_base[state], F.col("g") - 1 == F.col("__b")], "left_semi")
    cells = cells.join(periods, state).where(F.col("t") != F.col("g") - 1)
    cov = pre_window_covariates(work, unit, period, y, state).select(state, unit, "before", "pre_level", "pre_slope")
    yt = work.select(state, unit, F.col(period).alias("t"), F.col(y).alias("yt"), F.col(cohort).alias("cohort"),
                     F.log(F.col(pop)).alias("log_pop"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
                     *(statics or []), *keep)
    yb = work.select(state, unit, F.col(period).alias("__b"), F.col(y).alias("yb"))
    rows = yt.join(cells, [state, "t"]).withColumn("__b", F.col("g") - 1).join(yb, [state, unit, "__b"])
    treated = F.col("cohort") == F.col("g")
    control = F.col("cohort").isNull() | (F.col("cohort") > F.greatest("t", "g"))
    rows = rows.withColumn("tr", F.coalesce(treated, F.lit(False)).cast("double")).where(treated | control)
    rows = rows.withColumn("dy", F.col("yt") - F.col("yb")).where(F.col("dy").isNotNull())
    rows = rows.withColumn("before", F.least("__b", "t")).join(cov, [state, unit, "before"], "left")
    raw = ["log_pop", *(statics or []), "pre_level", "pre_slope"]
    return rows.select(state, "g", "t", unit, "dy", "w", "tr", *raw, *keep), raw


def att_gt_dr(panel: DataFrame, unit: str, period: str, y: str, state: str, cohort: str, pop: str,
              weight: str | None = None, statics: list[str] | None = None, rounds: int = 12,
              min_treated: int = 3, clip_at: float = 0.95, ridge: float = 1e-3) -> DataFrame:
    """Doubly-robust group-time effects: rows ``state, g, t, e, att, n``.

    Each (state, g, t) cell gets an outcome regression on its controls and trimmed propensity
    odds. All cells are solved together: covariate moments, the regression and every step of the
    logistic fit are one combine keyed by cell, followed by a k x k solve per cell row, so a cell
    as large as a whole state is never gathered. Cells with too few treated units, like the
    plain estimator, compare means.
    """
    import numpy as np

    rows, raw = _dr_rows(panel, unit, period, y, state, cohort, pop, weight, statics, [])
    key = [state, "g", "t"]
    rows = stage(rows, "dr-rows")

    stats = rows.groupBy(*key).agg(
        F.sum("tr").alias("nt"), F.sum(1 - F.col("tr")).alias("nc"),
        *[F.avg(c).alias(f"__m_{c}") for c in raw], *[F.stddev_pop(c).alias(f"__s_{c}") for c in raw])
    stats = stats.where((F.col("nt") >= 1) & (F.col("nc") >= 2))
    z = {f"z{i + 1}": F.coalesce(
        (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") >= 1e-9, F.col(f"__s_{c}")).otherwise(1.0), F.lit(0.0))
        for i, c in enumerate(raw)}
    design = rows.join(stats, key).withColumns(z).withColumn("z0", F.lit(1.0))
    zs = [f"z{i}" for i in range(len(raw) + 1)]
    k = len(zs)
    design = stage(design.select(*key, unit, "dy", "w", "tr", "nt", *zs), "dr-design")
    types = dict(design.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in key)
    dot = lambda tag: reduce(lambda a, b: a + b, [F.col(f"{tag}{i}") * F.col(zs[i]) for i in range(k)])

    def cross(w: Column) -> list[Column]:
        return [F.sum(w * F.col(zs[i]) * F.col(zs[j])).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)]

    def solve(row, penalty, extra=0.0):
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = row[f"h_{i}_{j}"]
        return np.linalg.solve(h + np.diag(penalty), np.array([row[f"v_{i}"] for i in range(k)]) - extra)

    # outcome regression on the controls
    wc = F.col("w") * (1 - F.col("tr"))
    reg = design.groupBy(*key).agg(*cross(wc), *[F.sum(wc * F.col("dy") * F.col(zi)).alias(f"v_{i}") for i, zi in enumerate(zs)])
    reg = solve_rows(reg, key, head + "".join(f", m{i} double" for i in range(k)),
                     lambda row: {f"m{i}": float(b) for i, b in enumerate(solve(row, np.full(k, 1e-6)))})
    # ridge logistic by Newton steps, the intercept unpenalised
    pen = np.array([0.0] + [ridge] * (k - 1))
    beta = stats.select(*key, *[F.lit(0.0).alias(f"b{i}") for i in range(k)])
    bs = [f"b{i}" for i in range(k)]

    def newton(row):
        b = np.array([row[c] for c in bs])
        return dict(zip(bs, (b + solve(row, pen, pen * b)).tolist()))

    for step in range(rounds):
        at = design.join(beta, key)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot("b")))))
        at = at.withColumn("p", p)
        hess = F.col("w") * F.col("p") * (1 - F.col("p")) + F.lit(1e-12)
        agg = at.groupBy(*key, *bs).agg(*cross(hess), *[
            F.sum(F.col("w") * (F.col("tr") - F.col("p")) * F.col(zi)).alias(f"v_{i}") for i, zi in enumerate(zs)])
        beta = solve_rows(agg, key, head + "".join(f", {b} double" for b in bs), newton)
        if step % 4 == 3:
            beta = stage(beta, "dr-logit")
    final = design.join(reg, key).join(beta, key)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot("b")))))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(clip_at), p))
    dr = F.col("nt") >= min_treated
    resid = F.when(dr, F.col("dy") - dot("m")).otherwise(F.col("dy"))
    wt = F.col("w") * F.col("tr")
    wo = F.when(dr, F.col("w") * (1 - F.col("tr")) * p / (1 - p)).otherwise(F.col("w") * (1 - F.col("tr")))
    final = final.withColumn("__e", resid).withColumn("__wt", wt).withColumn("__wo", wo)
    out = final.groupBy(*key).agg(
        (F.sum(F.col("__wt") * F.col("__e")) / F.sum("__wt") - F.sum(F.col("__wo") * F.col("__e")) / F.sum("__wo")).alias("att"),
        F.sum("tr").cast("long").alias("n"))
    return out.select(state, "g", "t", (F.col("t") - F.col("g")).alias("e"), "att", "n")


DR_ROUNDS = 200
DR_BYTES = 64 << 20  # of the coefficients of all cells that one pass over the rows carries along


def att_gt_dr_replicates(panel: DataFrame, times: DataFrame, block: str, unit: str, period: str, y: str, state: str, cohort: str,
                         pop: str, weight: str | None = None, statics: list[str] | None = None, min_treated: int = 3,
                         clip_at: float = 0.95, ridge: float = 1e-3, tol: float = 1e-9) -> DataFrame:
    """``att_gt_dr`` in every replicate of ``times``: rows ``replicate, state, g, t, e, att, n``.

    All cells of all replicates are refitted together. A pass reads the cells' rows once, weighs each by its block's draws
    in all replicates as one vector, and leaves k x k sums per cell and replicate; moments, the outcome regression and each
    Newton step of the logistic fit are such passes, until no coefficient moves by more than ``tol``; steps are halved where the
    likelihood falls, as it does in small cells that the covariates separate. Rows are never copied, and where the
    coefficients of all cells and replicates exceed ``DR_BYTES`` the replicates are taken in turns. A window of earlier periods is that
    of the whole panel.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from zonometry.operators.resample import with_draws

    rows, raw = _dr_rows(panel, unit, period, y, state, cohort, pop, weight, statics, [block])
    key, m, k = [state, "g", "t"], len(raw), len(raw) + 1
    cells = stage(rows.select(*key).distinct(), "dr-cells").orderBy(*key).collect()  # one row a cell
    spark = panel.sparkSession
    number = {tuple(r): i for i, r in enumerate(cells)}
    names = spark.createDataFrame([(*c, i) for c, i in number.items()], rows.select(*key).schema.add("cell", T.IntegerType())) if cells else None
    if not cells:
        return spark.createDataFrame([], rows.select(*key).schema).selectExpr("0 AS replicate", f"`{state}`", "g", "t", "t - g AS e", "0D AS att", "0L AS n")
    rows = rows.join(F.broadcast(names), key).select("cell", F.col(block).alias("block"), *[F.col(c).cast("double").alias(c) for c in ("dy", "w", "tr", *raw)])
    rows, weights, width = with_draws(rows, times, block)
    rows = stage(rows.repartition("cell", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("cell"), "dr-weighted")

    def passed(lo: int, hi: int, size: int, sums, carried) -> np.ndarray:
        """cells x replicates x size: ``sums(draws, dy, w, tr, x, known, carried[cell])`` added over the rows."""
        shared = spark.sparkContext.broadcast(carried)

        def run(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                table = pa.Table.from_batches([batch])
                cell = table.column("cell").to_numpy()
                edge = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                for a, b in zip(edge[:-1], edge[1:]):
                    for at in range(a, b, 256):
                        piece = table.slice(at, min(256, b - at))
                        x = np.column_stack([piece.column(c).to_numpy(zero_copy_only=False) for c in raw])
                        dy, w, tr = [piece.column(c).to_numpy() for c in ("dy", "w", "tr")]
                        c = int(cell[a])
                        got = sums(weights(piece)[:, lo:hi], dy, w, tr, np.nan_to_num(x), ~np.isnan(x), None if shared.value is None else shared.value[c])
                        out[c] = out.get(c, 0.0) + got
            for c, total in out.items():
                yield pa.record_batch([pa.array(np.full(hi - lo, c, np.int32)), pa.array(np.arange(hi - lo, dtype=np.int32)), pa.array(list(total))], ["cell", "r", "total"])

        parts = rows.mapInArrow(run, "cell int, r int, total array<double>")
        added = parts.groupBy("cell", "r").agg(*[F.sum(F.col("total")[i]).alias(f"x{i}") for i in range(size)]).toPandas()  # a row a cell and replicate
        out = np.zeros((len(cells), hi - lo, size))
        out[added["cell"], added["r"]] = added[[f"x{i}" for i in range(size)]].to_numpy()
        shared.destroy()
        return out

    upper = np.triu_indices(k)

    def design(x, known, carried):
        mean, sd = carried[:, :m], carried[:, m : 2 * m]
        z = np.where(known[:, None, :], (x[:, None, :] - mean) / sd, 0.0)
        return np.concatenate([np.ones((*z.shape[:2], 1)), z], 2)

    def cross(z, h, v):
        """Sums over rows of h z z' (upper half) and v z, for each replicate."""
        hh = np.einsum("br,bri,brj->rij", h, z, z, optimize=True)[:, upper[0], upper[1]]
        return np.concatenate([hh, np.einsum("br,bri->ri", v, z)], 1)

    def moments(t, dy, w, tr, x, known, _):
        return np.concatenate([(t.T @ tr)[:, None], (t.T @ (1 - tr))[:, None], t.T @ known, t.T @ x, t.T @ (x * x)], 1)

    def regression(t, dy, w, tr, x, known, carried):
        h = t * (w * (1 - tr))[:, None]
        return cross(design(x, known, carried), h, h * dy[:, None])

    def logistic(t, dy, w, tr, x, known, carried):
        z = design(x, known, carried)
        eta = np.einsum("bri,ri->br", z, carried[:, 2 * m :])
        low = np.logaddexp(0.0, -eta)  # -log p
        p, tw = np.exp(-low), t * w[:, None]
        likely = -(tw * (low + (1 - tr)[:, None] * eta)).sum(0)
        return np.concatenate([cross(z, tw * p * (1 - p) + 1e-12 * t, tw * (tr[:, None] - p)), likely[:, None]], 1)

    def effect(t, dy, w, tr, x, known, carried):
        z, beta, fit, dr = design(x, known, carried), carried[:, 2 * m : 2 * m + k], carried[:, 2 * m + k : 2 * m + 2 * k], carried[:, -1] > 0
        p = np.clip(1 / (1 + np.exp(-np.clip(np.einsum("bri,ri->br", z, beta), -30, 30))), 1e-6, clip_at)
        e = dy[:, None] - np.where(dr, np.einsum("bri,ri->br", z, fit), 0.0)
        wt = t * (w * tr)[:, None]
        wo = t * (w * (1 - tr))[:, None] * np.where(dr, p / (1 - p), 1.0)
        return np.stack([(wt * e).sum(0), wt.sum(0), (wo * e).sum(0), wo.sum(0)], 1)

    def solved(sums, penalty, away):
        h = np.zeros((*sums.shape[:2], k, k))
        h[:, :, upper[0], upper[1]] = h[:, :, upper[1], upper[0]] = sums[:, :, : len(upper[0])]
        return np.linalg.solve(h + np.diag(penalty), (sums[:, :, len(upper[0]) :] - away)[..., None])[..., 0]

    half, parts = len(upper[0]) + k, []
    step = max(1, DR_BYTES // (8 * len(cells) * max(half + 1, 2 * m + 2 * k + 1)))
    for lo in range(0, width, step):
        hi = min(width, lo + step)
        got = passed(lo, hi, 2 + 3 * m, moments, None)
        nt, nc, n, sx, sxx = got[..., 0], got[..., 1], got[..., 2 : 2 + m], got[..., 2 + m : 2 + 2 * m], got[..., 2 + 2 * m :]
        mean = sx / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(sxx / np.maximum(n, 1) - mean * mean, 0.0))
        sd = np.where(sd < np.maximum(1e-9, 1e-7 * np.abs(mean)), 1.0, sd)
        valid = (nt >= 1) & (nc >= 2)
        base = np.concatenate([mean, sd], 2)
        fit = solved(passed(lo, hi, half, regression, base), np.full(k, 1e-6), 0.0)
        # Newton steps, each halved while it does not raise the penalised likelihood of its cell and replicate
        pen, beta = np.array([0.0] + [ridge] * (k - 1)), np.zeros((len(cells), hi - lo, k))
        move, scale, best, open_ = np.zeros_like(beta), np.ones(valid.shape), np.full(valid.shape, -np.inf), valid.copy()
        for _ in range(DR_ROUNDS):
            trial = beta + scale[..., None] * move
            sums = passed(lo, hi, half + 1, logistic, np.concatenate([base, trial], 2))
            likely = sums[..., -1] - 0.5 * (pen * trial * trial).sum(2)
            up = open_ & (likely >= best - 1e-12 * np.abs(best))
            sums[~up, : len(upper[0])] = np.eye(k)[upper]
            step_to = np.where(up[..., None], solved(sums[..., :-1], pen, pen * trial), 0.0)
            beta, best = np.where(up[..., None], trial, beta), np.where(up, likely, best)
            move, scale = np.where(up[..., None], step_to, move), np.where(up, 1.0, scale / 2)
            open_ &= (np.abs(scale[..., None] * move) > tol * np.maximum(1.0, np.abs(beta))).any(2)
            if not open_.any():
                break
        valid &= ~open_  # a fit that does not settle gives no effect
        dr = (nt >= min_treated).astype(float)[..., None]
        s = passed(lo, hi, 4, effect, np.concatenate([base, beta, fit, dr], 2))
        good = valid & (s[..., 1] > 0) & (s[..., 3] > 0)
        c, r = np.nonzero(good)
        att = s[c, r, 0] / s[c, r, 1] - s[c, r, 2] / s[c, r, 3]
        parts.append(pd.DataFrame({"cell": c.astype("int32"), "replicate": (r + lo - 1).astype("int32"), "att": att, "n": nt[c, r].astype("int64")}))
    flat = spark.createDataFrame(pd.concat(parts), "cell int, replicate int, att double, n long")
    return flat.join(F.broadcast(names), "cell").select("replicate", *key, (F.col("t") - F.col("g")).alias("e"), "att", "n")


def lag1_autocorr(resid: DataFrame, unit: str, period: str, value: str, min_obs: int = 4) -> DataFrame:
    """Mean over units of the within-unit lag-1 correlation (a unit's series is one short window)."""
    from pyspark.sql import Window

    w = Window.partitionBy(unit).orderBy(period)
    pairs = resid.withColumn("__prev", F.lag(value).over(w))
    each = pairs.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), safe_corr(value, "__prev").alias("r")).where(F.col("n") >= min_obs)
    good = each.where(F.col("r").isNotNull())
    return good.agg(F.avg("r").alias("lag1"), F.count(F.lit(1)).alias("n_units"))


def variance_decomposition(resid: DataFrame, unit: str, value: str, pop: str) -> DataFrame:
    """Per-unit residual variance regressed on 1/pop: floor and sampling parts."""
    each = resid.groupBy(unit).agg(F.var_samp(value).alias("v"), F.first(pop).alias("pop"))
    ok = each.where(F.col("v").isNotNull() & (F.col("pop") > 0)).withColumn("inv", 1.0 / F.col("pop"))
    return ok.agg(F.greatest(F.regr_intercept("v", "inv"), F.lit(1.0)).alias("floor"),
                  F.greatest(F.regr_slope("v", "inv"), F.lit(0.0)).alias("sampling"), F.count(F.lit(1)).alias("n_units"))


# Treated units of a powered and of a pilot study, and the share of the effect by which a borderline interval may miss 0.
POWERED, PILOT, BORDERLINE = 240, 110, 0.2


def verdict(df: DataFrame) -> DataFrame:
    """Rule label per result row from ``overall_att, ci_lo, ci_hi, pre_rms, n_treated``."""
    ov, lo, hi = F.col("overall_att"), F.col("ci_lo"), F.col("ci_hi")
    excludes = (lo > 0) | (hi < 0)
    clean = F.coalesce((F.abs(ov) > 0) & (F.col("pre_rms") < F.abs(ov) / 2), F.lit(False))
    near = F.when(ov < 0, hi).otherwise(lo)
    borderline = ~excludes & (F.abs(ov) > 0) & (F.abs(near) < F.abs(ov) * BORDERLINE)
    label = (
        F.when(excludes & (ov < 0) & clean, "detected").when(excludes & (ov < 0), "suggestive")
        .when(excludes & (ov > 0), "wrong-signed").when(borderline & (ov < 0), "borderline").otherwise("none")
    )
    power = F.when(F.col("n_treated") >= POWERED, "powered").when(F.col("n_treated") >= PILOT, "pilot").otherwise("underpowered")
    return df.withColumn("pre_clean", clean).withColumn("verdict", label).withColumn("power_band", power)


def temporal_verdict(df: DataFrame) -> DataFrame:
    """Descriptive label of a difference-in-differences row: ``did_drop, excludes_0, pre_p``."""
    label = (
        F.when(~F.col("excludes_0") | (F.col("did_drop") >= 0), "no credible effect")
        .when(F.col("pre_p") <= 0.05, "descriptive: pre-trends rejected").otherwise("inconclusive")
    )
    return df.withColumn("verdict", label)
