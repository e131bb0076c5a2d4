"""Empirical-Bayes shrinkage of small-area rates toward their local group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN, TERMS = 0.01, 8  # width of a bin of log(s2), and terms of its series: the next is below 1e-18 of the sum


def local_group_key(df: DataFrame, fine: str, coarse: str, out: str, min_members: int = 8) -> DataFrame:
    """The fine group where it has enough areas, else the coarse one."""
    sizes = df.where(F.col(fine).isNotNull()).groupBy(fine).agg(F.count(F.lit(1)).alias("__n"))
    key = F.when(F.col("__n") >= min_members, F.concat(F.lit("CO:"), F.col(fine))).otherwise(
        F.concat(F.lit("ST:"), F.coalesce(F.col(coarse), F.lit("?"))))
    return df.join(sizes, fine, "left").withColumn(out, key).drop("__n")


def between_variance(obs: DataFrame, by: list[str], min_members: int = 5) -> DataFrame:
    """Between-area variance ``tau2``, mean ``m`` and relative ``residual`` per group, from rows ``by, r, s2``.

    Solves sum((r-m)^2/(tau2+s2)) = n-1 with m the precision-weighted mean. The rows are read once: they collapse to bins of
    s2 one per cent wide with a few moments of their place in the bin, from which a series gives every sum of 1/(tau2+s2) to
    double precision, for any tau2. A group is then some hundred bins, whatever its size, and is solved by bracketing. tau2 is 0
    where sampling error alone explains the spread.
    """
    log = F.floor(F.log("s2") / BIN).cast("int")
    binned = obs.withColumn("bin", log).withColumn("e", F.col("s2") / F.exp((F.col("bin") + 0.5) * BIN) - 1)
    power = [reduce(lambda a, b: a * b, [F.col("e")] * k, F.lit(1.0)) for k in range(TERMS)]
    sums = binned.groupBy(*by, "bin").agg(*[F.sum(w * x).alias(f"{t}{k}") for t, w in (("a", F.lit(1.0)), ("b", F.col("r")), ("c", F.col("r") * F.col("r"))) for k, x in enumerate(power)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in obs.select(*by).schema)

    def solve(key, table):
        centre = np.exp((table.column("bin").to_numpy() + 0.5) * BIN)[:, None]
        moments = [np.column_stack([table.column(f"{t}{k}").to_numpy() for k in range(TERMS)]) for t in "abc"]
        n = moments[0][:, 0].sum()
        names = [*by, "tau2", "m", "residual"]
        if n < min_members:
            return pa.table({c: pa.array([], t.type) for c, t in zip(by, key)} | {c: pa.array([], pa.float64()) for c in names[len(by):]})

        def gap(tau2: float) -> tuple[float, float]:
            series = (-centre / (tau2 + centre)) ** np.arange(TERMS) / (tau2 + centre)
            p1, pr, prr = [float((m * series).sum()) for m in moments]
            return prr - pr * pr / p1 - (n - 1), pr / p1

        low, high, tau2 = 0.0, float(centre.max()), 0.0
        if gap(0.0)[0] > 0:
            while gap(high)[0] > 0:
                low, high = high, high * 4
            for _ in range(200):
                tau2 = (low + high) / 2
                low, high = (tau2, high) if gap(tau2)[0] > 0 else (low, tau2)
                if high - low <= 4e-16 * high:
                    break
        left, m = gap(tau2)
        return pa.table({c: [k.as_py()] for c, k in zip(by, key)} | {"tau2": [tau2], "m": [m], "residual": [left / (n - 1) if tau2 else 0.0]})

    return sums.groupBy(*by).applyInArrow(solve, f"{schema}, tau2 double, m double, residual double")


def shrink(df: DataFrame, key: str, group: str, rates: dict[str, str], min_members: int = 5) -> DataFrame:
    """Shrink every rate (name -> its SE column) toward its group; returns key plus the rates.

    Rates are stacked long, so one reading of the rows solves all of them. Rows without a rate or a
    positive SE, and groups with too few of them, keep their value; results are clipped to 0..1.
    """
    stacked = df.select(key, F.col(group).alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(r).cast("double").alias("r"), F.col(se).cast("double").alias("se"))
        for r, se in rates.items()])).alias("x")).select(key, "grp", "x.*")
    usable = F.col("r").isNotNull() & (F.col("se") > 0) & F.col("grp").isNotNull()
    obs = stacked.where(usable).select("rate", "grp", "r", (F.col("se") * F.col("se")).alias("s2"))
    fit = between_variance(obs, ["rate", "grp"], min_members)
    s2 = F.col("se") * F.col("se")
    gamma = F.col("tau2") / (F.col("tau2") + s2)
    value = F.when(usable & F.col("m").isNotNull(), gamma * F.col("r") + (1 - gamma) * F.col("m")).otherwise(F.col("r"))
    done = stacked.join(fit, ["rate", "grp"], "left").withColumn("v", F.when(
        value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))))
    return done.groupBy(key).agg(*[F.max(F.when(F.col("rate") == r, F.col("v"))).alias(r) for r in rates])


def shift_report(before: DataFrame, after: DataFrame, key: str, rates: list[str]) -> DataFrame:
    """Mean absolute change per rate."""
    b = before.select(key, *[F.col(r).alias(f"b_{r}") for r in rates])
    joined = b.join(after.select(key, *rates), key)
    agg = joined.agg(*[F.avg(F.abs(F.col(r) - F.col(f"b_{r}"))).alias(r) for r in rates])
    return agg.unpivot([], rates, "rate", "mean_abs_shift")
