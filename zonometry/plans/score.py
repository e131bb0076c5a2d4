"""The scoring hierarchy: measures -> sub-scores -> dimensions -> composites and lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.operators.rank import with_percentile
from zonometry.operators.stats import ols_residual
from zonometry.plans.model import Model
from zonometry.session import stage

PCT = (0.0, 100.0)
# Means of percentiles are rounded before they are ranked again: sums run in any order on a
# cluster, and ties must not hang on the last bit.
TIE_DIGITS = 9


def stack(df: DataFrame, key: str, columns: dict[str, Column], item: str = "item", value: str = "value") -> DataFrame:
    """Long (key, item, value) rows of the known values."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias(item), c.cast("double").alias(value)) for n, c in columns.items()])).alias("s")
    return df.select(key, rows).select(key, "s.*").where(F.col(value).isNotNull())


def spread(long: DataFrame, key: str, names: dict[str, str], item: str, value: str) -> DataFrame:
    """One column per item; ``names`` maps items to output columns."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(item) == i, F.col(value))).alias(o) for i, o in names.items()])


def lookup(names: dict[str, str], c: Column) -> Column:
    """Literal map from a fixed model."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def member_percentiles(areas: DataFrame, key: str, model: Model) -> DataFrame:
    """Oriented percentile of every measure, long: (key, item, value, pctile)."""
    oriented = stack(areas, key, {m.column: F.col(m.column) * m.direction for _, m in model.measures})
    ranked = with_percentile(oriented, "value", "pctile", ["item"], min_count=model.min_members)
    return ranked.where(F.col("pctile").isNotNull())


def rerank(long: DataFrame, key: str, group: str, pctile: str = "pctile") -> DataFrame:
    """Mean of the present percentiles per (key, group), ranked again within the group."""
    mean = long.groupBy(key, group).agg(F.round(F.avg(pctile), TIE_DIGITS).alias("raw"))
    mean = stage(mean, f"mean-{group}")  # the rank reads it several times
    return with_percentile(mean, "raw", "pctile", [group], PCT)


def subscores(members: DataFrame, key: str, model: Model) -> DataFrame:
    names = {m.column: s.key for s, m in model.measures}
    long = members.withColumn("subscore", lookup(names, F.col("item")))
    return rerank(long, key, "subscore")


def dimensions(subs: DataFrame, key: str, model: Model) -> DataFrame:
    """Scored sub-scores only."""
    names = {s.key: d.key for d, s in model.subscores if s.scored}
    kept = subs.select(key, "subscore", "pctile").withColumn("dim", lookup(names, F.col("subscore")))
    return rerank(kept.where(F.col("dim").isNotNull()), key, "dim")


def weighted_parts(dims: dict[str, float]) -> tuple[Column, Column, Column]:
    """(sum of w*d, sum of w, sum of w*ln clip(d/100)) over the present dimensions."""
    num = sum(F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in dims.items())
    wsum = sum(F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in dims.items())
    logs = sum(F.when(F.col(c).isNotNull(), F.log(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col(c) / 100))) * w)
               .otherwise(0.0) for c, w in dims.items())
    return num, wsum, logs


def additive(dims: dict[str, float], ok: Column) -> Column:
    num, wsum, _ = weighted_parts(dims)
    return F.when(ok & (wsum > 0), F.round(num / wsum, TIE_DIGITS))


def geometric(dims: dict[str, float], ok: Column) -> Column:
    _, wsum, logs = weighted_parts(dims)
    return F.when(ok & (wsum > 0), F.round(F.exp(logs / wsum) * 100, TIE_DIGITS))


def effective_weights(weights: dict[str, float]) -> dict[str, float]:
    """User weights: three finite non-negative numbers; all zero means equal."""
    import math

    if len(weights) != 3 or any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be three finite non-negative numbers")
    return weights if sum(weights.values()) > 0 else dict.fromkeys(weights, 1.0)


def contributions(dims: dict[str, float], score: Column) -> dict[str, Column]:
    """Weight-normalised part of each dimension; they add up to the score (0 where a dimension is missing)."""
    _, wsum, _ = weighted_parts(dims)
    return {c: F.when(score.isNotNull(), F.coalesce(F.col(c), F.lit(0.0)) * w / wsum) for c, w in dims.items()}


def with_flags(df: DataFrame, population: str, providers: str, primary: str, floor: float) -> DataFrame:
    """primary_per_1k, low_confidence and institutional."""
    pop = F.col(population)
    return df.withColumns({
        "primary_per_1k": F.when(pop > 0, F.coalesce(F.col(primary), F.lit(0)) / (pop / 1000.0)),
        "low_confidence": pop.isNull() | (pop < floor),
        "institutional": F.coalesce((F.col(providers) > pop) & (pop > 0), F.lit(False)),
    })


def score(areas: DataFrame, key: str, state: str, population: str, model: Model) -> DataFrame:
    """The scored table. Input columns stay; percentiles, composites, lenses and tiers are added.

    ``areas`` is read at several levels: hand in a stage table (or a projection of one).
    """
    base = areas
    members = stage(member_percentiles(base, key, model).select(key, "item", "pctile"), "members")
    subs = stage(subscores(members, key, model).select(key, "subscore", "pctile"), "subscores")
    dims = dimensions(subs, key, model)
    wide = (
        base.join(spread(members, key, {m.column: f"{m.column}_natpct" for _, m in model.measures}, "item", "pctile"), key, "left")
        .join(spread(subs, key, {s.key: f"{s.key}_pctile" for _, s in model.subscores}, "subscore", "pctile"), key, "left")
        .join(spread(dims, key, {d.key: f"{d.key}_pctile" for d in model.dimensions}, "dim", "pctile"), key, "left")
    )
    wide = wide.withColumns({f"{m.column}_natpct": F.round(f"{m.column}_natpct", 1) for _, m in model.measures})
    w = {f"{d.key}_pctile": d.weight for d in model.dimensions}
    n_dims = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in w)
    ok = F.coalesce(F.col(population) > 0, F.lit(False)) & (n_dims >= model.min_dimensions)
    wide = wide.withColumn("scoreable", ok).withColumn("n_dims_scored", F.when(ok, n_dims))
    wide = wide.withColumn("score", additive(w, F.col("scoreable"))).withColumn("mult", geometric(w, F.col("scoreable")))
    care = model.dim_cols[-1]
    wide = stage(ols_residual(wide, care, model.dim_cols[:-1], "__resid").withColumn("__resid", F.round("__resid", 8)), "composites")
    # the four final ranks share one pass: stacked long, ranked by lens
    lenses = stack(wide, key, {"pctile": F.col("score"), "mult_pctile": F.col("mult"), "resid_pctile": F.col("__resid")})
    ranked = spread(with_percentile(lenses, "value", "p", ["item"]), key,
                    {c: c for c in ("pctile", "mult_pctile", "resid_pctile")}, "item", "p")
    out = wide.drop("__resid").join(ranked, key, "left")
    out = with_percentile(out, "score", "pctile_within_state", [state], PCT)
    tier = F.when(F.col("scoreable"), F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("pctile") / 10)))).cast("int")
    return out.withColumn("tier", tier)
