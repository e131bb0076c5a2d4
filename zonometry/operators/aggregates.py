"""Grouped counts, pooled rates, first events and dedupes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.operators.rank import exact_quantiles, quantile_class


def modal_value(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Most frequent value per group, smallest on ties; counted first so buffers stay small."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("__b"))
    return best.select(by, F.col("__b.v").alias(out))


def class_counts(df: DataFrame, by: str, label: str, classes: dict[str, str], total: str) -> DataFrame:
    """count(*) and one filtered count per class."""
    counts = [F.count_if(F.col(label) == v).alias(out) for out, v in classes.items()]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(total), *counts)


def pooled_rates(df: DataFrame, by: str, period: str, observed: str, expected: str) -> DataFrame:
    """Mean observed and expected over the pooled periods, their ratio, and the periods seen."""
    pooled = df.groupBy(by).agg(
        F.avg(observed).alias("obs"), F.avg(expected).alias("exp"), F.countDistinct(period).alias("n_periods"))
    return pooled.withColumn("oe", F.when(F.col("exp") != 0, F.col("obs") / F.col("exp")))


def first_event(df: DataFrame, by: str, year: str, window: tuple[int, int]) -> DataFrame:
    """First event year, number of events, in-window first arrival and earliest in-window dose."""
    lo, hi = window
    inside = F.col(year).between(lo, hi)
    agg = df.groupBy(by).agg(
        F.min(year).alias("first_year"), F.count(F.lit(1)).alias("n_sites"),
        F.min(F.when(inside, F.col(year))).alias("treat_year_loose"))
    agg = agg.withColumn("newly_served", F.col("first_year").between(lo, hi))
    return agg.withColumn("treat_year", F.when(F.col("newly_served"), F.col("first_year")))


def flagged_counts(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(flag).alias("flagged"), F.count(F.lit(1)).alias("n_total"))


def sum_over_set(df: DataFrame, by: str, member: str, members: list[str], value: str, out: str) -> DataFrame:
    """Sum over a set of causes; unparseable (suppressed) cells drop out of the sum."""
    return df.where(F.col(member).isin(members)).groupBy(by).agg(F.sum(F.col(value).try_cast("double")).alias(out))


def pivot_measures(df: DataFrame, key: str, measure: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(measure, names).agg(F.avg(value))


def drop_duplicates_prefer(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first under ``order``; a combine of structs, so no group is gathered."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("__b"))
    return best.select([F.col(f"__b.{c}").alias(c) for c in df.columns])


def union_distinct_prefer(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    return drop_duplicates_prefer(reduce(lambda a, b: a.unionByName(b), frames), keys, order)


def definition_groups(df: DataFrame, group: str) -> DataFrame:
    """One row: distinct definitions, and whether the panel mixes them."""
    n = F.countDistinct(group)
    return df.agg(n.alias("n_definitions"), (n > 1).alias("mixed"))


def require_one_definition(df: DataFrame, group: str, only: str | None = None, allow_mixed: bool = False) -> DataFrame:
    """Refuse a panel that mixes definitions, unless one is picked or mixing is opted into."""
    if only is not None:
        return df.where(F.col(group) == only)
    if not allow_mixed and definition_groups(df, group).first()["mixed"]:
        raise ValueError(f"panel mixes several values of {group}; pick one or allow_mixed")
    return df


def bounding_boxes(df: DataFrame, by: str, lon: str, lat: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"),
        F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def continental_box(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Box of the points inside the continental window, or of all points when none is inside."""
    inside = F.col(lon).between(-125, -66) & F.col(lat).between(24, 50)

    def pick(fn, c):
        return F.coalesce(fn(F.when(inside, F.col(c))), fn(F.col(c)))

    return df.agg(pick(F.min, lon).alias("min_lon"), pick(F.min, lat).alias("min_lat"),
                  pick(F.max, lon).alias("max_lon"), pick(F.max, lat).alias("max_lat"))


def histogram(df: DataFrame, value: str, bins: int = 44, hi: float = 100.0, partial: Column | None = None) -> DataFrame:
    """Equal bins over 0..hi; bin -1 holds the rows without a value. ``n_partial`` counts the known values that are ``partial``."""
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) / hi * bins))).cast("int")
    return df.groupBy(F.when(F.col(value).isNull(), -1).otherwise(slot).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNotNull() & (F.lit(False) if partial is None else partial)).alias("n_partial"))


def with_quantile_class(df: DataFrame, value: str, classes: int, out: str, right_closed: bool = False) -> DataFrame:
    """Equal-frequency class against exact interpolated breaks (0-based)."""
    names = [f"__cut{i}" for i in range(1, classes)]
    cuts = exact_quantiles(df, value, [i / classes for i in range(1, classes)], names=names).drop("n")
    return quantile_class(df.join(F.broadcast(cuts)), value, names, out, right_closed).drop(*names)


def group_means(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def subtract_group_mean(df: DataFrame, group: str, cols: list[str], suffix: str = "_within") -> DataFrame:
    """x minus its group mean. Means come from a combine and a join, so a hot group is never one task."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    joined = df.join(means, group, "left")
    return joined.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(
        *[f"__m_{c}" for c in cols])


def standardize(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """z-score with the sample SD."""
    by = list(by or [])
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    joined = df.join(stats, by, "left") if by else df.join(F.broadcast(stats))
    return joined.withColumn(out, F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def outlier_trim(df: DataFrame, value: str, prob: float = 0.999) -> DataFrame:
    """Keep 0 < value < the given quantile of the positive-or-not whole."""
    cut = exact_quantiles(df, value, [prob], names=["__cut"]).select("__cut")
    return df.join(F.broadcast(cut)).where((F.col(value) > 0) & (F.col(value) < F.col("__cut"))).drop("__cut")


def vertex_centroid(df: DataFrame, key: str, coords: str) -> DataFrame:
    """Mean of all [x, y] vertices of a ring list (array<array<array<double>>>)."""
    each = df.select(key, F.explode(F.flatten(F.col(coords))).alias("p"))
    return each.groupBy(key).agg(F.avg(F.col("p")[0]).alias("lon"), F.avg(F.col("p")[1]).alias("lat"))


def balanced_sample(df: DataFrame, key: str, n: int, pinned: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows in hash order plus the pinned keys; a top-n per task, then one merge of n rows."""
    drawn = df.orderBy(F.md5(F.concat_ws("|", F.col(key), F.lit(seed)).cast("binary")), key).limit(n)
    return drawn.unionByName(df.where(F.col(key).isin(pinned))).dropDuplicates([key])
