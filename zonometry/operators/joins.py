"""Join shapes of the area table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def universe_left_join(
    universe: DataFrame, key: str, required: dict[str, DataFrame | None], optional: dict[str, DataFrame | None],
) -> DataFrame:
    """Left-join stage tables onto the row universe; a missing required stage is an error."""
    missing = [name for name, part in required.items() if part is None]
    if missing:
        raise ValueError(f"required stage tables missing: {missing}")
    parts = [*required.values(), *[p for p in optional.values() if p is not None]]
    return reduce(lambda left, part: left.join(part, key, "left"), parts, universe)


def lookup_default(fact: DataFrame, codes: DataFrame, key: str, label: str, default: str) -> DataFrame:
    """Left-join a code map; unknown codes take ``default``."""
    return fact.join(codes, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def broadcast_down(areas: DataFrame, group_values: DataFrame, group: str) -> DataFrame:
    """Give every area its group's value; areas without one keep null."""
    return areas.join(group_values, group, "left")


def outer_with_origin(left: DataFrame, right: DataFrame, key: str, out: str = "origin") -> DataFrame:
    """Full outer join that says which side each key came from."""
    a = left.withColumn("__l", F.lit(True))
    b = right.withColumn("__r", F.lit(True))
    origin = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").withColumn(out, origin).drop("__l", "__r")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def fallback_chain(
    df: DataFrame, fine: DataFrame, fine_key: str, coarse: DataFrame, coarse_key: Column,
    value: str, default: float = 0.0,
) -> DataFrame:
    """value = fine map, else the map of the coarser key, else the default."""
    f = fine.select(fine_key, F.col(value).alias("__fine"))
    c = coarse.select(F.col(coarse.columns[0]).alias("__ck"), F.col(value).alias("__coarse"))
    both = df.withColumn("__ck", coarse_key).join(f, fine_key, "left").join(c, "__ck", "left")
    return both.withColumn(value, F.coalesce("__fine", "__coarse", F.lit(default))).drop("__ck", "__fine", "__coarse")


def having_min_members(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows; counted by a combine, not by a group-wide window."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select(group)
    return df.join(big, group, "left_semi")


def coverage_filter(df: DataFrame, unit: str, period: str, scope: str, share: float = 0.8) -> DataFrame:
    """Units seen in at least ``share`` of the periods of their scope (rounded up)."""
    pairs = df.select(scope, unit, period).distinct()
    periods = pairs.select(scope, period).distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("__all"))
    seen = pairs.groupBy(scope, unit).agg(F.count(F.lit(1)).alias("__seen"))
    keep = seen.join(periods, scope).where(F.col("__seen") >= F.ceil(F.lit(share) * F.col("__all")))
    return df.join(keep.select(scope, unit), [scope, unit], "left_semi")


def sized_sets(sets: DataFrame, set_id: str) -> DataFrame:
    """Comparison sets with the number of their keys, for a caller that refuses large ones."""
    return sets.join(sets.groupBy(set_id).agg(F.count(F.lit(1)).alias("set_size")), set_id)


def compare_sets(sets: DataFrame, table: DataFrame, set_id: str, key: str) -> DataFrame:
    """Comparison sets of any size joined to their records, with ``set_size``; unknown keys drop."""
    return sized_sets(sets, set_id).join(table, key)


def overlap_pairs(sets: DataFrame, bands: DataFrame, set_id: str, key: str, lo: str, hi: str, limit: int = 5) -> DataFrame:
    """Pairs inside each comparison set whose [lo, hi] bands overlap ("tied"): set_id, a, b, status.

    A set of more than ``limit`` keys is not paired: it is one row of status ``refused`` without a pair, so
    a set gives at most limit*(limit-1)/2 pairs and none goes without a word.
    """
    known = bands.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(
        F.col(key), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    sized = sized_sets(sets, set_id)
    rows = sized.where(F.col("set_size") <= limit).join(known, key)
    kind = dict(sets.dtypes)[key]
    refused = sized.where(F.col("set_size") > limit).select(set_id, *[F.lit(None).cast(kind).alias(c) for c in "ab"], F.lit("refused").alias("status")).distinct()
    a = rows.select(F.col(set_id), F.col(key).alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = rows.select(F.col(set_id), F.col(key).alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    met = (F.col("a") < F.col("b")) & (F.col("alo") <= F.col("bhi")) & (F.col("blo") <= F.col("ahi"))
    return a.join(b, set_id).where(met).select(set_id, "a", "b", F.lit("tied").alias("status")).unionByName(refused)


def placebo_shift(panel: DataFrame, cohort: str, period: str, years: int) -> DataFrame:
    """Treated rows before adoption with their cohort moved earlier, with the never-treated rows."""
    treated = panel.where(F.col(cohort).isNotNull() & (F.col(period) < F.col(cohort)))
    treated = treated.withColumn(cohort, F.col(cohort) - years)
    return treated.unionByName(panel.where(F.col(cohort).isNull()))
