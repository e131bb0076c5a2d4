"""Ranking, lookup and comparison queries over the scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.functions.keys import strict_digits_key


def headline(df: DataFrame, metric: str, composite_family: set[str], state: str | None = None,
             include_low_confidence: bool = False, min_dims: int = 3) -> DataFrame:
    """Rows a ranking may show: scoreable, known, never institutional; partial scores held out of composites."""
    out = df.where(F.col("scoreable") & F.col(metric).isNotNull() & ~F.coalesce(F.col("institutional"), F.lit(False)))
    if state:
        out = out.where(F.upper("state") == state.strip().upper())
    if not include_low_confidence:
        out = out.where(~F.col("low_confidence"))
    if metric in composite_family:
        out = out.where(F.coalesce(F.col("n_dims_scored"), F.lit(0)) >= min_dims)
    return out


def rankings(df: DataFrame, metric: str, key: str, keep: list[str], composite_family: set[str],
             limit: int = 50, descending: bool = True, metrics: set[str] | None = None, **gates) -> DataFrame:
    """Top rows of a metric, which must be one of ``metrics`` if they are given; sort and limit together, so each task keeps only its own best."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    if metrics is not None and metric not in metrics:
        raise ValueError(f"unknown metric {metric!r}")
    order = F.col(metric).desc() if descending else F.col(metric).asc()
    rows = headline(df, metric, composite_family, **gates).orderBy(order, key).limit(limit)
    return rows.select(*dict.fromkeys([key, *keep, metric]))


def batch_lookup(requests: DataFrame, raw: str, table: DataFrame, key: str, doubles: list[str], width: int = 5) -> DataFrame:
    """Records of a table of raw keys of ``width`` digits; malformed keys are reported, non-finite numbers read null."""
    asked = requests.select(F.col(raw), strict_digits_key(F.col(raw), width).alias(key))
    clean = table.withColumns({
        c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in doubles})
    found = asked.join(clean.withColumn("__hit", F.lit(True)), key, "left")
    status = F.when(F.col(key).isNull(), "invalid").when(F.col("__hit"), "found").otherwise("unknown")
    return found.withColumn("status", status).drop("__hit")


def table_summary(df: DataFrame, state: str, score: str) -> DataFrame:
    """Rows, scored rows and the sorted distinct states, from per-state partial counts."""
    per = df.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("s"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("s").alias("n_scored"),
                   F.concat_ws(",", F.array_sort(F.collect_set(state))).alias("states"))


def place_label(city: Column, county: Column, default: Column) -> Column:
    return F.coalesce(city, county, default)
