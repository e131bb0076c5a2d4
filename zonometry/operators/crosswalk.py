"""Weighted many-to-many crosswalks between geographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.operators.joins import fallback_chain


def dominant_overlap(xwalk: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Destination with the largest weight per source; the smaller key wins a tie."""
    best = F.min(F.struct((-F.col(weight)).alias("w"), F.col(dst).alias("d")))
    return xwalk.groupBy(src).agg(best.alias("__b")).select(
        src, F.col("__b.d").alias(dst), (-F.col("__b.w")).alias(weight))


def weighted_mean_aggs(cols: list[str], weight: str) -> list[Column]:
    """One null-aware weighted mean per column: rows without a value or weight count on neither side."""
    out = []
    for c in cols:
        ok = F.col(c).isNotNull() & (F.col(weight) > 0)
        num = F.sum(F.when(ok, F.col(c) * F.col(weight)))
        den = F.sum(F.when(ok, F.col(weight)))
        out.append(F.when(den > 0, num / den).alias(c))
    return out


def weighted_mean_by(df: DataFrame, by: str, cols: list[str], weight: str) -> DataFrame:
    return df.groupBy(by).agg(*weighted_mean_aggs(cols, weight))


def crosswalk_mean(xwalk: DataFrame, values: DataFrame, on: str, dst: str, cols: list[str], weight: str,
                   preferred: str | None = None) -> DataFrame:
    """Carry ``cols`` through a crosswalk; ``preferred`` weights are used wherever a row has one."""
    joined = xwalk.join(values, on)
    if preferred:
        joined = joined.withColumn(weight, F.coalesce(F.col(preferred), F.col(weight)))
    return weighted_mean_by(joined, dst, cols, weight)


def area_weighted_mean(xwalk: DataFrame, src: str, weight: str, score: str) -> DataFrame:
    """sum(score*w)/sum(w) per source, 0 where there is no weight."""
    w, sw = F.sum(weight), F.sum(F.col(score) * F.col(weight))
    return xwalk.groupBy(src).agg(F.when(w > 0, sw / w).otherwise(0.0).alias(score))


def shortage_score(designations: DataFrame, xwalk: DataFrame, area: str, tract: str, weight: str) -> DataFrame:
    """Designated scores (max per tract, else per county, else 0), area-weighted up to the area.

    ``designations`` holds ``kind`` ('tract' or 'county'), ``code`` and ``score``.
    """
    best = designations.where(F.col("score").isNotNull()).groupBy("kind", "code").agg(F.max("score").alias("score"))
    fine = best.where(F.col("kind") == "tract").select(F.col("code").alias(tract), "score")
    coarse = best.where(F.col("kind") == "county").select(F.col("code").alias("county_code"), "score")
    scored = fallback_chain(xwalk, fine, tract, coarse, F.substring(F.col(tract), 1, 5), "score")
    return area_weighted_mean(scored, area, weight, "score")


def expand_members(df: DataFrame, members: str, out: str, width: int) -> DataFrame:
    """One row per member code of a comma-joined list, padded to ``width``."""
    each = df.withColumn(out, F.explode(F.split(F.col(members), ",")))
    return each.withColumn(out, F.lpad(F.trim(F.col(out)), width, "0")).drop(members)
