"""Data-quality gates: each is one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-digit codes a county key may start with (01-56 and the territories).
STATE_PREFIXES = [f"{i:02d}" for i in range(1, 57)] + ["60", "66", "69", "72", "74", "78"]


def key_format(df: DataFrame, key: str, pattern: str = r"^\d{5}$") -> DataFrame:
    bad = ~F.coalesce(F.col(key).rlike(pattern), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


def ranges(df: DataFrame, limits: dict[str, tuple[float, float]], floor: float = -1e5, tol: float = 0.001) -> DataFrame:
    """min and max of every column in one scan, against its limits and the sentinel floor."""
    cols = list(limits)
    wide = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
                  *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
        F.coalesce((F.col(f"lo_{c}") >= limits[c][0] - tol) & (F.col(f"hi_{c}") <= limits[c][1] + tol)
                   & (F.col(f"lo_{c}") >= floor), F.lit(True)).alias("ok")) for c in cols])).alias("s")
    return wide.select(rows).select("s.*")


def logic(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, plus duplicate keys: rows ``rule, n_bad``."""
    wide = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    broken = wide.unpivot([], list(rules), "rule", "n_bad")
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.lit("duplicate_key").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"))
    return broken.unionByName(dup)


def county_code_bad(c: Column) -> Column:
    return c.isNotNull() & (~c.rlike(r"^\d{5}$") | ~F.substring(c, 1, 2).isin(STATE_PREFIXES))


def volume(df: DataFrame, measures: dict[str, Column], corridors: dict[str, tuple[float, float]]) -> DataFrame:
    """Aggregate measures against their corridors: rows ``measure, value, lo, hi, ok``."""
    wide = df.agg(*[m.cast("double").alias(name) for name, m in measures.items()])
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("measure"), F.col(n).alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
        F.coalesce(F.col(n).between(lo, hi), F.lit(False)).alias("ok")) for n, (lo, hi) in corridors.items()])).alias("s")
    return wide.select(rows).select("s.*")


def require(checks: DataFrame, bad: Column, what: str) -> None:
    """Fail when a check table has a row that is bad."""
    rows = checks.where(bad).limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with counts per side."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def overlap_share(df: DataFrame, cols: list[str], floor: float = 0.9) -> DataFrame:
    """Share of the universe with any data."""
    has = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    share = F.avg(has.cast("double"))
    return df.agg(share.alias("share"), (share >= floor).alias("ok"))
