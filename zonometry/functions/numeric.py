"""Numeric parsing, guarded ratios and null-aware row arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Missing-data codes of the census tables.
SENTINELS = (-666666666, -999999999, -888888888, -555555555, -333333333, -222222222)
# Fixed value: 90% margins divide by this to give a standard error.
MARGIN_Z = 1.645
# Fixed value: half-width multiplier of a 95% interval.
INTERVAL_Z = 1.96


def to_double(c: Column) -> Column:
    """Number or null; NaN counts as missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def scrub_sentinels(c: Column, sentinels: tuple[int, ...] = SENTINELS) -> Column:
    d = to_double(c)
    return F.when(~d.isin([float(s) for s in sentinels]), d)


def margin_magnitude(c: Column) -> Column:
    return F.abs(scrub_sentinels(c))


def suppressed_cell(c: Column) -> tuple[Column, Column]:
    """(value, censored): text cell to a number; a real zero stays, anything else is censored."""
    value = to_double(F.regexp_replace(F.trim(c), ",", ""))
    return value, value.isNull()


def interval_to_se(c: Column) -> Column:
    """``"( lo, hi)"`` to a standard error."""
    parts = F.regexp_extract_all(c, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1))
    lo, hi = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (hi.try_cast("double") - lo.try_cast("double")) / F.lit(2 * INTERVAL_Z)


def year_mdy(c: Column) -> Column:
    return F.year(F.try_to_timestamp(c, F.lit("MM/dd/yyyy")))


def strip_non_numeric(c: Column) -> Column:
    return to_double(F.regexp_replace(c, "[^0-9.]", ""))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, num / den)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps null (greatest/least alone would not)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def row_count(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])


def row_sum(cols: list[Column]) -> Column:
    """Sum of the present members; null only when all are missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(row_count(cols) > 0, total)


def row_mean(cols: list[Column]) -> Column:
    return F.when(row_count(cols) > 0, row_sum(cols) / row_count(cols))


def member_rate(members: list[Column], den: Column, complement: bool = False) -> Column:
    """(sum of members)/den clipped to 0..1; the complement reads (den - members)/den."""
    num = row_sum(members)
    num = den - num if complement else num
    return clip(guarded_ratio(num, den), 0.0, 1.0)


def proportion_se(moe_num: Column, moe_den: Column, p: Column, den: Column) -> Column:
    """Standard error of a ratio from the margins of its parts."""
    return guarded_ratio(F.sqrt(moe_num * moe_num + p * p * moe_den * moe_den), den) / MARGIN_Z


def root_sum_square(cols: list[Column]) -> Column:
    return F.sqrt(row_sum([c * c for c in cols]))


def input_cv(pairs: list[tuple[Column, Column]], cap: float = 2.0) -> Column:
    """Mean over rates of clip(se/estimate, 0, cap), only where the estimate is positive."""
    return row_mean([clip(guarded_ratio(se, est), 0.0, cap) for est, se in pairs])


def tier(pctile: Column, scoreable: Column) -> Column:
    return F.when(scoreable & pctile.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(pctile / 10))))
