"""Area-key and code normalization as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AREA_KEY_PATTERN = r"^\d{5}$"


def norm_area_key(c: Column) -> Column:
    """Trim, undo float text (``123.0``), keep five characters, left-pad with zeros."""
    return F.lpad(F.substring(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), 1, 5), 5, "0")


def postal_digits(c: Column) -> Column:
    """Five digits from free postal text; null when nothing usable or all zeros is left."""
    five = F.lpad(F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 5), 5, "0")
    return F.when(five.rlike("^[0-9]{5}$") & (five != "00000"), five)


def norm_fips(c: Column, width: int = 5, drop_state_totals: bool = False) -> Column:
    """Zero-padded code of ``width`` digits, null when malformed (or a ``000`` total row)."""
    code = F.trim(c.cast("string"))
    code = F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)
    ok = code.rlike(rf"^\d{{{width}}}$")
    if drop_state_totals:
        ok = ok & ~code.endswith("000")
    return F.when(ok, code)


def strict_digits_key(c: Column, width: int = 5) -> Column:
    """Lookup key: ASCII digits only, padded to ``width``; anything else is rejected as null."""
    t = F.trim(c)
    return F.when(t.rlike(f"^[0-9]{{1,{width}}}$"), F.lpad(t, width, "0"))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    """Upper-cased code begins with any prefix; null code is false."""
    up = F.upper(c)
    return F.coalesce(reduce(lambda a, b: a | b, [up.startswith(p) for p in prefixes]), F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    """Lower-cased text holds any of ``words``; null text is false."""
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))


def in_prefix_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    """Three-digit prefix lies in any inclusive range."""
    p3 = F.substring(c, 1, 3).cast("int")
    return reduce(lambda a, b: a | b, [p3.between(lo, hi) for lo, hi in ranges])
