"""JSON payloads: row arrays, feature collections and struct-of-arrays frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_arrays(df: DataFrame, payload: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``[[header...], [row...], ...]`` to rows; columns are looked up in the header by name."""
    keys = list(keys or [])
    rows = F.from_json(F.col(payload), "array<array<string>>")
    parsed = df.select(*keys, rows.alias("rows"))
    each = parsed.select(*keys, F.col("rows")[0].alias("head"), F.explode(F.slice("rows", 2, 2147483647)).alias("row"))
    pick = [F.try_element_at("row", F.array_position("head", c).cast("int")).alias(c) for c in columns]
    return each.select(*keys, *pick)


def feature_attributes(df: DataFrame, payload: str, fields: str, keys: list[str] | None = None,
                       attributes: str = "attributes") -> DataFrame:
    """``{features: [{attributes: {...}}]}`` to one row per feature. ``fields`` is a DDL list."""
    schema = f"features array<struct<{attributes}: struct<{fields}>>>"
    each = df.select(*list(keys or []), F.explode(F.from_json(F.col(payload), schema)["features"]).alias("f"))
    return each.select(*list(keys or []), f"f.{attributes}.*")


def geometry_universe(df: DataFrame, payload: str, key: str, need_geometry: bool = False) -> DataFrame:
    """Distinct area codes of a feature collection; null geometries drop when centroids are needed."""
    ring = "struct<type: string, coordinates: array<array<array<double>>>>"
    schema = f"features array<struct<properties: struct<{key}: string>, geometry: {ring}>>"
    each = df.select(F.explode(F.from_json(F.col(payload), schema)["features"]).alias("f"))
    if need_geometry:
        each = each.where(F.col("f.geometry").isNotNull())
    return each.select(F.col(f"f.properties.{key}").alias(key)).distinct()


def columnar_frame(df: DataFrame, payload: str, columns: dict[str, str], flags: tuple[str, ...] = ()) -> DataFrame:
    """``{"n": rows, "col": [...]}`` back to rows.

    ``columns`` maps names to element types; 0/1 flag columns become booleans. A column that is
    missing or not ``n`` long raises when the rows are read.
    """
    schema = "n int, " + ", ".join(f"`{c}` array<{t}>" for c, t in columns.items())
    parsed = df.select(F.from_json(F.col(payload), schema).alias("p")).select("p.*")
    aligned: Column = F.col("n").isNotNull() & (F.col("n") >= 0)
    for c in columns:
        aligned = aligned & F.coalesce(F.size(c) == F.col("n"), F.lit(False))
    checked = F.when(aligned, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("frame column missing or misaligned")))
    rows = parsed.select(F.explode(checked).alias("r")).select("r.*")
    return rows.withColumns({c: F.col(c) != 0 for c in flags}) if flags else rows
