"""Delimited and parquet sources: text first, types by explicit coercion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "__corrupt"


def all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_csv(spark: SparkSession, path: str, columns: list[str], keep: list[str], where: Column | None = None,
                  sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Large quoted CSV, all text, malformed rows skipped; filter and projection reach the scan.

    A row is malformed by its whole record, whichever columns are kept: the parser must not prune columns,
    so that it counts every field.
    """
    df = (
        spark.read.schema(all_text(columns).add(CORRUPT, T.StringType())).option("header", "true").option("quote", '"').option("escape", '"')
        .option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", "false").csv(path)
    )
    df = df.where(F.col(CORRUPT).isNull())
    return (df if where is None else df.where(where)).select(*[F.col(f"`{k}`") for k in keep])


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Header names of a file, byte-order mark and padding trimmed; reads no data rows."""
    names = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).csv(path).columns
    return [n.lstrip("﻿").strip() for n in names]


def resolve_columns(names: list[str], wanted: dict[str, str], how: str = "exact") -> tuple[dict[str, str], list[str]]:
    """Output name -> source column by case-insensitive name, label substring or regex; and the absent ones."""
    tests = {
        "exact": lambda name, want: name.strip().lower() == want.lower(),
        "contains": lambda name, want: want.lower() in name.strip().lower(),
        "regex": lambda name, want: re.search(want, name, re.I) is not None,
    }
    found = {}
    for out, want in wanted.items():
        match = next((n for n in names if tests[how](n, want)), None)
        if match is not None:
            found[out] = match
    return found, [out for out in wanted if out not in found]


def read_columns(spark: SparkSession, path: str, wanted: dict[str, str], how: str = "exact", sep: str = ",",
                 encoding: str = "UTF-8", required: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Columns of a text file picked by ``resolve_columns``; a missing required one is an error."""
    names = header_of(spark, path, sep, encoding)
    found, absent = resolve_columns(names, wanted, how)
    lost = [r for r in required if r in absent]
    if lost:
        raise ValueError(f"{path}: required columns not found: {lost}")
    df = read_text_csv(spark, path, names, names, sep=sep, encoding=encoding)
    return df.select(*[F.col(f"`{src}`").alias(out) for out, src in found.items()]), absent


def skip_code_row(df: DataFrame, key: str, pattern: str = r"^\d+$") -> DataFrame:
    """Drop second header rows: their key cell does not look like a key."""
    return df.where(F.trim(F.col(key)).rlike(pattern))


def thousands(c: Column) -> Column:
    """``1,234`` to a number; ``*`` and other marks are missing."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_discharges(spark: SparkSession, path: str, zip_name: str, code_name: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Two columns of a tab-delimited discharge file, located by header name; masked areas drop."""
    names = header_of(spark, path, "\t", encoding)
    df = read_text_csv(spark, path, names, [zip_name, code_name], sep="\t", encoding=encoding)
    return df.where(F.col(zip_name).rlike(r"^\d{5}$"))


def read_matrix_export(spark: SparkSession, path: str, year_group: Column | None = None, key_width: int = 5) -> DataFrame:
    """Area-by-year matrix exports (preamble, Year row, key header, totals) to tidy rows.

    Each file's Year row is one small record joined to that file's data lines, so any number of
    files parse in parallel. Rows: file, key (of ``key_width`` digits), year, count, censored.
    """
    from zonometry.functions.numeric import suppressed_cell

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.transform(F.split("value", outside_quotes), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    wide = lines.select("file", cells.alias("cells"))
    first = F.lower(F.trim(F.coalesce(F.col("cells")[0], F.lit(""))))
    label = F.when(first.startswith("year"), 0).when(first.contains("zip") & first.contains("zcta"), 1)
    heads = wide.withColumn("kind", label).where(F.col("kind").isNotNull())
    # the explicit Year row wins over years in the key header
    years = heads.groupBy("file").agg(F.min_by("cells", "kind").alias("labels"), F.max("kind").alias("has_header"))
    years = years.where(F.col("has_header") == 1).select("file", F.posexplode("labels").alias("pos", "lab"))
    year = F.regexp_extract(F.col("lab"), r"\b((?:19|20)\d{2})\b", 1)
    years = years.where(year != "").select("file", "pos", year.cast("int").alias("year"))
    rows = wide.where(F.trim(F.col("cells")[0]).rlike(rf"^\d{{{key_width}}}$"))
    rows = rows.select("file", F.trim(F.col("cells")[0]).alias("key"), F.posexplode("cells").alias("pos", "cell"))
    value, censored = suppressed_cell(F.col("cell"))
    out = rows.join(years, ["file", "pos"]).select(
        "file", "key", "year", value.alias("count"), censored.alias("censored"))
    return out if year_group is None else out.withColumn("year_group", year_group)
