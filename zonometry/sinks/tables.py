"""Scored-table outputs: parquet, gzip CSV, columnar JSON, prefix shards, dictionary, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.plans.model import Model


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def write_json(df: DataFrame, path: str, partition_by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def quantized(df: DataFrame, cols: list[str]) -> list[Column]:
    """Cells of the columnar payload: doubles to whole numbers, booleans to 0/1, rest unchanged."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        if types[c] in ("double", "float"):
            return F.bround(c).cast("long").alias(c)  # halves go to even
        if types[c] == "boolean":
            return F.col(c).cast("int").alias(c)
        return F.col(c)

    return [cell(c) for c in cols]


def columnar_records(df: DataFrame, part: str, key: str, cols: list[str], chunk: int = 4096) -> DataFrame:
    """Struct-of-arrays records: ``part, chunk, n, payload`` with rows in key order.

    One record holds at most about ``chunk`` rows: large parts are cut by key hash, so no task or
    row ever gathers a whole part.
    """
    sizes = df.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("__chunks"))
    cells = df.select(F.col(part), F.struct(F.col(key), *quantized(df, cols)).alias("r"))
    placed = cells.join(sizes, part).withColumn("chunk", F.pmod(F.crc32(F.col(f"r.{key}").cast("string").cast("binary")), F.col("__chunks")))
    lists = placed.groupBy(part, "chunk").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    # reading a field of an array of structs gives the array of that field
    frame = F.struct(F.size("rows").alias("n"), *[F.col(f"rows.{c}").alias(c) for c in [key, *cols]])
    return lists.select(part, "chunk", F.size("rows").alias("n"), F.to_json(frame, {"ignoreNullFields": "false"}).alias("payload"))


def prefix_shards(df: DataFrame, key: str, cols: list[str], digits: int = 3, places: int = 4) -> DataFrame:
    """One row per area: prefix and its record as JSON without nulls, doubles to four places.

    Written with ``partitionBy(prefix)`` this is one folder per prefix; a map per prefix would
    gather a hot prefix into one row.
    """
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        if types[c] != "double":
            return F.col(c)
        finite = ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
        return F.when(finite, F.round(c, places)).alias(c)

    record = F.to_json(F.struct(F.col(key), *[cell(c) for c in cols]))
    return df.select(F.substring(F.col(key), 1, digits).alias("prefix"), F.col(key), record.alias("record"))


ENTRY = "column string, group string, description string, source string, direction string, resolution string, units string"
DIRECTIONS = {1: "higher = worse", -1: "higher = better, turned for the score"}
WORSE, PERCENTILE = "higher = worse", "percentile 0-100"


def model_entries(model: Model, more: dict[str, tuple[str, str, str]] | None = None) -> list[tuple]:
    """Dictionary entries of every column that a model makes, and of ``more`` (column: group, description, units)."""
    out = []
    for dim, sub in model.subscores:
        scored = "scored" if sub.scored else "computed but not scored"
        for m in sub.measures:
            out.append((m.column, f"measure / {sub.label}", m.label, sub.source, DIRECTIONS[m.direction], m.resolution, m.units))
            out.append((f"{m.column}_pctile", f"measure percentile / {sub.label}", f"Percentile of {m.label}, oriented", sub.source, WORSE, m.resolution, PERCENTILE))
        out.append((f"{sub.key}_pctile", f"sub-score / {dim.label}", f"{sub.label} sub-score ({scored}): mean of its members' percentiles, re-ranked", sub.source, WORSE, sub.resolution, PERCENTILE))
    out += [(f"{d.key}_pctile", "dimension", d.label, "", WORSE, "", PERCENTILE) for d in model.dimensions]
    return out + [(c, g, text, "", "", "", units) for c, (g, text, units) in (more or {}).items()]


def data_dictionary(df: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per column: its entry, type and non-null count in one scan; a column without an entry is ``undocumented``."""
    cols = df.columns
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "column", "non_null")
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    out = counts.join(F.broadcast(types), "column").join(entries, "column", "left")
    return out.withColumn("group", F.coalesce("group", F.lit("undocumented")))


def run_metrics(df: DataFrame, stage: str, metrics: dict[str, Column]) -> DataFrame:
    """Audit rows ``stage, metric, value`` from one aggregate."""
    wide = df.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "value").withColumn("stage", F.lit(stage))
