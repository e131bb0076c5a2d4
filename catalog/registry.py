"""Registration helper shared by the sections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zonometry.session import shared_dir


class Section:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def query(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"


def land_csv(df: DataFrame, name: str, sep: str = ",", encoding: str = "UTF-8", keep_space: bool = False) -> str:
    """Write a derived table as delimited text with a header, for the text scans to read."""
    path = fresh_path(df.sparkSession, name)
    w = df.write.option("header", "true").option("sep", sep).option("encoding", encoding).option("escape", '"')
    if keep_space:
        w = w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    w.csv(path)
    return path
