"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "zonometry") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a session that runs in this one process (``local[n]``) gets a folder of its own when
    neither is set; on a cluster an executor would write its own copy of it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="zonometry-"))
    return context.getCheckpointDir().rstrip("/")


#: Paths of the stage tables written inside each open ``scratch`` block, the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside the block are removed at its end, but for those staged with ``keep``.

    For operators whose result hangs on one last table: nothing outside the block may still read the others. A table
    that is kept belongs to the next block outside, or stays where there is none.
    """
    own: list[str] = []
    mark = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(mark)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as a parquet stage table in the shared folder and read it back.

    Used between the levels of the scoring hierarchy: later levels then scan columns instead
    of replanning everything above them, and a lost executor re-reads files. ``keep`` takes the table
    out of the innermost ``scratch`` block.
    """
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    blocks = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if blocks:
        blocks[-1].append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
