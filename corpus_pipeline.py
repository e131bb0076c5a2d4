"""A corpus pipeline of five stages: quality rules, line dedup, near-duplicates, decontamination, byte-level BPE.

Each stage reads what its predecessor wrote as Parquet in the shared folder, so a lost executor goes back to
files and no stage is planned on top of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonometry.llm import bpe, decontaminate, lines, neardup, quality
from zonometry.llm.common import require_free
from zonometry.session import stage

#: Text that a task of the last stage holds at a time: less than by default, as two Python workers share a task there.
BUCKET_BYTES = 3 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, of any length; one of which only blank lines are left goes.

    ``n_chars`` follows the new text.
    """
    cut = lines.dedup_lines(docs, every=True)
    left = F.col("text").rlike(r"(?U)\S")
    return cut.where((F.col("n_dropped") == 0) | left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the shingles and the similarity of op7: two words, 0.8.

    One changed word touches two of these; of five-word shingles it touches five, which puts most edited copies of texts
    under some 45 words below 0.8.
    """
    return neardup.representatives(docs, width=2, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.uncontaminated(docs, items)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding them gives the text's bytes again."""
    require_free(docs, "round_trip")
    coded = bpe.decode(bpe.encode(docs, bucket_bytes=BUCKET_BYTES))
    same = F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return coded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot state the outlier verdicts (iterated estimates), so tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
