"""Connected components of an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonometry.session import stage


def _rewire(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    kept = large.join(down, "u").select("u", "v", "m")
    small = kept.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, component`` for every vertex of ``edges`` (u, v: long) but the smallest of each component.

    A round sends every neighbour to the smallest vertex that its centre knows, so long chains halve; it
    groups with map-side combine and joins on the centre, and never gathers a vertex's neighbours. Rounds
    end when the edges stay the same, which is when each component is one star.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
        mark, now = seen, stage(_rewire(now), "edges")
