"""Blocked Bloom filter as a table of 256-bit blocks, in DataFrame expressions only.

A block is eight 32-bit words and a key sets one bit in each of them (the split-block layout), so building is
one grouped bit_or and probing one join on the block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = 8
#: Most blocks of a filter (some 80 bytes each), so that it can always be broadcast. With more keys than fit it
#: passes more rows than it need, never fewer.
MAX_BLOCKS = 1 << 18


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from five bits each of a second hash."""
    second = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(table ``block, w0..w7``, number of blocks) of distinct keys."""
    n_blocks = min(MAX_BLOCKS, max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS)))
    words = keys.select(_block(F.col(key), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def probe(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int, out: str) -> DataFrame:
    """``rows`` with ``out``: False if the key is surely not among the filter's keys."""
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(bit) != 0)
    table = blocks.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    joined = rows.join(F.broadcast(table), _block(F.col(key), n_blocks) == F.col("__block"), "left")  # at most MAX_BLOCKS rows
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).select(*rows.columns, out)
