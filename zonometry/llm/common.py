"""Shared pieces of the text operators: whole texts as one byte buffer, word spans, 64-bit span hashes.

The helpers below run inside Arrow tasks. A batch is cut into pieces of a few megabytes of text,
a piece becomes one byte buffer in which every document ends with a line feed, and everything that
follows is array arithmetic over that buffer, so no row loop touches characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 512 << 10
BATCH_ROWS = 1000
BASE = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial span hash
INVERSE = pow(BASE, -1, 1 << 64)


class Texts(NamedTuple):
    """``buf``: all bytes; document d is ``buf[start[d]:end[d]]`` and a line feed follows it."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, after lowering its session's Arrow batch size: 10,000 long texts at a time do not fit beside a small executor's heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``limit`` bytes of ``column``, for what is packed together."""
    held, size = [], 0
    for piece in pieces(batches, column, limit):
        more = piece.column(column).nbytes
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += more
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def pressed(texts: list[str | None]) -> pa.Array:
    """Compressed texts, for shuffles."""
    z = zstandard.ZstdCompressor()
    return pa.array([None if t is None else z.compress(t.encode()) for t in texts], pa.binary())


def opened(batch: pa.RecordBatch, blob: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch in which column ``blob`` of compressed texts has become ``text``."""
    z = zstandard.ZstdDecompressor()
    names = [n for n in batch.schema.names if n != blob]
    for at in range(0, batch.num_rows, 128):
        part = batch.slice(at, 128)
        text = pa.array([z.decompress(x).decode() for x in part.column(blob).to_pylist()], pa.string())
        yield from pieces([pa.record_batch([*[part.column(n) for n in names], text], [*names, "text"])], "text")


def texts_of(column: pa.Array) -> Texts:
    """One buffer of a string column; a null text counts as empty."""
    end, gap = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    filled = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), end, gap)
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return Texts(buf, offsets[:-1], offsets[1:] - 1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the buffer's last byte is never inside a run."""
    edge = np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (in place on a uint64 array)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int = 0) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 7919 + 1))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for many spans at once, by prefix sums of a polynomial."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(seed)[buf] * powers(BASE, n), out=sums[1:])
    out = (sums[end] - sums[start]) * powers(INVERSE, n + 1)[start]
    return mix(out + (end - start).astype(np.uint64))


def run_hash(item: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive item hashes (length: ``len(item) - width + 1``)."""
    n = len(item) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += item[k : k + n]
    return mix(out)


def owner(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(ends, at, "right")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """List column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def text_key(text: str) -> Column:
    """16 bytes that name a text; results that hang on the text alone are joined back by it."""
    return F.unhex(F.md5(F.col(text)))


def schema_of(df: DataFrame, *more: str) -> str:
    """DDL of a frame's columns and more."""
    return ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + list(more))


def require_free(df: DataFrame, *names: str) -> None:
    """Refuse a frame that already has a column which the operator adds."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added by this operator; rename them first")
