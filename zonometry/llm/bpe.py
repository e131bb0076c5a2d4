"""Byte-level BPE over a global shuffle of distinct words, and decoding by the token-byte table.

Documents are dealt into buckets of bounded text. A bucket's pre-tokens are exploded with their
positions inside the task, and only its distinct words leave it. All buckets' words meet in one shuffle
by the word's hash, where each distinct word is encoded once; the ids go back to the buckets that asked,
and each bucket puts them at its pre-tokens' positions. What is shuffled is the text once and the distinct
words per bucket, both compressed, never a row per token; a bucket's words for one part travel as one row.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonometry.llm import common as C

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BUCKET_BYTES = 5 << 20  # text per bucket, which one task holds at a time


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file; a vocabulary is a file of fixed size, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _unpack(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs])


def _press(items: list[bytes]) -> bytes:
    """A compressed list of byte strings: their number, their lengths, then all of them."""
    head = np.array([len(items), *map(len, items)], "<u4").tobytes()
    return zstandard.ZstdCompressor().compress(head + b"".join(items))


def _unpress(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    edge = (4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _dealt(words: list[str], n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words as bytes, in an order that both ends of the shuffle can rebuild: (words, their parts, first place of each part)."""
    coded = [w.encode() for w in sorted(words)]
    part = np.fromiter((zlib.crc32(w) % n for w in coded), np.int64, len(coded))
    order = np.argsort(part, kind="stable")
    part = part[order]
    return [coded[i] for i in order.tolist()], part, np.flatnonzero(np.diff(part, prepend=-1))


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``keep`` columns (all by default) with ``n_tokens`` and ``ids``: token ids, 4 bytes each, little-endian.

    Each match of ``pattern`` is merged on its own, without special tokens. A null or empty text has no
    tokens; repeated rows stay; columns named like the added ones are refused. ``bucket_bytes``: text that one task holds at a time.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    C.require_free(docs.select(*keep), "n_tokens", "ids")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    vocabulary = spark.sparkContext.broadcast(load_ranks(ranks))
    slim = C.small_batches(docs).select(*keep, *([] if text in keep else [text]))

    def pack(batches):
        for piece in C.gathered(batches, text, 8 << 20):
            bucket = piece.column("__bucket").to_numpy()
            rows = pa.Table.from_batches([piece]).drop_columns(["__bucket"])
            order = np.argsort(bucket, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
            blobs = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.take(pa.array(order[lo:hi])))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(bucket[order[edges[:-1]]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def distinct_words(batches):
        split = regex.compile(pattern)
        rows = ((key, blob) for b in batches for key, blob in zip(b.column("bucket").to_pylist(), b.column("blob")))
        for key, own in itertools.groupby(rows, lambda r: r[0]):  # sorted by bucket: one bucket's words at a time
            found: set[str] = set()
            for _, blob in own:
                for t in _unpack([blob]).column(text).to_pylist():
                    found.update(split.findall(t or ""))
            words, part, first = _dealt(list(found), n)
            blobs = [_press(words[a:b]) for a, b in zip(first, [*first[1:], len(words)])]
            yield pa.record_batch([pa.array(part[first].astype(np.int32)), pa.array([key] * len(first), pa.int32()), pa.array(blobs, pa.binary())], ["part", "bucket", "words"])
        C.give_back()

    def merge(batches):
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        once: dict[bytes, bytes] = {}
        for b in batches:
            out = []
            for blob in b.column("words").to_pylist():
                words = _unpress(blob)
                for w in words:
                    if w not in once:
                        once[w] = np.array(enc.encode_ordinary(w.decode()), "<u4").tobytes()
                out.append(_press([once[w] for w in words]))
            yield pa.record_batch([b.column("part"), b.column("bucket"), pa.array(out, pa.binary())], ["part", "bucket", "ids"])
        del enc, once
        C.give_back()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, split = _unpack(left.column("blob")), regex.compile(pattern)
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        at = [array("i", map(number.__getitem__, split.findall(t or ""))) for t in rows.column(text).to_pylist()]
        blobs = right.take(np.argsort(right.column("part").to_numpy())).column("ids").to_pylist()
        of = dict(zip(_dealt(list(number), n)[0], itertools.chain.from_iterable(map(_unpress, blobs))))
        ids = [of[w.encode()] for w in number]
        coded = [b"".join(map(ids.__getitem__, a)) for a in at]
        more = [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())]
        del number, at, blobs, of, ids, coded
        C.give_back()
        return pa.Table.from_arrays([rows.column(c) for c in keep] + more, names=[*keep, "n_tokens", "ids"])

    keyed = slim.withColumn("__bucket", F.pmod(F.xxhash64(*slim.columns), F.lit(n)).cast("int"))
    packed = keyed.mapInArrow(pack, "bucket int, blob binary").repartition(n, "bucket")
    words = packed.sortWithinPartitions("bucket").mapInArrow(distinct_words, "part int, bucket int, words binary").repartition(n, "part")
    merged = words.mapInArrow(merge, "part int, bucket int, ids binary")
    schema = C.schema_of(docs.select(*keep), "n_tokens long", "ids binary")
    return packed.groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInArrow(assemble, schema)


def decode(coded: DataFrame, ids: str = "ids", ranks: str = RANKS, out: str = "decoded") -> DataFrame:
    """``coded`` with ``out``: the bytes of its ids, by a join of each id with the token-byte table.

    The table is as large as the vocabulary, a fixed file. Null ids decode to no bytes.
    """
    C.require_free(coded, out)
    table = load_ranks(ranks)
    rows = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        rows[rank] = token
    by_id = coded.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        tokens = pa.array(by_id.value, pa.large_binary())
        for piece in C.pieces(batches, ids, 4 << 20):
            blobs = [x or b"" for x in piece.column(ids).to_pylist()]
            joined = tokens.take(pa.array(np.frombuffer(b"".join(blobs), "<u4")))
            at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
            edge = at[np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])])]
            data = joined.buffers()[2].to_pybytes() if len(joined) else b""
            texts = [data[a:b] for a, b in zip(edge[:-1], edge[1:])]
            yield pa.record_batch([*piece.columns, pa.array(texts, pa.binary())], [*piece.schema.names, out])

    return C.small_batches(coded).mapInArrow(run, C.schema_of(coded, f"`{out}` binary"))
