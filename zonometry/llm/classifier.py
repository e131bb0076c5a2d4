"""Quality classifier on supervised subword embeddings.

Words, pairs of words and byte n-grams of words are hashed into a table of vectors; a document is the mean of its
features' vectors, a softmax layer maps it to the two classes, and both are trained by stochastic
gradient descent in numpy. Training reads a bounded sample of labelled rows; scoring reads every
whole text. With two classes the softmax is a logistic of one difference, so scoring needs one number per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.llm import common as C

BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4)
SAMPLE = 6_000  # labelled rows that training reads at most, those of smallest hashed id
EPOCHS = 10
RATE = 2.0
LEAST_STEPS = 20_000
REPEAT = np.uint64(1) << np.uint64(48)  # the pair of a word with itself is one feature, whatever the word
SPACE = ((0x20, 0x20), (0x09, 0x0D))


def held_out(doc_id: str) -> Column:
    """True for ids whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def _features(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """([(bucket, document)] for words, pairs and each n-gram length, number of documents); documents ascend in each part."""
    texts = C.texts_of(column)
    buf = np.concatenate([np.array([0x20], np.uint8), texts.buf])
    ends = texts.end + 1
    space = C.byte_class(*SPACE)[buf]
    buf = np.where(space, np.uint8(0x20), buf)
    start, end = C.spans(~space)
    word, doc = C.span_hash(buf, start, end), C.owner(ends, start)
    pair, near = C.run_hash(word, 2), doc[1:] == doc[:-1]
    pair[word[1:] == word[:-1]] = REPEAT
    parts = [((word >> np.uint64(48)).astype(np.int64), doc), ((pair[near] >> np.uint64(48)).astype(np.int64), doc[1:][near])]
    inner = ~space
    for n in GRAMS:  # a gram may start or end on the blank that bounds a word, but holds none inside
        m = len(buf) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        code = np.zeros(m, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + buf[k : k + m]
            if 0 < k < n - 1:
                ok &= inner[k : k + m]
        at = np.flatnonzero(ok)
        parts.append(((C.mix(code[at] + np.uint64(n)) >> np.uint64(48)).astype(np.int64), C.owner(ends, at + 1)))
    return parts, len(texts.start)


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct buckets and their weights (share of the document's features)."""
    parts, n = _features(column)
    key = np.concatenate([d * BUCKETS + b for b, d in parts])
    key, count = np.unique(key, return_counts=True)
    edge = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
    return [(key[a:b] % BUCKETS, (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)) for a, b in zip(edge[:-1], edge[1:])]


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature vectors, output weights, output bias) after ``epochs`` of SGD with a linearly falling rate.

    Few rows are seen more often, so that there are at least ``LEAST_STEPS`` steps.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = [r for at in range(0, len(texts), 64) for r in _rows(texts.slice(at, 64))]
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(rows))))
    done, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, share = rows[i]
            step = rate * (1 - done / total)
            done += 1
            mean = share @ vectors[buckets]
            out = mean @ weights + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= step * p
            vectors[buckets] -= step * share[:, None] * back[None, :]
    return vectors, weights, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(one number per feature, offset) of the trained model, from labels that are not held out.

    Rows whose label or id is null are not learned from. Without any labelled row every score is 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(text, F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")  # at most ``sample`` rows

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__id", "ascending"), ("__text", "ascending")]).slice(0, sample)
        vectors, weights, bias = train(table.column("__text").combine_chunks(), table.column("__label").to_numpy())
        each = vectors @ (weights[:, 1] - weights[:, 0])
        return pa.table({"each": pa.array([each.astype("<f4").tobytes()], pa.binary()), "offset": pa.array([float(bias[1] - bias[0])])})

    found = rows.withColumn("__one", F.lit(1)).groupBy("__one").applyInArrow(run, "each binary, offset double").first()
    if found is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found["each"], "<f4"), found["offset"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Documents with ``score`` (probability of label 1) and ``predicted``; a null text counts as empty.

    Extra columns pass through; names that the result adds are refused. Equal texts get equal scores.
    """
    C.require_free(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        each, offset = shared.value
        for piece in C.pieces(batches, text):
            parts, n = _features(piece.column(text))
            total, count = np.zeros(n), np.zeros(n)
            for bucket, doc in parts:
                total += np.bincount(doc, each[bucket], minlength=n)
                count += np.bincount(doc, minlength=n)
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + offset, -500, 500)))
            more = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.record_batch([*piece.columns, *more], [*piece.schema.names, "score", "predicted"])

    return C.small_batches(docs).mapInArrow(run, C.schema_of(docs, "score double", "predicted int"))
