"""MinHash near-duplicates with odd sketches.

Each text's distinct word shingles give MinHash samples, used twice: in bands, whose equal keys are the
candidates, and folded into an odd sketch, a bitmap of parities. The population count of two
sketches' XOR estimates how many samples differ, most precisely where few do, and so sorts out
candidates for a few machine words before the full sets are compared.

Groups of copies never become pairs. Texts with equal sets are one class. Within a band key every
class is tried against the smallest one only (a star); classes that the stars have joined need no
further comparison, and what is left in a band key outside the star is tried against all of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.llm import bloom
from zonometry.llm import common as C
from zonometry.llm.components import components
from zonometry.session import scratch, stage

BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^24 < 4e-6
SKETCH_BITS = 512
MARGIN = 0.3  # star candidates are compared in full down to this far below the threshold by the sketch's estimate
#: The wider sketch of texts that a star leaves open: its estimate has a deviation below 0.01 at similarity 0.8. A
#: quarter of its bits, a sketch of a quarter of the samples, is compared first, with a margin as much wider.
FINE_SAMPLES, FINE_BITS, FINE_MARGIN, QUARTER_MARGIN = 2048, 8192, 0.045, 0.12
SPACE = ((0x20, 0x20), (0x09, 0x0D))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each text's distinct shingles in ascending order, one text after the other."""
    texts = C.texts_of(column)
    buf = C.lowered(texts.buf)
    start, end = C.spans(~C.byte_class(*SPACE)[buf])
    doc = C.owner(texts.end, start)
    word = C.span_hash(buf, start, end)
    n = np.bincount(doc, minlength=len(texts.start))
    run = C.run_hash(word, width)
    whole = doc[: len(run)] == doc[width - 1 :] if len(run) else np.zeros(0, bool)
    h, d = [run[whole]], [doc[: len(run)][whole]]
    for short in range(1, width):  # a text of fewer words is one shingle
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)] & (n[doc] == short)) if len(doc) else np.zeros(0, np.int64)
        h.append(C.run_hash(word, short)[first])
        d.append(doc[first])
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
    return h[new], np.bincount(d[new], minlength=len(texts.start))


def _signatures(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per non-empty text: two words that name its set, band keys, odd sketch."""
    at = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    n = len(at)
    if not n:
        none = np.zeros((0, BANDS), np.uint64)
        return np.zeros((0, 2), np.uint64), none, np.zeros((0, SKETCH_BITS // 64), np.uint64)
    name = np.stack([np.add.reduceat(h, at), np.bitwise_xor.reduceat(C.mix(h + np.uint64(1)), at)], 1)
    salt = C.mix(np.arange(2, 2 + 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(C.BASE))
    bands, sketch = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
    each = np.arange(n)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat(h * (salt[2 * k] | np.uint64(1)) + salt[2 * k + 1], at)
            key = C.mix(key * np.uint64(C.BASE) + least)
            bit = C.mix(least ^ salt[2 * k]) % np.uint64(SKETCH_BITS)
            sketch[each, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
        bands[:, b] = key
    return name, bands, sketch


def odd_sketch(h: np.ndarray, counts: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Odd sketch of each non-empty text from ``samples`` MinHash samples: the parities of the samples' hashed places."""
    at = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    salt = C.mix(np.arange(1, 1 + 2 * samples, dtype=np.uint64) * np.uint64(C.BASE) ^ np.uint64(bits))
    out, each = np.zeros((len(at), bits // 64), np.uint64), np.arange(len(at))
    for k in range(samples if len(at) else 0):
        least = np.minimum.reduceat(h * (salt[2 * k] | np.uint64(1)) + salt[2 * k + 1], at)
        bit = C.mix(least ^ salt[2 * k]) % np.uint64(bits)
        out[each, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return out


def sketch_similarity(a: Column, b: Column, samples: int, bits: int) -> Column:
    """Estimate from two odd sketches: 1 + bits / (4 samples) * ln(1 - 2 * differing / bits)."""
    if bits <= 2048:
        differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))
    else:  # as a fold, since the sum would be too long an expression
        differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    odd = F.greatest(F.lit(1e-9), 1 - 2 * differ / bits)
    return 1 + F.log(odd) * (bits / (4 * samples))


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``id, key, n, k1, k2, bands, sketch`` of every row with an id."""

    def run(batches):
        for piece in C.pieces(batches, "text"):
            h, counts = shingle_sets(piece.column("text"), width)
            name, bands, sketch = _signatures(h, counts)
            full, n = counts > 0, len(counts)
            names = np.zeros((n, 2), np.uint64)
            names[full] = name
            yield pa.record_batch(
                [piece.column("id"), piece.column("key"), pa.array(counts.astype(np.int64)), C.signed(names[:, 0].copy()), C.signed(names[:, 1].copy()),
                 C.lists(C.signed(bands.ravel()), full * BANDS), C.lists(C.signed(sketch.ravel()), full * (SKETCH_BITS // 64))],
                ["id", "key", "n", "k1", "k2", "bands", "sketch"])

    slim = C.small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), C.text_key(text).alias("key"), F.col(text).alias("text")).where("id is not null")
    return slim.mapInArrow(run, "id long, key binary, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _packed_texts(docs: DataFrame, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """``v, blob``: compressed texts of the wanted ids."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("v"), C.pressed(b.column("text").to_pylist())], ["v", "blob"])

    slim = docs.select(F.col(doc_id).cast("long").alias("v"), F.col(text).alias("text")).where("v is not null and text is not null")
    return slim.mapInArrow(run, "v long, blob binary").join(ids, "v", "left_semi")


def _fine(texts: DataFrame, width: int) -> DataFrame:
    """``v, sketch``: the wider odd sketches of compressed texts."""

    def run(batches):
        for b in batches:
            for part in C.opened(b, "blob"):
                h, counts = shingle_sets(part.column("text"), width)
                sketch = odd_sketch(h, counts, FINE_SAMPLES, FINE_BITS)
                yield pa.record_batch([part.column("v"), C.lists(C.signed(sketch.ravel()), (counts > 0) * (FINE_BITS // 64))], ["v", "sketch"])

    return texts.mapInArrow(run, "v long, sketch array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        unpress, last, kept = zstandard.ZstdDecompressor(), None, None

        def one(blob: bytes) -> np.ndarray:
            return shingle_sets(pa.array([unpress.decompress(blob).decode()]), width)[0]

        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(*[b.column(c).to_pylist() for c in ("u", "v", "blob_u", "blob_v")]):
                if y != last:
                    last, kept = y, one(y)
                own = one(x)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(kept) - both) and both:
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    with_u = pairs.join(texts.select(F.col("v").alias("u"), F.col("blob").alias("blob_u")), "u")
    with_both = with_u.join(texts.select("v", F.col("blob").alias("blob_v")), "v")
    return with_both.select("u", "v", "blob_u", "blob_v").mapInArrow(run, "u long, v long")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id, key, n, component``: each row's set size and the smallest id that links reach.

    ``key`` names the text (``common.text_key``). Rows without an id are not in the result. A text without
    words, or a null one, has an empty set and is linked with nothing. A repeated id is judged by each of its texts.
    """
    sig = stage(signatures(docs, doc_id, text, width), "signatures")
    full = sig.where("n > 0")
    classes = full.groupBy("k1", "k2", "n").agg(F.min("id").alias("v"))
    reps = full.join(classes.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("v"), "bands", "sketch")
    sketches = reps.select("v", "sketch")

    keyed = reps.select("v", F.posexplode("bands").alias("i", "band"))
    hubs = keyed.groupBy("band").agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub < last").select("band", "hub")
    shared = stage(keyed.join(hubs, "band"), "shared-bands")
    est = sketch_similarity(F.col("su"), F.col("sv"), BANDS * ROWS, SKETCH_BITS) >= percent / 100 - MARGIN
    star = shared.where("v <> hub").select(F.col("v").alias("u"), F.col("hub").alias("v")).distinct()
    star = star.join(sketches.select(F.col("v").alias("u"), F.col("sketch").alias("su")), "u").join(sketches.select("v", F.col("sketch").alias("sv")), "v")
    star = stage(star.where(est).select("u", "v"), "star-pairs")
    texts = stage(_packed_texts(docs, doc_id, text, shared.select("v").distinct()), "shared-texts")
    links = stage(_confirm(star, texts, width, percent), "links")

    # what the star of a band key has not joined is tried against every other component in the key
    label = components(links)
    known = shared.join(label, "v", "left").select("band", "i", "v", "hub", F.coalesce("component", "v").alias("c"))
    open_ = known.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    rest = known.join(open_, "band").join(label.select(F.col("v").alias("hub"), F.col("component").alias("hc")), "hub", "left")
    rest = stage(rest.select("band", "i", "v", "c", (F.col("c") != F.coalesce("hc", "hub")).alias("outside")), "open-bands")
    fine = stage(_fine(texts.join(rest.select("v").distinct(), "v", "left_semi"), width), "wider-sketches")
    quarter = sketch_similarity(F.col("su"), F.col("sv"), FINE_SAMPLES // 4, FINE_BITS // 4) >= percent / 100 - QUARTER_MARGIN
    est = quarter & (sketch_similarity(F.col("su"), F.col("sv"), FINE_SAMPLES, FINE_BITS) >= percent / 100 - FINE_MARGIN)
    rest = rest.join(fine, "v").join(reps.select("v", "bands"), "v")
    left = rest.where("outside").select("band", "i", F.col("v").alias("a"), F.col("c").alias("ca"), F.col("sketch").alias("su"), F.col("bands").alias("ba"))
    right = rest.select("band", F.col("v").alias("b"), F.col("c").alias("cb"), F.col("sketch").alias("sv"), F.col("bands").alias("bb"))
    # a pair that shares several bands is taken in the first of them
    once = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("i") + 1
    more = left.join(right, (left["band"] == right["band"]) & (F.col("ca") != F.col("cb")) & est & once)
    more = more.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    more = stage(more, "open-pairs").join(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    links = links.union(stage(_confirm(more, texts, width, percent), "more-links"))

    whole = components(links)
    told = stage(classes.join(whole, "v", "left").select("k1", "k2", "n", F.coalesce("component", "v").alias("component")), "class-components")
    placed = full.select("id", "key", "n", "k1", "k2").join(told, ["k1", "k2", "n"]).select("id", "key", "n", "component")
    return placed.union(sig.where("n = 0").select("id", "key", "n", F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Documents with ``n_shingles, component_id, kept``: one document of each group of links is kept.

    A row without an id cannot stand for a group nor be pointed to: it has no component and stays.
    Rows that repeat an id and a text share a verdict. Extra columns pass through; names that the result
    adds are refused.
    """
    C.require_free(docs, "n_shingles", "component_id", "kept", "__id", "__key")
    found = linked(docs, doc_id, text, width, percent).select(F.col("id").alias("__id"), F.coalesce("key", F.lit(b"")).alias("__key"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).distinct()
    keyed = docs.select("*", F.col(doc_id).cast("long").alias("__id"), F.coalesce(C.text_key(text), F.lit(b"")).alias("__key"))
    joined = keyed.join(found, ["__id", "__key"], "left").withColumn("kept", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)))
    return joined.select(*docs.columns, "n_shingles", "component_id", "kept")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, by way of the few that go: the others never leave their place."""
    C.require_free(docs, "__id", "__key", "__name", "__may")
    with scratch(docs.sparkSession):
        gone = linked(docs, doc_id, text, width, percent).where(F.col("id") != F.col("component")).select(F.xxhash64("id", "key").alias("__name"), F.col("id").alias("__id"), F.col("key").alias("__key"))
        gone = stage(gone.distinct(), "near-duplicates", keep=True)
    blocks, n_blocks = bloom.build(gone, "__name")
    keyed = docs.select("*", F.col(doc_id).cast("long").alias("__id"), C.text_key(text).alias("__key")).withColumn("__name", F.xxhash64("__id", "__key"))
    probed = bloom.probe(keyed, "__name", blocks, n_blocks, "__may")
    left = probed.where("__may").join(gone.select("__id", "__key"), ["__id", "__key"], "left_anti")
    return probed.where("not __may").unionByName(left.select(probed.columns)).select(*docs.columns)
