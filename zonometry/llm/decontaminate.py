"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (a shorter item is one window). Every window is a
set of word shingles, and a document that contains the window contains all of them; so one shingle,
the rarest in the documents, is a sufficient join prefix. Candidates are document positions of that
shingle; the shingle's place in the window fixes where the window would start and end (positional and
length bounds), and the words there are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonometry.llm import bloom
from zonometry.llm import common as C
from zonometry.session import stage

WIDTH = 10
SHINGLE = 5
#: Rows up to which the benchmark's shingles are broadcast (about 32 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Word bytes after A-Z are lower-cased: digits, a-z, and all of the characters beyond ASCII.
WORD = ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _words(piece: pa.RecordBatch, column: str):
    texts = C.texts_of(piece.column(column))
    buf = C.lowered(texts.buf)
    start, end = C.spans(C.byte_class(*WORD)[buf])
    return texts, buf, start, end, C.owner(texts.end, start)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct windows of the items: ``win`` (words joined by a blank), ``n`` words, ``items`` (ids as strings).

    Items without words have no window. An item with a null id has windows and the id ''.
    """

    def run(batches):
        for piece in C.pieces(batches, "text"):
            texts, buf, start, end, doc = _words(piece, "text")
            ids = piece.column("item").to_pylist()
            for d in range(len(ids)):
                lo, hi = np.searchsorted(doc, [d, d + 1])
                words = [buf[s:e].tobytes().decode() for s, e in zip(start[lo:hi], end[lo:hi])]
                n = min(width, len(words))
                wins = sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else []
                yield pa.record_batch([pa.array([ids[d]] * len(wins), pa.string()), pa.array(wins, pa.string()), pa.array([n] * len(wins), pa.int32())], ["item", "win", "n"])

    slim = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "item string, win string, n int").groupBy("win", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _shingles(df: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """``key, pos, h``: every run of ``sizes`` words of every text, by its word position."""

    def run(batches):
        for piece in C.pieces(batches, text):
            texts, buf, start, end, doc = _words(piece, text)
            word = C.span_hash(buf, start, end)
            first = np.searchsorted(doc, np.arange(len(texts.start)))
            keys = piece.column(key)
            for size in sizes:
                h = C.run_hash(word, size)
                whole = np.flatnonzero(doc[: len(h)] == doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
                d = doc[whole]
                yield pa.record_batch([keys.take(pa.array(d)), pa.array((whole - first[d]).astype(np.int32)), C.signed(h[whole])], ["key", "pos", "h"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"key {kind}, pos int, h long")


def _judged(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, width: int, shingle: int):
    """(documents without a candidate, documents with one, function that verifies either): see ``contaminated``."""
    C.require_free(docs, "n_words", "n_hit", "hit_spans", "items", "__key", "__may", "__cand")
    windows = stage(item_windows(items, item_id, item_text, width), "windows").withColumn("h0", F.xxhash64("win"))
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect()]  # at most ``shingle`` numbers
    keyed = C.small_batches(docs).select("*", C.text_key(text).alias("__key"))
    marked = windows.select("h0", "n", F.col("win")).repartition("h0")
    in_windows = _shingles(marked, "h0", "win", sizes or [shingle]).join(marked.select(F.col("h0").alias("key"), "n"), "key")
    in_windows = stage(in_windows, "window-shingles")
    distinct = in_windows.select("h").distinct()
    if in_windows.count() <= BROADCAST_ROWS:
        distinct = F.broadcast(distinct)
    found = _shingles(keyed, "__key", text, sizes or [shingle]).join(distinct, "h").distinct()
    found = stage(found, "found-shingles")

    # the rarest shingle of each window; a window with one that no document has cannot occur
    df = found.groupBy("h").agg(F.count_distinct("key").alias("df"))
    order = Window.partitionBy("key").orderBy("df", "pos")
    ranked = in_windows.join(df, "h", "left").select("*", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("key")).alias("least"))
    prefix = ranked.where("least > 0").withColumn("r", F.row_number().over(order)).where("r = 1")
    prefix = prefix.select("h", F.col("pos").alias("at"), F.col("key").alias("h0")).join(windows, "h0").select("h", "at", "n", "win", "items")

    cand = found.join(prefix, "h").select("key", (F.col("pos") - F.col("at")).alias("start"), "n", "win", "items").where("start >= 0")
    # written first: a join of two plain exchanges lets Spark split the many copies of one text
    per_text = stage(cand.groupBy("key").agg(F.collect_set(F.struct("start", "n", "win", "items")).alias("__cand")), "candidates")
    # texts without any candidate, most of them, stay out of the shuffle
    blocks, n_blocks = bloom.build(per_text, "key")
    probed = bloom.probe(keyed, "__key", blocks, n_blocks, "__may")
    sure = probed.where("not __may").drop("__may").withColumn("__cand", F.lit(None).cast(per_text.schema["__cand"].dataType))
    maybe = probed.where("__may").drop("__may").join(per_text.withColumnRenamed("key", "__key"), "__key", "left")
    sure, maybe = sure.drop("__key"), maybe.drop("__key")
    out = C.schema_of(docs, "n_words long", "n_hit long", "hit_spans array<struct<start:int,end:int>>", "items array<string>")

    def verify(batches):
        for piece in C.pieces(batches, text):
            texts, buf, start, end, doc = _words(piece, text)
            edge = np.searchsorted(doc, np.arange(len(texts.start) + 1))
            n_hit, runs, ids = [], [], []
            for d, cand in enumerate(piece.column("__cand").to_pylist()):
                lo, hi = edge[d], edge[d + 1]
                hit, who = np.zeros(hi - lo + 1, np.int8), set()
                for c in cand or []:
                    s, e = c["start"], c["start"] + c["n"]
                    if e <= hi - lo and all(buf[start[lo + s + i] : end[lo + s + i]].tobytes() == w for i, w in enumerate(c["win"].encode().split(b" "))):
                        hit[s:e] = 1
                        who.update(c["items"])
                a, b = C.spans(hit.astype(bool))
                n_hit.append(int(hit.sum()))
                runs.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                ids.append(sorted(who))
            kept = [piece.column(i) for i, name in enumerate(piece.schema.names) if name != "__cand"]
            more = [pa.array(np.diff(edge)), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))]
            yield pa.record_batch(kept + more, [n for n in piece.schema.names if n != "__cand"] + ["n_words", "n_hit", "hit_spans", "items"])

    return sure, maybe.select(sure.columns), lambda rows: rows.mapInArrow(verify, out)


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, shingle: int = SHINGLE,
) -> DataFrame:
    """Documents with ``n_words, n_hit, hit_spans, items``: words inside occurrences of item windows.

    ``hit_spans`` are maximal runs (start, end) in words, ``items`` the ids of the items with an
    occurring window, sorted as strings. A null or empty text has no words; equal texts get equal
    results, whatever their ids; extra columns pass through, and names that the result adds are
    refused. An empty table of either side gives documents without hits.
    """
    sure, maybe, verify = _judged(docs, items, text, item_id, item_text, width, shingle)
    return verify(sure.unionByName(maybe))


def uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item window occurs; those without a candidate pass as they are."""
    sure, maybe, verify = _judged(docs, items, text, item_id, item_text, WIDTH, SHINGLE)
    return sure.select(*docs.columns).unionByName(verify(maybe).where("n_hit = 0").select(*docs.columns))
