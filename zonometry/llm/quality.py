"""Quality rules by robust multivariate outliers.

Every text becomes a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate (concentration steps from a deterministic robust start) gives
a centre and scatter that the worst two fifths of the group cannot move; a text whose Mahalanobis
distance from its own group passes a chi-square cut is rejected, and so is one that fails the base rules.

A concentration step is one grouped sum: rows are counted and their moments added per (group,
distance bin), so the step needs no sort of the rows, keeps partial sums on the map side, and a
source that holds a third of the table is a few thousand rows after the combine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonometry.llm import common as C
from zonometry.session import stage

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
SPACE = ((0x20, 0x20), (0x09, 0x0D))
FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "upper"]
#: Smallest standard deviation of each feature: one repeated line in a short text, or a group of equal texts, rejects nothing.
FLOORS = [0.05, 0.05, 0.30, 0.20, 0.05]
MIN_ROWS = 100  # a smaller group is judged by its language, a smaller language by all rows
SUBSET = 0.6  # share of a group that the determinant is minimised over; more rows than the rest may not be outliers
TAIL = 1e-6  # chi-square tail beyond which a text is an outlier
BINS_PER_OCTAVE = 32
MAX_STEPS = 40
BROADCAST_GROUPS = 20_000  # groups (some 400 bytes each) whose estimates are broadcast to the rows; with more, the join shuffles


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _per_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return C.mix(keys ^ C.mix((doc + 1).astype(np.uint64)))


def _measure(column: pa.Array) -> list[np.ndarray]:
    texts = C.texts_of(column)
    n, buf = len(texts.start), texts.buf
    space = C.byte_class(*SPACE)[buf]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[texts.end] - total[texts.start]

    start, end = C.spans(~space)
    doc = C.owner(texts.end, start)
    triple = C.run_hash(C.span_hash(buf, start, end), 3)
    whole = doc[: len(triple)] == doc[2:] if len(triple) else np.zeros(0, bool)
    twice = np.flatnonzero(whole)[_repeated(_per_doc(triple[whole], doc[: len(triple)][whole]))]
    covered = np.zeros(len(start), bool)
    for k in range(3):
        covered[twice + k] = True

    feeds = np.flatnonzero(buf == 0x0A)  # every document ends with one, so lines never cross documents
    line_start = np.concatenate([[0], feeds[:-1] + 1]).astype(np.int64) if len(feeds) else feeds
    seen = np.concatenate([[0], np.cumsum(~space)])
    wordy = seen[feeds] > seen[line_start]
    line_doc = C.owner(texts.end, line_start[wordy])
    key = _per_doc(C.span_hash(buf, line_start[wordy], feeds[wordy]), line_doc)
    _, first = np.unique(key, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    return [
        np.bincount(doc, minlength=n),
        count(~space & ((buf & 0xC0) != 0x80)),
        count(symbols[buf]),
        n_lines - np.bincount(line_doc[first], minlength=n),
        np.bincount(doc[covered], minlength=n),
        n_lines,
        count((buf >= 65) & (buf <= 90)),
    ]


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with the counts in ``STATS`` (long). A null text counts as empty; extra columns pass through."""
    C.require_free(docs, *STATS)
    keep = list(docs.columns) if keep is None else list(keep)

    def run(batches):
        for piece in C.pieces(batches, text):
            more = [pa.array(x.astype(np.int64)) for x in _measure(piece.column(text))]
            yield pa.record_batch([piece.column(c) for c in keep] + more, [*keep, *STATS])

    return C.small_batches(docs).mapInArrow(run, C.schema_of(docs.select(*keep), *[f"{s} long" for s in STATS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> list[Column]:
    """Shares of repeated lines and words as logarithms of what is not repeated: a root of a share ends below the cut, these grow past it.

    Words count up to half of the text, where the base rule takes over.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(chars / words).alias("word_length"),
        F.sqrt(F.col("n_symbols") / chars).alias("symbols"),
        (2 * F.log((F.col("n_lines") + 1) / (F.col("n_lines") - F.col("n_dup_lines") + 1))).alias("dup_lines"),
        F.log((words + 1) / (F.greatest(words - 2 * F.col("n_repeat_words"), F.lit(0)) + 1)).alias("repeats"),
        F.sqrt(F.col("n_upper") / chars).alias("upper"),
    ]


def chi2_cdf(x: float, dof: int) -> float:
    half = x / 2
    total = 1 - math.exp(-half) if dof % 2 == 0 else math.erf(math.sqrt(half))
    for k in range(2 - dof % 2, dof, 2):  # P(k + 2) = P(k) - (x/2)^(k/2) e^(-x/2) / Gamma(k/2 + 1)
        total -= half ** (k / 2) * math.exp(-half) / math.gamma(k / 2 + 1)
    return total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _group(level: int, cols: list[str]) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(cols)]))


def _distance() -> Column:
    """Squared Mahalanobis distance by the group's ``centre`` and inverse scatter ``inv`` (row-major)."""
    d = len(FEATURES)
    diff = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    return sum((F.col("inv")[i * d + j] * diff[i] * diff[j] for i in range(d) for j in range(d)), F.lit(0.0))


def _with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params, "fit")  # Spark broadcasts the parameters only while they are small


def fit(stats: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows' fit keys by group, parameters ``fit, centre, inv``) of minimum-covariance-determinant estimates.

    ``groups`` go from the widest to the narrowest; a row is judged by the narrowest level that has
    ``MIN_ROWS`` rows passing the base rules, so small groups borrow their language's estimate.
    A group takes a step's estimate only if its determinant falls; steps end when none does. As
    subsets are finite they end, and ``MAX_STEPS`` is only a stop for the unforeseen.
    """
    d = len(FEATURES)
    rows = stage(stats.where(~base_failed()).select(*groups, *_features()), "features")
    levels = [groups[:k] for k in range(len(groups) + 1)]
    keys = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    for k, cols in enumerate(levels):
        keys = keys.withColumn(f"n{k}", F.sum("n").over(Window.partitionBy(*[F.col(c) for c in cols]))) if cols else keys.crossJoin(F.broadcast(keys.agg(F.sum("n").alias("n0"))))  # one row
    chosen = F.coalesce(*[F.when(F.col(f"n{k}") >= MIN_ROWS, _group(k, cols)) for k, cols in reversed(list(enumerate(levels)))], _group(0, []))
    keys = stage(keys.select(*groups, chosen.alias("fit")), "fit-keys")
    wanted = keys.select("fit").distinct()
    tall = rows.withColumn("fit", F.explode(F.array(*[_group(k, cols) for k, cols in enumerate(levels)])))
    tall = stage(tall.join(wanted, "fit", "left_semi").select("fit", *FEATURES), "fit-rows")

    # start: medians and quartile ranges, from one histogram per group and feature
    bins = tall.select("fit", F.posexplode(F.array(*[F.floor(F.col(f) * 2048) for f in FEATURES])).alias("f", "b"))
    bins = bins.groupBy("fit", "f", "b").agg(F.count(F.lit(1)).alias("c"))
    run, whole = Window.partitionBy("fit", "f").orderBy("b"), Window.partitionBy("fit", "f")
    share = bins.withColumn("upto", F.sum("c").over(run) / F.sum("c").over(whole))
    quart = share.groupBy("fit", "f").agg(*[F.min(F.when(F.col("upto") >= q, F.col("b") / 2048 + 0.5 / 2048)).alias(a) for a, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    start = quart.groupBy("fit").agg(F.sort_array(F.collect_list(F.struct("f", "q1", "q2", "q3"))).alias("q"))
    scale = F.transform("q", lambda x: (x.q3 - x.q1) / 1.349)
    floor2 = F.array(*[F.lit(f * f) for f in FLOORS])
    flat = [F.when(F.lit(i == j), 1 / (scale[i] * scale[i] + floor2[i])).otherwise(0.0) for i in range(d) for j in range(d)]
    params = stage(start.select("fit", F.transform("q", lambda x: x.q2).alias("centre"), F.array(*flat).alias("inv"), F.lit(float("inf")).alias("logdet")), "mcd")

    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    names = [f"s{i}" for i in range(d)] + [f"p{i}_{j}" for i, j in pairs]
    q = chi2_quantile(SUBSET, d)
    consistent = SUBSET / chi2_cdf(q, d + 2)

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(d)]) / r.c
                cov = np.zeros((d, d))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"p{i}_{j}") / r.c - mean[i] * mean[j]
                cov = cov * consistent + np.diag(np.square(FLOORS))
                out.append((r.fit, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["fit", "centre1", "inv1", "logdet1"])

    for _ in range(MAX_STEPS):
        bin_ = F.floor(F.log2(1 + _distance()) * BINS_PER_OCTAVE).alias("b")
        parts = _with_params(tall, params).select("fit", *FEATURES, bin_).groupBy("fit", "b").agg(F.count(F.lit(1)).alias("c"), *sums)
        run, whole = Window.partitionBy("fit").orderBy("b"), Window.partitionBy("fit")
        below = F.sum("c").over(run) - F.col("c")
        inner = parts.withColumn("in", below < F.sum("c").over(whole) * SUBSET).where("in").groupBy("fit").agg(*[F.sum(x).alias(x) for x in ["c", *names]])
        new = inner.mapInPandas(solve, "fit string, centre1 array<double>, inv1 array<double>, logdet1 double")
        better = F.col("logdet1") < F.col("logdet") - 1e-9
        both = params.select("fit", "centre", "inv", "logdet").join(new, "fit")
        params = stage(both.select("fit", *[F.when(better, F.col(f"{c}1")).otherwise(F.col(c)).alias(c) for c in ("centre", "inv", "logdet")], better.alias("better")), "mcd")
        if not params.agg(F.max("better")).first()[0]:
            break
    return keys, params.select("fit", "centre", "inv")


def judge(stats: DataFrame, keys: DataFrame, params: DataFrame, groups: list[str], tail: float = TAIL) -> DataFrame:
    """``stats`` with ``base_failed, distance, kept``; a row that fails the base rules has no distance."""
    C.require_free(stats, "base_failed", "distance", "kept", "__fit")
    named = stats.withColumn("__fit", F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)])))
    by = keys.select(F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)])).alias("__fit"), "fit")
    model = stage(by.join(params, "fit").drop("fit"), "mcd-by-group")
    joined = named.join(F.broadcast(model) if model.count() <= BROADCAST_GROUPS else model, "__fit", "left")
    joined = joined.select(*stats.columns, base_failed().alias("base_failed"), "centre", "inv", *_features())
    distance = F.when(~F.col("base_failed"), _distance()).alias("distance")
    scored = joined.select(*stats.columns, "base_failed", distance)
    cut = chi2_quantile(1 - tail, len(FEATURES))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))


def quality_rules(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), tail: float = TAIL) -> DataFrame:
    """Documents with their statistics, ``base_failed``, ``distance`` and ``kept``.

    Nulls in a group column are a group of their own. A null or empty text has no words and fails the
    base rules. Equal rows get equal verdicts. Extra columns pass through; a column named like an
    added one is refused.
    """
    by = list(groups)
    slim = stage(statistics(docs.select(*by, text), text, by), "quality-statistics")
    keys, params = fit(slim, by)
    return judge(statistics(docs, text), keys, params, by, tail)
