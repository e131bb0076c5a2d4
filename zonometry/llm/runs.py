"""Runs of periodic words by online dyadic square catching.

A catcher is a completed block of 2^k words. It watches the words appended two to four block lengths after
its start: a suffix of as many words that equals the block is half a square, since a square of period q
holds a whole aligned block in its first half, and that block again q words later. Catchers of two words
watch the periods below eight, so every period has one level. Catches of one period that follow each other merge, and
what is left at both ends, less than a block, is found by comparing suffixes in halving steps.
Squares that lie in a run already known by a divisor of their period are no news and are not
followed. All catchers of a level and of many texts advance together as arrays.

Words are compared by 64-bit hashes, stretches of words by 64-bit hashes of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zonometry.llm import common as C

LEAST_WORDS = 12  # shortest run
FEW = 8  # block length up to which every distance is tried
TABLE_BITS = 20
RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Stretches:
    """Equality of stretches of words by prefix sums of a polynomial."""

    def __init__(self, word: np.ndarray):
        self.n = len(word)
        self.power = C.powers(C.BASE, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(word * self.power[: self.n], out=self.sums[1:])
        self.inverse = C.powers(C.INVERSE, self.n + 1)

    def blocks(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each position."""
        out = (self.sums[width:] - self.sums[:-width]) * self.inverse[: self.n - width + 1]
        return out ^ (out >> np.uint64(29))

    def same(self, at: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from ``at`` stand again ``q`` words later; False outside the text."""
        ok = (at >= 0) & (at + q + size <= self.n)
        i = np.where(ok, at, 0)
        j = np.where(ok, at + q, 0)
        return ok & ((self.sums[i + size * ok] - self.sums[i]) * self.power[q] == self.sums[j + size * ok] - self.sums[j])


def _catches(block: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance), by distance and start: aligned blocks that stand again ``low <= distance < high`` words later."""
    n = len(block)
    if width <= FEW:
        found = [np.flatnonzero(block[: n - q : width] == block[q::width]) * width for q in range(low, min(high, n))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.repeat(np.arange(low, low + len(found)), [len(f) for f in found])
    key = (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[key[::width]] = True
    hit = np.flatnonzero(table[key])
    _, group, size = np.unique(block[hit], return_inverse=True, return_counts=True)
    more = size[group] > 1
    hit, group = hit[more], group[more]
    place = np.sort(group * (n + 1) + hit)
    caught = hit % width == 0
    base, start = group[caught] * (n + 1), hit[caught]
    first = np.searchsorted(place, base + np.minimum(start + low, n))
    count = np.searchsorted(place, base + np.minimum(start + high, n)) - first
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(start, count)
    q = place[np.repeat(first, count) + each] - np.repeat(base, count) - start
    order = np.lexsort((start, q))
    return start[order], q[order]


def find_runs(word: np.ndarray, longest: int | None = None, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs of at least ``least`` words and two periods, by start and period.

    ``longest``: words of the longest text, if ``word`` holds several with a hash of its own between them.
    """
    longest = len(word) if longest is None else longest
    runs = np.zeros((3, 0), np.int64)
    if longest < least:
        return tuple(runs)
    text, width = _Stretches(word), 2
    while True:
        low, high = (1, 8) if width == 2 else (2 * width, 4 * width)
        if 2 * low > longest:
            break
        start, q = _catches(text.blocks(width), width, low, min(high, longest // 2 + 1))
        fresh = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(start, prepend=-1) != width))
        if len(fresh):
            left, period = start[fresh], q[fresh]
            right = start[np.append(fresh[1:], len(start)) - 1] + width
            if runs.shape[1]:
                reach = np.maximum.accumulate(runs[1] * runs.shape[1] + np.arange(runs.shape[1])) % runs.shape[1]
                own = np.searchsorted(runs[0], left, "right") - 1
                by = reach[np.maximum(own, 0)]
                news = (own < 0) | (runs[1][by] < right + period) | (period % runs[2][by] != 0)
                left, right, period = left[news], right[news], period[news]
            step = width // 2
            while step:
                left = left - step * text.same(left - step, period, step)
                right = right + step * text.same(right, period, step)
                step //= 2
            long = right - left + period >= np.maximum(least, 2 * period)
            runs = np.concatenate([runs, np.stack([left, right + period, period])[:, long]], 1)
            runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
            # of one stretch's periods the smallest; the others are its multiples
            runs = runs[:, (np.diff(runs[0], prepend=-1) != 0) | (np.diff(runs[1], prepend=-1) != 0)]
        width *= 2
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def _runs_of(piece: pa.RecordBatch, text: str, least: int) -> list[pa.Array]:
    """``n_words, runs, collapsed`` of the texts of a piece."""
    words = [(t or "").encode().split() for t in piece.column(text).to_pylist()]  # bytes split at the six ASCII blanks
    n = np.array([len(w) for w in words], np.int64)
    edge = np.concatenate([[0], np.cumsum(n + 1)])
    flat = np.empty(edge[-1], np.uint64)
    for k, own in enumerate(words):
        flat[edge[k] : edge[k + 1] - 1] = np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64)
        flat[edge[k + 1] - 1] = hash((b"end of text", k)) % (1 << 64)
    start, end, period = find_runs(C.mix(flat), int(n.max(initial=0)), least)
    doc = np.searchsorted(edge, start, "right") - 1
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone) > 0
    collapsed = []
    for k, own in enumerate(words):
        cut = gone[edge[k] : edge[k + 1] - 1]
        if cut.any():
            own = [own[i] for i in np.flatnonzero(~cut).tolist()]
        collapsed.append(b" ".join(own).decode())
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - edge[doc], end - start, period)], ["start", "length", "period"])
    return [pa.array(n), C.lists(runs, np.bincount(doc, minlength=len(words))), pa.array(collapsed, pa.string())]


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """``keep`` columns (all by default) with ``n_words``, ``runs`` and ``collapsed``.

    Words are what stands between ASCII blanks. ``runs``: each maximal stretch of at least ``least`` words
    and two periods, by start and period, with its smallest period. ``collapsed``: the words, joined by one space, without those
    that a run repeats (all of it after its first period). A null text counts as empty: no words, no runs,
    an empty ``collapsed``. Rows are judged one by one, so repeated rows and null ids stay; columns
    named like the added ones are refused. One text's words are held by one task.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    C.require_free(docs.select(*keep), "n_words", "runs", "collapsed")
    slim = C.small_batches(docs).select(*keep, *([] if text in keep else [text]))

    def run(batches):
        for piece in C.pieces(batches, text):
            yield pa.record_batch([*[piece.column(c) for c in keep], *_runs_of(piece, text, least)], [*keep, "n_words", "runs", "collapsed"])

    return slim.mapInArrow(run, C.schema_of(docs.select(*keep), "n_words long", f"runs {RUN_TYPE}", "collapsed string"))
