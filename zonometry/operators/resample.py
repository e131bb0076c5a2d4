"""Block bootstraps with replicates as data: (replicate, block, times) joined to block sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonometry.functions.noise import digest, uniform
from zonometry.operators.rank import exact_quantiles, global_index
from zonometry.operators.stats import centred, corr_of, gram, gram_names, partials, sum_grams, weighted_r
from zonometry.session import stage


def cluster_key(level: str, key: Column, state: Column, county: Column) -> Column:
    """Block label: state|county or state; rows without one are blocks of their own."""
    st, co = F.coalesce(state, F.lit("")), F.coalesce(county, F.lit(""))
    solo = F.concat(F.lit("__solo_"), key.cast("string"))
    if level == "state":
        return F.when(st == "", solo).otherwise(st)
    return F.when((st == "") | (co == ""), solo).otherwise(F.concat_ws("|", st, co))


def block_index(df: DataFrame, block: str) -> DataFrame:
    """(block, idx): consecutive numbers in block order."""
    blocks = df.select(block).where(F.col(block).isNotNull()).distinct()
    return global_index(blocks, [F.col(block)], "idx", "blocks")


def _picks(index: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, idx): the block of every slot of every replicate.

    Each slot of each replicate hashes to one block, so a rerun draws the same whatever the
    partitioning.
    """
    n = index.count()
    slots = index.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("slot"))
    pick = F.floor(uniform(digest(F.lit(seed), F.col("replicate"), F.col("slot")), 0) * n).cast("long")
    return slots.select("replicate", pick.alias("idx"))


def draw_counts(index: DataFrame, block: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, block, times): blocks drawn with replacement; replicate -1 is the sample itself."""
    drawn = _picks(index, replicates, seed).groupBy("replicate", "idx").agg(F.count(F.lit(1)).alias("times"))
    drawn = drawn.join(index, "idx").select("replicate", block, "times")
    itself = index.select(F.lit(-1).alias("replicate"), block, F.lit(1).cast("long").alias("times"))
    return drawn.unionByName(itself)


def draw_vectors(index: DataFrame, block: str, replicates: int, seed: int) -> DataFrame:
    """(block, draws): ``draw_counts`` as one row a block, its counts in all replicates as 16-bit integers; replicate -1 has place 0.

    A slot is a pair of numbers that is shuffled and sorted once; the name of its block joins the finished vector.
    """
    width = replicates + 1

    def dense(batches):
        def made(idx, counts):
            return pa.record_batch([pa.array(idx, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in counts], pa.binary())], ["idx", "draws"])

        last, held = np.empty(0, np.int64), np.zeros((0, width), np.int64)  # the block that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, at = batch.column("idx").to_numpy(), batch.column("replicate").to_numpy() + 1
            found, place = np.unique(idx, return_inverse=True)
            counts = np.bincount(place * width + at, minlength=len(found) * width).reshape(-1, width)
            if len(last) and last[0] == found[0]:
                counts[0] += held[0]
            elif len(last):
                yield made(last, held)
            yield made(found[:-1], counts[:-1])
            last, held = found[-1:], counts[-1:]
        yield made(last, held)

    slots = _picks(index, replicates, seed).unionByName(index.select(F.lit(-1).alias("replicate"), "idx"))
    vectors = slots.repartition("idx").sortWithinPartitions("idx").mapInArrow(dense, "idx long, draws binary")
    return vectors.join(index, "idx").select(F.col(block).alias("block"), "draws")


def bootstrap_grams(df: DataFrame, cols: list[str], block: str, replicates: int, seed: int,
                    by: list[str] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Gram sums per replicate (and ``by``): rows collapse to block sums before any replication.

    Blocks are drawn from all rows, also those whose columns are incomplete; only the sums skip them. ``vectors``: a
    stage table of ``draw_vectors`` over the same blocks, replicates and seed, where several statistics share it.
    """
    by = list(by or [])
    sums = stage(gram(centred(df, cols), cols, [block, *by]), "block-grams")
    if by:
        joined = sums.join(draw_counts(block_index(df, block), block, replicates, seed), block)
        return sum_grams(joined, len(cols), ["replicate", *by], F.col("times"))
    if vectors is None:
        vectors = stage(draw_vectors(block_index(df, block), block, replicates, seed), "draws")
    return drawn_sums(sums.withColumn("__cell", F.lit(0)), vectors, block, "__cell", gram_names(len(cols))).drop("cell").where("n > 0")


def bootstrap_partials(df: DataFrame, cols: list[str], block: str, replicates: int, seed: int,
                       min_rows: int = 100, vectors: DataFrame | None = None) -> DataFrame:
    """(replicate, stat): partial r of the first two columns given the rest, in every replicate."""
    grams = bootstrap_grams(df.select(block, *cols), cols, block, replicates, seed, vectors=vectors).where(F.col("n") >= min_rows)
    return partials(grams, len(cols), ["replicate"], {"stat": (0, 1, list(range(2, len(cols))))}).drop("n")


def intervals(stats: DataFrame, value: str, by: list[str] | None = None, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Point (replicate -1), percentile interval over the replicates, whether it excludes 0, share above 0."""
    by = list(by or [])
    point = stats.where(F.col("replicate") == -1).select(*by, F.col(value).alias("point"))
    drawn = stats.where(F.col("replicate") >= 0)
    ci = exact_quantiles(drawn, value, [lo, hi], by, ["ci_lo", "ci_hi"]).withColumnRenamed("n", "n_boot")
    share = drawn.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))
    if by:
        out = point.join(ci, by).join(share, by)
    else:
        out = point.join(F.broadcast(ci)).join(F.broadcast(share))  # one row each
    return out.withColumn("excludes_0", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


RANK_BUCKET_ROWS = 4000  # tied (value, block) rows that one bucket of the ranked values is meant to hold
HEAVY_ROWS = 2000  # of one value, from which it is split over its blocks
MATRIX_BYTES = 64 << 20  # blocks x replicates counts up to which they are sent to every executor


def _draw_vectors(times: DataFrame, block: str, width: int) -> DataFrame:
    """``block, draws``: each block's counts in all replicates as 16-bit integers; replicate -1, the sample itself, has place 0."""

    def dense(key, table):
        out = np.zeros(width, "<u2")
        out[table.column("replicate").to_numpy() + 1] = table.column("times").to_numpy()
        return pa.table({"block": [key[0].as_py()], "draws": pa.array([out.tobytes()], pa.binary())})

    kind = times.schema[block].dataType.simpleString()
    return times.select(F.col(block).alias("block"), "replicate", "times").groupBy("block").applyInArrow(dense, f"block {kind}, draws binary")


def _vectors_of(times: DataFrame, block: str) -> tuple[DataFrame, int]:
    """``block, draws`` and the replicates in one, from rows of ``draw_counts`` or a stage table of ``draw_vectors``."""
    if "draws" in times.columns:
        one = times.select(F.length("draws")).first()
        return times, one[0] // 2 if one else 1
    width = (times.agg(F.max("replicate")).first()[0] or 0) + 2
    return stage(_draw_vectors(times, block, width), "draws"), width


def with_draws(rows: DataFrame, times: DataFrame, block: str) -> tuple[DataFrame, Callable[[pa.Table], np.ndarray], int]:
    """(rows whose ``block`` is drawn, function that gives the draws of an Arrow piece of them as rows x replicates, replicates).

    Replicate -1, the sample itself, has place 0. The blocks x replicates counts go to every executor as one
    matrix while they are small (``MATRIX_BYTES``), else each row gets its block's vector by a join. ``times``: rows of
    ``draw_counts``, or a stage table of ``draw_vectors``.
    """
    vectors, width = _vectors_of(times, block)
    if vectors.count() * width * 2 > MATRIX_BYTES:
        def joined(piece: pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(piece.column("draws").to_pylist()), "<u2").reshape(-1, width).astype(float)

        return rows.join(vectors, "block"), joined, width
    drawn = vectors.collect()
    place = {r["block"]: i for i, r in enumerate(drawn)}
    shared = rows.sparkSession.sparkContext.broadcast((place, np.frombuffer(b"".join(r["draws"] for r in drawn), "<u2").reshape(-1, width)))

    def looked_up(piece: pa.Table) -> np.ndarray:
        place, matrix = shared.value
        return matrix[[place[x] for x in piece.column("block").to_pylist()]].astype(float)

    return rows.join(vectors.select("block"), "block", "left_semi"), looked_up, width


def _weighed(draws: np.ndarray, who: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Replicates x columns: rows ``x`` times the draws of their blocks ``who``; one that is not finite counts only where it is drawn."""
    w = draws if np.array_equal(who, np.arange(len(draws))) else draws[who]
    known = np.isfinite(x).all(1)
    total = w.T @ np.where(known[:, None], x, 0.0)
    for i in np.flatnonzero(~known):
        at = w[i] > 0
        total[at] += w[i, at, None] * x[i]
    return total


def drawn_sums(sums: DataFrame, times: DataFrame, block: str, cell: str, cols: list[str]) -> DataFrame:
    """``replicate, cell`` and the sums of ``cols`` (rows ``block, cell, cols``), each block's times its draws in every replicate.

    A block's sums and its vector of draws meet in one row, and a task adds (replicates x blocks) by (blocks x sums)
    products, so neither rows nor blocks are ever copied per replicate. Cells (periods, say) are few. ``times`` as in ``with_draws``.
    """
    vectors, width = _vectors_of(times, block)
    each = sums.groupBy(F.col(block).alias("block")).agg(F.collect_list(F.struct(F.col(cell).cast("long").alias("cell"), *[F.col(c).cast("double").alias(c) for c in cols])).alias("x"))
    joined = each.join(vectors, "block").select("x", "draws")

    def run(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("x")
            flat, who = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            x = np.column_stack([flat.field(c).to_numpy() for c in cols])
            w = np.frombuffer(b"".join(batch.column("draws").to_pylist()), "<u2").reshape(-1, width).astype(float)
            cells = flat.field("cell").to_numpy()
            for c in np.unique(cells).tolist():
                at = np.flatnonzero(cells == c)
                out[c] = out.get(c, 0.0) + _weighed(w, who[at], x[at])
        for c, total in out.items():
            yield pa.record_batch([pa.array(np.arange(-1, width - 1, dtype=np.int32)), pa.array(np.full(width, c)), *[pa.array(v) for v in total.T.copy()]], ["replicate", "cell", *cols])

    parts = joined.mapInArrow(run, "replicate int, cell long, " + ", ".join(f"`{c}` double" for c in cols))
    return parts.groupBy("replicate", "cell").agg(*[F.sum(c).alias(c) for c in cols])


def ranked_replicates(df: DataFrame, times: DataFrame, block: str, variants: dict[str, Column],
                      outcomes: list[str], min_pairs: int = 100) -> DataFrame:
    """r of each variant, re-ranked inside every replicate, with each outcome: replicate, variant, outcome, r, n.

    A row drawn twice has weight two: ranks are weighted tie-averaged positions and the correlation is
    weighted by the draws. Rows first collapse to (variant, value, block) sums, which are all that the six sums of a
    correlation need, and meet their draws (``with_draws``). Collapsed rows are dealt by range of their values;
    a value with more than ``HEAVY_ROWS`` blocks is split over them and summed per replicate. Bucket totals give every bucket its
    offsets in all replicates, and a second pass ranks a bucket's rows and leaves only sums per replicate.
    """
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.round(v.cast("double"), 9).alias("v")) for n, v in variants.items()]))
    rows = df.select(F.col(block).alias("block"), *[F.col(o).cast("double").alias(f"o{i}") for i, o in enumerate(outcomes)], values.alias("s")).select("*", "s.*").drop("s")
    stats = [name for i in range(len(outcomes)) for name in (f"n{i}", f"b{i}", f"bb{i}")]
    sums = [x.alias(f"{n}{i}") for i in range(len(outcomes)) for n, x in (
        ("n", F.count(f"o{i}").cast("double")), ("b", F.coalesce(F.sum(f"o{i}"), F.lit(0.0))), ("bb", F.coalesce(F.sum(F.col(f"o{i}") * F.col(f"o{i}")), F.lit(0.0))))]
    tied = rows.where(F.col("v").isNotNull() & F.col("block").isNotNull()).groupBy("variant", "v", "block").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    tied, weights, width = with_draws(tied, times, block)
    tied = stage(tied, "tied-rows")
    replicates = np.arange(-1, width - 1, dtype=np.int32)

    def heavy_sums(key, table):
        w = weights(table)
        cols = {c: table.column(c).to_numpy() @ w for c in ("n", *stats)}
        return pa.table({"variant": [key[0].as_py()] * width, "v": [key[1].as_py()] * width, "replicate": replicates} | cols)

    def bucket_totals(key, table):
        total = table.column("n").to_numpy() @ weights(table)
        return pa.table({"variant": [key[0].as_py()] * width, "bucket": pa.array([key[1].as_py()] * width, pa.int32()), "cut": pa.array([key[2].as_py()] * width, pa.int32()),
                         "v": [min(table.column("v").to_pylist())] * width, "replicate": replicates, "n": total})

    names = ["n", "sw", "sa", "sb", "saa", "sbb", "sab"]

    def bucket_sums(key, table, around):
        table = table.sort_by("v")
        w, v, n = weights(table), table.column("v").to_numpy(), table.column("n").to_numpy()
        before, whole = [np.array(around.column(c)[0].as_py()) for c in ("before", "whole")]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        ties = np.add.reduceat(n[:, None] * w, first, 0)
        below = np.cumsum(ties, 0) - ties
        # centred on the known mean of the ranks, so that the sums keep their digits
        a = (before + below + (ties + 1) / 2 - (whole + 1) / 2)[np.repeat(np.arange(len(first)), np.diff([*first, len(v)]))] * w
        out = []
        for i, o in enumerate(outcomes):
            k, b, bb = [table.column(f"{c}{i}").to_numpy() for c in ("n", "b", "bb")]
            aa = np.einsum("i,ij,ij->j", k, a, np.divide(a, w, out=np.zeros_like(a), where=w > 0))
            sums = [k @ w, k @ w, k @ a, b @ w, aa, bb @ w, b @ a]
            out.append(pa.table({"replicate": replicates, "variant": [key[0].as_py()] * width, "outcome": [o] * width} | dict(zip(names, sums))))
        return pa.concat_tables(out)

    heavy = tied.groupBy("variant", "v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HEAVY_ROWS)
    heavy = stage(heavy.select("variant", "v", F.ceil(F.col("m") / HEAVY_ROWS).alias("salts")), "heavy-values")
    light = tied.join(heavy, ["variant", "v"], "left_anti")
    buckets = max(4, -(-light.count() // RANK_BUCKET_ROWS))
    # a bucket is cut at the heavy values that lie inside it
    marked = light.withColumn("mark", F.lit(False)).unionByName(heavy.select("variant", "v", F.lit(True).alias("mark")), allowMissingColumns=True)
    dealt = stage(marked.repartitionByRange(buckets, "variant", "v").withColumn("bucket", F.spark_partition_id()), "marked-buckets")
    cut = F.count_if("mark").over(Window.partitionBy("variant", "bucket").orderBy("v")).cast("int")
    light = stage(dealt.withColumn("cut", cut).where("not mark").drop("mark"), "value-buckets")
    split = tied.join(heavy, ["variant", "v"]).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
    each, part = ["variant", "v", "replicate"], ["variant", "bucket", "cut"]
    pieces = split.groupBy("variant", "v", "salt").applyInArrow(heavy_sums, "variant string, v double, replicate int, " + ", ".join(f"{c} double" for c in ("n", *stats)))
    pieces = pieces.groupBy(*each).agg(*[F.sum(c).alias(c) for c in ("n", *stats)])
    totals = light.groupBy(*part).applyInArrow(bucket_totals, "variant string, bucket int, cut int, v double, replicate int, n double")

    order = Window.partitionBy("variant", "replicate").orderBy("v")
    both = totals.unionByName(pieces, allowMissingColumns=True)
    placed = both.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = stage(placed.withColumn("whole", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "offsets")
    lists = placed.where("bucket is not null").groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("replicate", "before", "whole"))).alias("x"))
    offsets = lists.select(*part, F.col("x.before").alias("before"), F.col("x.whole").alias("whole"))
    schema = "replicate int, variant string, outcome string, " + ", ".join(f"{n} double" for n in names)
    parts = light.groupBy(*part).cogroup(offsets.groupBy(*part)).applyInArrow(bucket_sums, schema)
    a = F.col("before") + (F.col("n") + 1) / 2 - (F.col("whole") + 1) / 2
    by_value = placed.where("bucket is null").withColumn("a", a)
    for i, o in enumerate(outcomes):
        k, b, bb = [F.col(f"{c}{i}") for c in ("n", "b", "bb")]
        cols = [k, k, k * F.col("a"), b, k * F.col("a") * F.col("a"), bb, b * F.col("a")]
        parts = parts.unionByName(by_value.select("replicate", "variant", F.lit(o).alias("outcome"), *[c.alias(n) for c, n in zip(cols, names)]))
    sums = parts.groupBy("replicate", "variant", "outcome").agg(*[F.sum(n).alias(n) for n in names]).where("n > 0")
    return sums.select("replicate", "variant", "outcome", weighted_r(min_pairs).alias("r"), "n")


def paired_replicates(df: DataFrame, xs: list[str], outcomes: list[str], block: str, replicates: int, seed: int,
                      min_pairs: int = 100, vectors: DataFrame | None = None) -> DataFrame:
    """(replicate, x, outcome, r): correlations of every column with every outcome, as they are, in every replicate.

    All pairs are stacked, each on its own complete rows, and collapse to block sums in one combine, which meet their draws
    as in ``bootstrap_grams``.
    """
    named = [(x, o) for x in xs for o in outcomes]
    pairs = [F.struct(F.lit(i).alias("pair"), F.col(x).cast("double").alias("a"), F.col(o).cast("double").alias("b")) for i, (x, o) in enumerate(named)]
    known = df.select(F.col(block).alias("block"), F.explode(F.array(*pairs)).alias("s")).select("block", "s.*").where("a is not null and b is not null")
    means = known.groupBy("pair").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))  # one row a pair
    centre = known.join(F.broadcast(means), "pair").select("block", "pair", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    sums = stage(gram(centre, ["a", "b"], ["block", "pair"]), "pair-grams")
    if vectors is None:
        vectors = stage(draw_vectors(block_index(df.select(F.col(block).alias("block")), "block"), "block", replicates, seed), "draws")
    grams = drawn_sums(sums, vectors, "block", "pair", gram_names(2)).where(F.col("n") >= min_pairs)
    x, outcome = (F.array(*[F.lit(p[i]) for p in named])[F.col("cell").cast("int")] for i in (0, 1))
    return grams.select("replicate", x.alias("x"), outcome.alias("outcome"), corr_of(0, 1).alias("r"))


def split_assignment(items: list[str], splits: int, seed: int, spark) -> DataFrame:
    """(split, item, half): every split cuts the items into two random halves of floor/ceil size."""
    base = spark.range(splits).select(F.col("id").cast("int").alias("split"),
                                      F.explode(F.array(*[F.lit(i) for i in items])).alias("item"))
    order = Window.partitionBy("split").orderBy(digest(F.lit(seed), F.col("split"), F.col("item")), "item")
    half = F.when(F.row_number().over(order) <= len(items) // 2, 0).otherwise(1)
    return base.select("split", "item", half.alias("half"))


def split_half(long: DataFrame, key: str, item: str, value: str, items: list[str], splits: int, seed: int,
               min_pairs: int = 10) -> DataFrame:
    """Per split: r of the two half means and its Spearman-Brown step-up.

    Each key's values meet once, as a row with a column per item; both half means of all splits are then two
    small matrix products per batch of rows, and only sums per split leave the task.
    """
    assigned = split_assignment(items, splits, seed, long.sparkSession).collect()  # splits x items rows
    half = np.zeros((2, len(items), splits))
    for r in assigned:
        half[r["half"], items.index(r["item"]), r["split"]] = 1
    wide = long.where(F.col(value).isNotNull()).groupBy(key).agg(*[F.avg(F.when(F.col(item) == i, F.col(value))).alias(f"i{k}") for k, i in enumerate(items)])
    names = ["n", "sw", "sa", "sb", "saa", "sbb", "sab"]

    def sums(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            n = [known @ h for h in half]
            both = (n[0] > 0) & (n[1] > 0)
            a, b = (np.where(both, (x @ h) / np.maximum(c, 1), 0.0) for h, c in zip(half, n))
            cols = [both.sum(0), both.sum(0), a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)]
            yield pa.record_batch([pa.array(np.arange(splits, dtype=np.int32)), *[pa.array(c.astype(float)) for c in cols]], ["split", *names])

    parts = wide.drop(key).mapInArrow(sums, "split int, " + ", ".join(f"{n} double" for n in names))
    r = parts.groupBy("split").agg(*[F.sum(n).alias(n) for n in names]).where(F.col("n") >= min_pairs)
    r = r.select("split", weighted_r(min_pairs).alias("r"), F.col("n").cast("long").alias("n"))
    return r.withColumn("stepped", 2 * F.col("r") / (1 + F.col("r")))
