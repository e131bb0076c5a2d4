"""Ranks, quantiles and positions that never sort a whole table in one task.

Every rank starts from (group, value, count): ties collapse in a map-side combine, so one value
held by a third of the rows is a single row. Values are then cut into buckets, the (few) bucket
totals give offsets, and a running sum inside each bucket finishes the rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonometry.session import stage

BUCKETS = 128
STEP = 16


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that matches null keys and keeps one copy of them."""
    renamed = right.select([F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def value_positions(
    df: DataFrame, value: str, by: list[str] | None = None,
    domain: tuple[float, float] | None = None, weight: str | None = None, keep_zero: bool = False,
) -> DataFrame:
    """Distinct values with their place: ``by, value, c, before, n``.

    ``c`` counts the ties (or sums ``weight``), ``before`` the rows strictly below, ``n`` the
    non-null rows of the group. Rows of weight zero drop, unless ``keep_zero`` asks where they
    would stand. ``domain`` states a known range (percentiles are 0..100), which
    replaces the quantile pass by equal-width buckets.
    """
    by = list(by or [])
    gkeys = by or ["__all"]
    c = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    if weight is not None and not keep_zero:
        base = base.where(F.col(weight) > 0)
    if not by:
        base = base.withColumn("__all", F.lit(0))
    values = base.groupBy(*gkeys, value).agg(c.alias("c"))
    if domain is None:
        probs = [i / BUCKETS for i in range(1, BUCKETS)]
        cut = F.percentile_approx(value, probs, 20 * BUCKETS).alias("__cuts")
        coarse = F.filter("__cuts", lambda x, i: (i + 1) % STEP == 0)
        cuts = (values.groupBy(*by) if by else values).agg(cut).withColumn("__coarse", coarse)
        tagged = join_null_safe(values, cuts, by, "inner") if by else values.join(F.broadcast(cuts))  # one row
        # bucket = cuts below the value, counted in two steps: every 16th cut, then the 15 between two of them
        tagged = tagged.withColumn("__j", F.size(F.filter("__coarse", lambda x: x < F.col(value))))
        fine = F.size(F.filter(F.slice("__cuts", F.col("__j") * STEP + 1, STEP - 1), lambda x: x < F.col(value)))
        tagged = tagged.withColumn("__b", F.col("__j") * STEP + fine).drop("__cuts", "__coarse", "__j")
    else:
        lo, hi = domain
        slot = F.floor((F.col(value) - lo) * (8 * BUCKETS) / (hi - lo)).cast("int")
        tagged = values.withColumn("__b", F.greatest(F.lit(-1), F.least(F.lit(8 * BUCKETS), slot)))
    sizes = tagged.groupBy(*gkeys, "__b").agg(F.sum("c").alias("__s"))
    run = Window.partitionBy(*gkeys).orderBy("__b")
    whole = Window.partitionBy(*gkeys)
    offsets = sizes.select(
        *gkeys, "__b",
        (F.sum("__s").over(run) - F.col("__s")).alias("__off"),
        F.sum("__s").over(whole).alias("n"),
    )
    placed = join_null_safe(tagged, offsets, gkeys + ["__b"], "inner")
    inside = Window.partitionBy(*gkeys, "__b").orderBy(value)
    placed = placed.withColumn("before", F.col("__off") + F.sum("c").over(inside) - F.col("c"))
    return placed.select(*by, value, "c", "before", "n")


def with_percentile(
    df: DataFrame, value: str, out: str, by: list[str] | None = None,
    domain: tuple[float, float] | None = None, min_count: int = 0,
) -> DataFrame:
    """Tie-averaged percentile 0..100 over the non-null rows of each group; null stays null."""
    by = list(by or [])
    pos = value_positions(df, value, by, domain)
    pct = (F.col("before") + (F.col("c") + 1) / 2) / F.col("n") * 100
    if min_count:
        pct = F.when(F.col("n") >= min_count, pct)
    return _join_values(df, pos, value, by, pct, out)


def _join_values(df: DataFrame, placed: DataFrame, value: str, by: list[str], share: Column, out: str) -> DataFrame:
    """Join a share computed per (by, value) back onto the rows.

    Rows without a value stay out of the join, where they would all meet in one partition.
    """
    ranks = placed.select(F.col(value).alias("__v"), share.alias(out), *[F.col(k).alias(f"__k_{k}") for k in by])
    cond = F.col(value) == F.col("__v")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    known = df.where(F.col(value).isNotNull()).join(ranks, cond, "left").drop("__v", *[f"__k_{k}" for k in by])
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def with_less_share(df: DataFrame, value: str, eligible: Column, out: str) -> DataFrame:
    """100 x (eligible rows strictly below) / (eligible rows), for every row of ``df``."""
    marked = df.withColumn("__e", F.coalesce(eligible, F.lit(False)).cast("double"))
    placed = value_positions(marked, value, weight="__e", keep_zero=True)
    return _join_values(df, placed, value, [], F.when(F.col("n") > 0, F.col("before") / F.col("n") * 100), out)


def with_fixed_share(queries: DataFrame, fixed: DataFrame, value: str, out: str, by: list[str] | None = None,
                     domain: tuple[float, float] | None = None) -> DataFrame:
    """100 x share of a fixed distribution at or below each queried value.

    Both sides enter one set of value positions, the queried rows with weight zero, so the lookup
    is a running sum and not a search per row.
    """
    by = list(by or [])
    both = fixed.select(*by, value, F.lit(1.0).alias("__w")).unionByName(queries.select(*by, value, F.lit(0.0).alias("__w")))
    placed = value_positions(both, value, by, domain, weight="__w", keep_zero=True)
    share = F.when(F.col("n") > 0, (F.col("before") + F.col("c")) / F.col("n") * 100)
    return _join_values(queries, placed, value, by, share, out)


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
    names: list[str] | None = None, domain: tuple[float, float] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, read off the value positions in one aggregate."""
    by = list(by or [])
    names = names or [f"q{i}" for i in range(len(probs))]
    pos = value_positions(df, value, by, domain)
    aggs = [F.max("n").cast("long").alias("n")]
    for p, name in zip(probs, names):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for part, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= idx) & (idx < F.col("before") + F.col("c"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{part}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"__{name}_f"))
    agg = pos.groupBy(*by).agg(*aggs)
    outs = [
        (F.col(f"__{q}_lo") + (F.col(f"__{q}_hi") - F.col(f"__{q}_lo")) * F.col(f"__{q}_f")).alias(q) for q in names
    ]
    return agg.select(*by, "n", *outs)


def global_index(df: DataFrame, order: list[Column], out: str, name: str = "indexed") -> DataFrame:
    """0-based position under a total order.

    A range-partitioned sort is staged with its partition-local ids; the per-partition counts
    (one row per partition) then turn them into consecutive positions.
    """
    sorted_rows = stage(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col("__mid"), 33)
    counts = sorted_rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.lit(0).alias("__g"))
    run = Window.partitionBy("__g").orderBy("__p")
    offsets = counts.select("__p", (F.sum("__n").over(run) - F.col("__n")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__p"), 33)
    return (
        sorted_rows.withColumn("__p", part).join(offsets, "__p")
        .withColumn(out, F.col("__off") + local).drop("__p", "__mid", "__off")
    )


def quantile_class(df: DataFrame, value: str, breaks: list[str], out: str, right_closed: bool = False) -> DataFrame:
    """Class number of a value against break columns already joined onto the row."""
    above = [(F.col(value) > F.col(b)) if right_closed else (F.col(value) >= F.col(b)) for b in breaks]
    return df.withColumn(out, F.when(F.col(value).isNotNull(), sum(a.cast("int") for a in above)))


def rank_trend(old: DataFrame, new: DataFrame, key: str, value: str, moved: float = 5.0) -> DataFrame:
    """Percentile in two vintages over the areas both hold, and the change to one decimal."""
    both = old.select(key, F.col(value).alias("v_old")).join(new.select(key, F.col(value).alias("v_new")), key)
    both = both.where(F.col("v_old").isNotNull() & F.col("v_new").isNotNull())
    long = both.select(
        key, F.explode(F.array(
            F.struct(F.lit("old").alias("vintage"), F.col("v_old").alias("v")),
            F.struct(F.lit("new").alias("vintage"), F.col("v_new").alias("v")))).alias("x"),
    ).select(key, "x.vintage", "x.v")
    ranked = with_percentile(long, "v", "p", ["vintage"])
    wide = ranked.groupBy(key).agg(
        F.max(F.when(F.col("vintage") == "old", F.col("p"))).alias("pct_old"),
        F.max(F.when(F.col("vintage") == "new", F.col("p"))).alias("pct_new"),
    )
    wide = wide.withColumn("delta", F.round(F.col("pct_new") - F.col("pct_old"), 1))
    return wide.withColumn("moved", F.abs("delta") >= moved)
