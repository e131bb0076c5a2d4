"""Two-step floating-catchment supply with Gaussian distance decay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.operators import blocks, quadtree
from zonometry.operators.blocks import decay, floats, reached, room, unstacked, weighed
from zonometry.operators.blocks import neighbours as nearest_of
from zonometry.operators.spatial import places_of, stacked
from zonometry.session import stage

# Catchment radius and decay (km), bandwidth neighbour and clip, shortage threshold (people
# per provider).
CATCHMENT_KM, DECAY_KM = 16.0, 8.0
BANDWIDTH_K, BANDWIDTH_MIN_KM, BANDWIDTH_MAX_KM = 30, 8.0, 60.0
SHORTAGE_RATIO = 3500

SUPPORT = 3.0  # bandwidths at which the kernel of ``kernel_access`` ends


def gaussian(d: Column, sigma: Column) -> Column:
    return F.exp(F.lit(-0.5) * F.pow(d / sigma, 2))


def two_step(edges: DataFrame, areas: DataFrame, key: str, supplies: list[str], demand: str,
             near: str, w1: Column, w2: Column) -> DataFrame:
    """Access per area for every supply column over weighted edges ``key -> near``.

    Step 1 pools demand over an area's edges and divides its supply by it; step 2 sums the
    ratios over the same edges. All supply types share both passes.
    """
    demands = areas.select(F.col(key).alias(near), F.col(demand).cast("double").alias("__dem"))
    weighted = edges.withColumn("__w1", w1).withColumn("__w2", w2)
    pooled = weighted.join(demands, near).groupBy(key).agg(F.sum(F.col("__dem") * F.col("__w1")).alias("__pool"))
    ratios = areas.join(pooled, key, "left").select(
        F.col(key).alias(near),
        *[F.when(F.col("__pool") > 0, F.coalesce(F.col(s), F.lit(0)) / F.col("__pool")).otherwise(0.0).alias(s)
          for s in supplies])
    return weighted.select(key, near, "__w2").join(ratios, near).groupBy(key).agg(
        *[F.sum(F.col(s) * F.col("__w2")).alias(s) for s in supplies])


def _bandwidth(spans: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """``key, sigma, __far, __n`` from the ``_spans`` of places: the clipped distance to the bandwidth's neighbour, the farthest one and their number."""
    out = areas.select(key, F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).join(spans, ["qlat", "qlon"])
    out = out.groupBy(key).agg(F.max("span").alias("__d"), F.max("far").alias("__far"), F.sum("n").alias("__n"))
    return out.select(key, F.greatest(F.lit(BANDWIDTH_MIN_KM), F.least(F.lit(BANDWIDTH_MAX_KM), "__d")).alias("sigma"), "__far", "__n")


def _spans(asked: DataFrame, offered: DataFrame, most: int, bandwidth_k: int) -> DataFrame:
    """``qlat, qlon, span, far, n``: distance to neighbour ``bandwidth_k`` (self is 0) or to the last there is, to the last of ``most``, and how many there are."""
    def spans(asked: pa.Table, offered: pa.Table) -> pa.Table:
        lat, lon, _ = unstacked(offered, "points")
        out = [(row, d[: bandwidth_k + 1].max(), d.max(), len(d)) for row, _, d in nearest_of(asked, lat, lon, most)]
        rows, span, far, n = zip(*out) if out else ((), (), (), ())
        rows = pa.array(rows, pa.int64())
        return pa.table({"qlat": asked["qlat"].take(rows), "qlon": asked["qlon"].take(rows), "span": pa.array(span, pa.float64()), "far": pa.array(far, pa.float64()), "n": pa.array(n, pa.int64())})

    return blocks.meet(asked, offered, spans, f"{_places_schema(asked)}, span double, far double, n long")


def _places_schema(asked: DataFrame) -> str:
    return ", ".join(f"{x} {asked.schema[x].dataType.simpleString()}" for x in ("qlat", "qlon"))


def _stacks(tree: quadtree.Tree, areas: DataFrame, key: str, values: DataFrame, most: int) -> DataFrame:
    """The places of ``tree`` with their ``stacked`` areas, which carry the columns of ``values`` (one row a key)."""
    more = [x for x in values.columns if x != key]
    own = areas.select(key, "lat", "lon").join(values, key)
    return tree.placed.select(*blocks.CELL, "lat", "lon").join(stacked(own, key, most, more), ["lat", "lon"])


def adaptive_access(areas: DataFrame, key: str, supplies: list[str], demand: str, neighbours: int,
                    bandwidth_k: int = BANDWIDTH_K) -> DataFrame:
    """Variable-bandwidth access per 1,000 among the ``neighbours`` nearest areas; ``kernel_access`` has no such bound.

    Bandwidth = distance to neighbour ``bandwidth_k`` (self is 0). With fewer areas than that, the farthest known
    neighbour sets it. Only ``neighbours`` areas are
    weighed; ``cut`` says where the last of them is nearer than three bandwidths, so that weight beyond it is
    missing. An area without coordinates has null access. The neighbours are found anew for bandwidth, pooling and
    access, block by block, and summed where they are found: no edge is written.
    """
    places = places_of(areas)
    tree = quadtree.grow(stacked(areas, key, neighbours), blocks.OFFERED)
    asked, halo = blocks.asking(places, tree, neighbours)
    asked = stage(asked, "adaptive-asked")
    schema = _places_schema(asked)
    own = stage(_bandwidth(_spans(asked, blocks.around(tree.placed, halo), neighbours, bandwidth_k), areas, key), "bandwidths")

    def pools(asked: pa.Table, offered: pa.Table) -> pa.Table:
        lat, lon, points = unstacked(offered, "points")
        dem, sigma = (points.field(x).to_numpy(zero_copy_only=False) for x in ("dem", "sigma"))
        found = [(row, (dem[at] * np.exp(-0.5 * (d / sigma[at]) ** 2)).sum()) for row, at, d in nearest_of(asked, lat, lon, neighbours)]
        rows = pa.array([x[0] for x in found], pa.int64())
        return pa.table({"qlat": asked["qlat"].take(rows), "qlon": asked["qlon"].take(rows), "pool": pa.array([x[1] for x in found], pa.float64())})

    totals = areas.groupBy(key).agg(F.coalesce(F.sum(F.col(demand).cast("double")), F.lit(0.0)).alias("dem"), *[F.sum(F.coalesce(F.col(s), F.lit(0))).cast("double").alias(f"__s{i}") for i, s in enumerate(supplies)])
    totals = stage(totals.join(own.select(key, "sigma"), key), "adaptive-totals")
    demands = _stacks(tree, areas, key, totals.select(key, "dem", "sigma"), neighbours)
    pooled = blocks.meet(asked, blocks.around(demands, halo), pools, f"{schema}, pool double")
    at = areas.select(key, F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).join(own.select(key, "sigma"), key)
    pooled = at.join(pooled, ["qlat", "qlon"]).groupBy(key).agg(F.sum("pool").alias("__pool"))
    ratio = [F.when(F.col("__pool") > 0, F.col(f"__s{i}") / F.col("__pool")).otherwise(0.0).alias(f"__s{i}") for i in range(len(supplies))]
    rated = _stacks(tree, areas, key, stage(totals.join(pooled, key).select(key, *ratio), "adaptive-ratios"), neighbours)

    def sums(asked: pa.Table, offered: pa.Table) -> pa.Table:
        lat, lon, points = unstacked(offered, "points")
        ratios = np.stack([points.field(f"__s{i}").to_numpy(zero_copy_only=False) for i in range(len(supplies))], 1)
        sigma, out = floats(asked, "sigma"), np.zeros((asked.num_rows, len(supplies)))
        for row, at, d in nearest_of(asked, lat, lon, neighbours):
            out[row] = np.exp(-0.5 * (d / sigma[row]) ** 2) @ ratios[at]
        return pa.table({"qlat": asked["qlat"], "qlon": asked["qlon"], "sigma": asked["sigma"], **{f"__s{i}": out[:, i] for i in range(len(supplies))}})

    spread = asked.join(at.select("qlat", "qlon", "sigma").distinct(), ["qlat", "qlon"])
    access = blocks.meet(spread, blocks.around(rated, halo), sums, f"{schema}, sigma double, " + ", ".join(f"__s{i} double" for i in range(len(supplies))))
    access = at.join(access, ["qlat", "qlon", "sigma"]).groupBy(key).agg(*[(F.sum(f"__s{i}") * 1000.0).alias(s) for i, s in enumerate(supplies)])
    last = own.select(key, ((F.col("__n") >= neighbours) & (F.col("__far") < 3 * F.col("sigma"))).alias("cut"))
    return areas.select(key).join(access.join(last, key), key, "left")


def _pooled_block(asked: pa.Table, offered: pa.Table) -> pa.Table:
    dem, sigma, pool, space = floats(asked, "dem"), floats(asked, "sigma"), np.zeros(offered.num_rows), room(asked, offered)
    for rows, cols, h, inside in reached(asked, offered):
        pool[cols] += weighed(dem[rows], decay(h, sigma[rows][:, None], inside, space))
    return pa.table({"lat": offered["lat"], "lon": offered["lon"], "pool": pool})


def _floating(spots: DataFrame, supplies: list[str]) -> DataFrame:
    """``lat, lon`` and access: two passes over the pairs of places at most ``reach`` of the demand's place apart.

    ``spots``: one row a place with ``dem``, ``sigma``, ``reach`` and the supplies. Places meet in pairs of blocks and are
    summed where they meet, once by the place of supply, once by that of demand; their pairs are never written.
    """
    def summed(asked: pa.Table, offered: pa.Table) -> pa.Table:
        sigma, out, space = floats(asked, "sigma"), np.zeros((asked.num_rows, len(supplies))), room(asked, offered)
        ratios = [floats(offered, s) for s in supplies]
        for rows, cols, h, inside in reached(asked, offered):
            weight = decay(h, sigma[rows][:, None], inside, space).T
            for i, ratio in enumerate(ratios):
                out[rows, i] += weighed(ratio[cols], weight)
        return pa.table({"lat": asked["qlat"], "lon": asked["qlon"], **{s: out[:, i] for i, s in enumerate(supplies)}})

    tree = quadtree.grow(spots.withColumn("w", F.lit(1)), blocks.BLOCK)
    places = tree.placed.select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "dem", "sigma", F.col("reach").alias("qreach"), *blocks.CELL)
    pairs, _ = blocks.pairs_within(places, tree, tree)
    asked = blocks.asked_of(pairs, places)
    at = _places_schema(asked).replace("qlat", "lat").replace("qlon", "lon")
    pools = blocks.meet(asked, blocks.offered_of(pairs, tree.placed.select("lat", "lon", *blocks.CELL)), _pooled_block, f"{at}, pool double")
    pools = pools.groupBy("lat", "lon").agg(F.sum("pool").alias("__pool"))
    ratio = [F.when(F.col("__pool") > 0, F.col(s) / F.col("__pool")).otherwise(0.0).alias(s) for s in supplies]
    rated = stage(tree.placed.join(pools, ["lat", "lon"], "left").select("lat", "lon", *blocks.CELL, *ratio), "catchment-ratios")
    access = blocks.meet(asked, blocks.offered_of(pairs, rated), summed, f"{at}, " + ", ".join(f"`{s}` double" for s in supplies))
    return access.groupBy("lat", "lon").agg(*[F.sum(s).alias(s) for s in supplies])


def _spots(areas: DataFrame, supplies: list[str], demand: str, *more: Column) -> DataFrame:
    """Areas on one spot pooled: they share every weight."""
    known = areas.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.groupBy("lat", "lon").agg(
        *[F.sum(F.coalesce(F.col(s), F.lit(0))).cast("double").alias(s) for s in supplies],
        F.sum(F.coalesce(F.col(demand), F.lit(0))).cast("double").alias("dem"), *more)


def kernel_access(areas: DataFrame, key: str, supplies: list[str], demand: str, bandwidth_k: int = BANDWIDTH_K,
                  support: float = SUPPORT) -> DataFrame:
    """Variable-bandwidth access per 1,000 over all areas within ``support`` of the demand's own bandwidths, however many.

    The bandwidth is at most ``BANDWIDTH_MAX_KM``, so the reach is bounded by distance and not by a number of neighbours. An
    area without coordinates has null access.
    """
    tree = quadtree.grow(stacked(areas, key, bandwidth_k + 1), blocks.OFFERED)
    asked, halo = blocks.asking(places_of(areas), tree, bandwidth_k + 1)
    sigma = _bandwidth(_spans(asked, blocks.around(tree.placed, halo), bandwidth_k + 1, bandwidth_k), areas, key).select(key, "sigma")
    spots = _spots(areas.join(sigma, key, "left"), supplies, demand, F.max("sigma").alias("sigma")).withColumn("reach", F.col("sigma") * support)
    access = _floating(spots, supplies)
    joined = areas.select(key, "lat", "lon").join(access, ["lat", "lon"], "left")
    return joined.select(key, *[(F.col(s) * 1000.0).alias(s) for s in supplies])


def fixed_access(areas: DataFrame, key: str, supplies: list[str], demand: str,
                 radius_km: float = CATCHMENT_KM, sigma_km: float = DECAY_KM) -> DataFrame:
    """Fixed-radius access. An area without coordinates has null access."""
    spots = _spots(areas, supplies, demand).withColumn("sigma", F.lit(float(sigma_km))).withColumn("reach", F.lit(float(radius_km)))
    return areas.select(key, "lat", "lon").join(_floating(spots, supplies), ["lat", "lon"], "left").select(key, *supplies)


def shortage(access: DataFrame, areas: DataFrame, key: str, supply: str, demand: str) -> DataFrame:
    """People per provider (null where none is reachable) and the shortage flag, which counts those areas."""
    ratio = F.when(F.col(supply) > 0, 1.0 / F.col(supply))
    joined = areas.select(key, demand).join(access.select(key, supply), key, "left")
    flag = (F.coalesce(F.col(demand), F.lit(0)) > 0) & F.coalesce(ratio > SHORTAGE_RATIO, F.lit(True))
    return joined.select(key, ratio.alias("people_per_provider"), flag.alias("shortage"))
