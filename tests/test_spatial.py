"""Grid joins against brute force: date line, poles, piles of copies, dense next to empty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonometry.operators import catchment, quadtree, spatial

R_KM = 6371.0


def dist(a, b):
    la, lb = np.radians(a[:, None, 0]), np.radians(b[None, :, 0])
    dl = np.radians(b[None, :, 1] - a[:, None, 1])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(dl / 2) ** 2
    return 2 * R_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def world(n, seed):
    rng = np.random.default_rng(seed)
    spread = np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)])
    city = np.column_stack([rng.normal(40.7, 0.02, n), rng.normal(-74.0, 0.02, n)])
    line = np.column_stack([rng.normal(-17, 1, n // 2), (rng.normal(180, 1, n // 2) + 180) % 360 - 180])
    pole = np.column_stack([rng.uniform(88, 90, n // 4), rng.uniform(-180, 180, n // 4)])
    pile = np.tile([[40.7, -74.0]], (n, 1))  # about a third of all points on one spot
    return np.round(np.vstack([spread, city, line, pole, pile]), 6)


def load(spark, pts, name):
    return spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], f"{name} int, lat double, lon double")


@pytest.mark.parametrize("k", [1, 7, 40])
def test_knn_is_exact(spark, k):
    pts, qs = world(120, 1), world(60, 2)
    got = {}
    for r in spatial.knn_join(load(spark, qs, "q"), load(spark, pts, "p"), "q", "p", k).collect():
        got.setdefault(r.q, []).append((r.idx, r.p, r.d))
    d = dist(qs, pts)
    assert len(got) == len(qs)
    for i in range(len(qs)):
        rows = sorted(got[i])
        want = np.sort(d[i])[:k]
        np.testing.assert_allclose([x[2] for x in rows], want, atol=1e-6)
        assert [x[0] for x in rows] == list(range(k))


def test_knn_returns_all_points_when_fewer_than_k(spark):
    pts = world(2, 5)
    out = spatial.knn_join(load(spark, pts, "q"), load(spark, pts, "p"), "q", "p", 100)
    assert out.count() == len(pts) ** 2


def test_radius_join_and_counts(spark):
    a, b = world(50, 3), world(50, 4)
    d = dist(a, b)
    want = {(i, j) for i, j in zip(*np.where(d <= 120.0))}
    sa, sb = load(spark, a, "i"), load(spark, b, "j")
    assert {(r.i, r.j) for r in spatial.radius_join(sa, sb, "i", "j", 120.0).collect()} == want
    counts = {r.i: r.n for r in spatial.radius_counts(sa, sb, "i", 120.0, "n").collect()}
    assert counts == {i: int((d[i] <= 120.0).sum()) for i in range(len(a))}


def test_nearest_centroid_is_planar(spark):
    a, q = world(60, 6), world(40, 7)
    d = (q[:, None, 0] - a[None, :, 0]) ** 2 + (q[:, None, 1] - a[None, :, 1]) ** 2
    for r in spatial.nearest_centroid(load(spark, q, "q"), load(spark, a, "area"), "q", "area").collect():
        assert r.dist2 == pytest.approx(d[r.q].min(), abs=1e-12)


def test_two_step_by_hand(spark):
    areas = spark.createDataFrame([("a", 10.0, 50.0), ("b", 0.0, 50.0)], "k string, s double, pop double")
    edges = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0), ("b", "a", 0.5)], "k string, j string, w double")
    out = {r.k: r.s for r in catchment.two_step(edges, areas, "k", ["s"], "pop", "j", F.col("w"), F.col("w")).collect()}
    assert out["a"] == pytest.approx(10 / 75) and out["b"] == pytest.approx(10 / 75 / 2)


def test_zero_demand_gives_zero_access(spark):
    areas = spark.createDataFrame([("a", 10.0, 0.0)], "k string, s double, pop double")
    edges = spark.createDataFrame([("a", "a", 1.0)], "k string, j string, w double")
    assert catchment.two_step(edges, areas, "k", ["s"], "pop", "j", F.col("w"), F.col("w")).first().s == 0.0


def test_unreachable_populated_area_is_a_shortage(spark):
    areas = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("c", 9.0)], "k string, pop double")
    acc = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1 / 3000)], "k string, s double")
    out = {r.k: (r.people_per_provider, r.shortage) for r in catchment.shortage(acc, areas, "k", "s", "pop").collect()}
    assert out["a"] == (None, True) and out["b"] == (None, False) and out["c"][1] is False


def test_areas_without_coordinates_stay_and_the_neighbour_cut_shows(spark):
    from zonometry.operators import catchment

    rows = [(f"a{i}", 40.0 + 0.001 * i, -75.0, 100.0, 2.0) for i in range(60)] + [("lost", None, None, 5.0, 1.0)]
    areas = spark.createDataFrame(rows, "area string, lat double, lon double, pop double, sites double")
    wide = {r.area: r for r in catchment.adaptive_access(areas, "area", ["sites"], "pop", neighbours=61).collect()}
    few = {r.area: r for r in catchment.adaptive_access(areas, "area", ["sites"], "pop", neighbours=40).collect()}
    fixed = {r.area: r for r in catchment.fixed_access(areas, "area", ["sites"], "pop").collect()}
    assert len(wide) == len(few) == len(fixed) == 61 and wide["lost"].sites is None and fixed["lost"].sites is None
    assert not wide["a5"].cut and few["a5"].cut and wide["a5"].sites > 0


def crowd(n=20_000, seed=9):
    """Nine tenths of the points within a kilometre; queries there, and a thousand kilometres away."""
    rng = np.random.default_rng(seed)
    pts = np.round(np.vstack([np.column_stack([rng.normal(40, 0.004, n * 9 // 10), rng.normal(-75, 0.004, n * 9 // 10)]), np.column_stack([rng.uniform(30, 50, n // 10), rng.uniform(-90, -60, n // 10)])]), 6)
    far = np.column_stack([rng.uniform(48, 50, 150), rng.uniform(-88, -86, 150)])
    return pts, np.round(np.vstack([far, pts[:150]]), 6)


def test_no_leaf_is_larger_than_stated_and_every_point_has_one(spark):
    pts, _ = crowd()
    tree = quadtree.grow(load(spark, pts, "p").select("lat", "lon").distinct().withColumn("w", F.lit(1)))
    sizes = [r["count"] for r in tree.placed.groupBy("lv", "r", "c").count().collect()]
    assert max(sizes) <= quadtree.LEAF and sum(sizes) == len(np.unique(pts, axis=0)) and len(tree.tops) <= quadtree.TOPS
    top = tree.nodes.where("leaf").agg(F.sum("n"), F.sum("w")).first()
    assert top[0] == top[1] == sum(sizes)


def test_far_queries_read_few_leaves_of_a_crowd(spark):
    """The work of a query follows from k, not from how many points lie in its direction."""
    pts, qs = crowd()
    tree = quadtree.grow(load(spark, pts, "p").select("lat", "lon").distinct().withColumn("w", F.lit(1)))
    at = load(spark, qs, "q").select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).distinct()
    read = quadtree.nearest(at, tree, 10).groupBy("qlat", "qlon").count().agg(F.max("count"), F.avg("count")).first()
    assert read[0] <= 40 and read[1] <= 12
    got = {}
    for r in spatial.knn_join(load(spark, qs, "q"), load(spark, pts, "p"), "q", "p", 10).collect():
        got.setdefault(r.q, []).append(r.d)
    d = np.sort(dist(qs, pts), 1)[:, :10]
    np.testing.assert_allclose(np.sort(np.array([got[i] for i in range(len(qs))]), 1), d, atol=1e-6)


def test_counting_in_a_crowd_compares_only_its_rim(spark):
    pts, qs = crowd()
    tree = quadtree.grow(load(spark, pts, "p").select("lat", "lon").distinct().withColumn("w", F.lit(1)))
    at = load(spark, qs, "q").select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).distinct()
    inside, rim = quadtree.within(at, tree, 25.0, pairs=False)
    compared = rim.join(tree.placed, ["lv", "r", "c"]).count()
    near = int((dist(qs, pts) <= 25.0).sum())
    assert compared < near / 50 and inside.agg(F.sum("w")).first()[0] > 0.9 * near
    counts = {r.q: r.n for r in spatial.radius_counts(load(spark, qs, "q"), load(spark, pts, "p"), "q", 25.0, "n").collect()}
    assert counts == {i: int(x) for i, x in enumerate((dist(qs, pts) <= 25.0).sum(1))}


def test_queries_without_coordinates_or_points_come_back_with_nulls(spark):
    qs = spark.createDataFrame([(1, 40.0, -75.0), (2, None, -75.0), (3, None, None), (4, float("nan"), 1.0)], "q int, lat double, lon double")
    pts = spark.createDataFrame([(7, 40.1, -75.0), (8, None, 1.0)], "p int, lat double, lon double")
    got = {r.q: (r.p, r.idx) for r in spatial.knn_join(qs, pts, "q", "p", 3).collect()}
    assert got == {1: (7, 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert {r.q: r.p for r in spatial.nearest_centroid(qs, pts, "q", "p").collect()} == {1: 7, 2: None, 3: None, 4: None}
    assert {r.q: (r.sites_reachable, r.nearest_km) for r in spatial.proximity(qs, pts, "q", "p", 50.0).collect()}[2] == (0, None)
    assert {r.q: r.p for r in spatial.knn_join(qs, pts.limit(0), "q", "p", 3).collect()} == dict.fromkeys([1, 2, 3, 4])


def test_far_controls_are_settled_by_whole_cells(spark):
    pts, qs = crowd(4000)
    treated, controls = load(spark, pts, "u"), load(spark, qs, "u")
    near = (dist(qs, pts) <= 10.0).any(1)
    assert {r.u for r in spatial.far_controls(treated, controls, "u", 10.0).collect()} == set(np.flatnonzero(~near).tolist())


def test_kernel_access_matches_all_pairs_and_the_neighbour_rule(spark):
    rng = np.random.default_rng(3)
    n = 150
    pts = np.round(np.vstack([np.column_stack([rng.normal(40, 0.2, n), rng.normal(-75, 0.2, n)]), np.tile([[40.0, -75.0]], (20, 1))]), 6)
    pop, sup = rng.uniform(0, 100, len(pts)).round(3), rng.integers(0, 5, len(pts)).astype(float)
    rows = [(f"a{i:03d}", *map(float, p), float(pop[i]), float(sup[i])) for i, p in enumerate(pts)] + [("lost", None, None, 5.0, 1.0)]
    areas = spark.createDataFrame(rows, "area string, lat double, lon double, pop double, sites double")
    d = dist(pts, pts)
    sigma = np.clip(np.sort(d, 1)[:, 30], 8, 60)
    w = np.where(d <= 3 * sigma[:, None], np.exp(-0.5 * (d / sigma[:, None]) ** 2), 0)  # demand i, supply j
    pool = pop @ w
    want = w @ np.divide(sup, pool, out=np.zeros(len(pts)), where=pool > 0) * 1000
    got = {r.area: r.sites for r in catchment.kernel_access(areas, "area", ["sites"], "pop").collect()}
    assert got.pop("lost") is None
    np.testing.assert_allclose([got[f"a{i:03d}"] for i in range(len(pts))], want, rtol=1e-9)
    # with a support that reaches everything it is the rule of the nearest neighbours with all of them
    all_of = {r.area: r.sites for r in catchment.adaptive_access(areas, "area", ["sites"], "pop", neighbours=len(pts)).collect()}
    far = {r.area: r.sites for r in catchment.kernel_access(areas, "area", ["sites"], "pop", support=1e4).collect()}
    assert all_of["lost"] is None and all(far[a] == pytest.approx(v, rel=1e-9) for a, v in all_of.items() if v is not None)
