"""Vector operators against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonometry.llm import codebooks, hnsw, queries

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("note", T.StringType()),
])
NAN, INF = float("nan"), float("inf")


def clustered(seed: int, n: int, width: int = 16, spread: float = 0.05, centres: int = 5) -> list[tuple]:
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    x = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, width))
    return [(i, x[i].astype(np.float32).tolist(), int(i % 3) if i % 7 else None, "n") for i in range(n)]


def odd_rows(width: int = 16) -> list[tuple]:
    """Null, empty, short, zero and non-finite vectors, null and repeated ids, repeated rows."""
    one = [1.0] * width
    return [
        (900, None, 1, None), (901, [], 1, None), (902, [1.0] * (width - 1), 1, None), (903, [None] + one[1:], 1, None), (904, [NAN] + one[1:], 1, None),
        (905, [INF] + one[1:], None, None), (906, [0.0] * width, 2, None), (907, one, 2, None), (908, one, None, None), (908, one, None, None), (909, one, 0, None),
        (None, one, 0, None), (None, None, 0, None), (907, [2.0] + one[1:], 2, None), (910, [1.0] * (2 * width), 2, None),
    ]


def table(spark, rows, path=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(1))
    if path:
        df.write.parquet(f"{path}/embeddings.parquet")
    return df


# --- vector codes


def lloyd(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6):
    """(ids in order, labels, codes, errors, codebooks) in plain integers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    order = [r for r in order if len(r[1]) and len(r[1]) % parts == 0]
    order = [r for r in order if len(r[1]) == len(order[0][1])]
    x = [[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in order]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        told = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if told[i][p] == e]
                if own:
                    books[p][e] = [sum(s) // len(own) for s in zip(*own)]
    last = [[nearest(c[p], p) for p in range(parts)] for c in cut]
    return order, ["".join(f"{e:02x}" for _, e in r) for r in last], [sum(d for d, _ in r) for r in last], books


@pytest.mark.parametrize("rows", [clustered(1, 300), clustered(2, 90, spread=1.0), clustered(3, 60, 8) + odd_rows(8), odd_rows(), clustered(4, 7), clustered(5, 400, 24, 0.0)], ids=["clusters", "noise", "odd", "few", "seven", "ties"])
def test_codes_match_plain_lloyd(spark, tmp_path, rows):
    order, code, error, books = lloyd(rows)
    table(spark, rows, tmp_path)
    got = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    by_label = {}
    for r, e in zip(order, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    want = sorted((r[0] is None, r[0] or 0, c, e, by_label[r[2]], sha) for r, c, e in zip(order, code, error))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_codes_of_the_table_match_plain_lloyd(spark):
    rows = [tuple(r) + (None,) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    order, code, error, _ = lloyd(rows)
    got = {r.vec_id: (r.code, r.error) for r in queries.QUERIES["op12_vector_codes"](spark, SF).collect()}
    assert got == {r[0]: (c, e) for r, c, e in zip(order, code, error)}


@pytest.mark.parametrize("n, k, spread", [(1, 1, 1), (5, 16, 50), (500, 16, 3), (3000, 16, 400), (3000, 7, 0), (2000, 200, 30)])
def test_trees_assign_like_all_distances(n, k, spread):
    r = np.random.default_rng(n + k)
    points = r.integers(-1000, 1000, (k, 4))[r.integers(0, k, n)] + r.integers(-spread, spread + 1, (n, 4))
    entries = points[r.integers(0, n, k)]
    order, tree = codebooks.grow(points, codebooks.LEAF_ROWS)
    label, counts, sums = codebooks.assign(points[order], tree, entries)
    want = ((points[order][:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (label == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert (sums == np.stack([points[order][want == e].sum(0) for e in range(k)])).all()


def test_tight_groups_are_assigned_whole():
    """Boxes far from all entries but one never reach their points."""
    points = np.repeat(np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]]), 500, 0) + np.random.default_rng(1).integers(0, 9, (2000, 2))
    order, tree = codebooks.grow(points, codebooks.LEAF_ROWS)
    gone = np.full_like(points, 1 << 40)  # no leaf's integers are read
    label, counts, _ = codebooks.assign(gone, tree, points[::500].copy())
    assert counts.tolist() == [500] * 4 and (label == ((points[order][:, 0] > 5000) + 2 * (points[order][:, 1] > 5000))).all()


def test_codes_keep_extra_columns_and_refuse_names(spark):
    df = table(spark, clustered(1, 40) + odd_rows())
    got, books = codebooks.compress(df.withColumn("p", F.lit(1)), entries=4)
    assert got.columns == [*df.columns, "p", "code", "error"] and books.shape == (8, 4, 2)
    assert got.where("note = 'n'").count() == 40
    assert codebooks.compress(df.limit(0))[0].count() == 0
    with pytest.raises(ValueError, match="code"):
        codebooks.compress(df.withColumn("Code", F.lit(1)))
    with pytest.raises(Exception, match="beyond"):
        codebooks.compress(table(spark, [(1, [1e9] * 16, 0, None)]))


# --- near vectors


def groups_of_copies(seed: int, width: int = 32) -> list[tuple]:
    """Noise, pairs, a chain, and one large group of near copies; ids in random order."""
    r = np.random.default_rng(seed)
    x = [*r.normal(size=(700, width))]
    for size in [2] * 40 + [5, 30, 600]:
        base = r.normal(size=width)
        x += [base / np.linalg.norm(base) + 0.04 * r.normal(size=width) for _ in range(size)]
    a, b = np.eye(width)[0], np.eye(width)[1]
    x += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.3)]
    x += [x[0] * 3, x[0] * 1e30, x[1] * 1e-30]
    ids = r.permutation(len(x))
    return [(int(i), v.astype(np.float32).tolist(), 0, "n") for i, v in zip(ids, x)]


def all_pairs(rows: list[tuple], least: float = 0.9) -> list[tuple]:
    """(id, n_links, component, kept) of each row, from all cosines in double precision."""
    def usable(r):
        return r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    out, at = [None] * len(rows), {}
    for i, r in enumerate(rows):
        if usable(r):
            at.setdefault(len(r[1]), []).append(i)
        else:
            out[i] = (r[0], 0, r[0], True)
    for own in at.values():
        x = np.array([rows[i][1] for i in own], np.float32).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= least
        least_id = np.array([rows[i][0] for i in own])
        while True:
            new = np.array([least_id[n].min() for n in near])
            if (new == least_id).all():
                break
            least_id = new
        for i, n, c in zip(own, near.sum(1) - 1, least_id.tolist()):
            out[i] = (rows[i][0], int(n), c, rows[i][0] == c)
    return out


def by_row(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("rows", [groups_of_copies(1), odd_rows(), odd_rows() + clustered(6, 500, spread=0.03), clustered(7, 3)], ids=["groups", "odd", "dense", "few"])
def test_near_vectors_match_all_pairs(spark, tmp_path, rows):
    table(spark, rows, tmp_path)
    got = queries.QUERIES["op13_hnsw_near_dedup"](spark, str(tmp_path)).collect()
    assert by_row(tuple(r) for r in got) == by_row(all_pairs(rows))


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, 0, None) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    near = [(10_000 + r[0], (np.array(r[1]) + 0.04 * np.random.default_rng(r[0]).normal(size=64)).tolist(), 0, None) for r in rows[::2]]
    want = {r[0]: r for r in all_pairs(rows + near)}
    got = {r.vec_id: r for r in hnsw.near_vectors(table(spark, rows + near)).collect()}
    assert all(got[i].n_links <= w[1] for i, w in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(w[1] for w in want.values()) > 200


def test_near_vectors_of_repeated_rows_and_empty_tables(spark):
    rows = [(i % 3, [1.0, 0.5], 0, str(i)) for i in range(30)]
    df = table(spark, rows)
    got = hnsw.near_vectors(df.withColumn("w", F.lit(1)))
    assert got.columns == [*df.columns, "w", "n_links", "component_id", "kept"]
    assert {tuple(r) for r in got.select("n_links", "component_id").collect()} == {(29, 0)} and got.where("kept").count() == 10
    assert hnsw.near_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="kept"):
        hnsw.near_vectors(df.withColumn("KEPT", F.lit(1)))


def test_a_poor_graph_widens_its_beam():
    """With most of a graph's links taken away, the audit goes on until its probes find their links, by the whole shard if need be."""
    x = hnsw.unit(np.random.default_rng(1).normal(size=(600, 16)).ravel(), 16)
    level = np.sort(hnsw.levels(600))[::-1]
    graph = hnsw.build(x.astype(np.float32), level)
    good = hnsw.Shard(np.arange(600), np.ones(600, np.int64), x, graph.layers, 8)
    good.audit(0.9)
    cut = [lists.copy() for lists in graph.layers]
    cut[0][:, 2:] = -1
    poor = hnsw.Shard(np.arange(600), np.ones(600, np.int64), x, cut, 8)
    poor.audit(0.9)
    assert good.ef < poor.ef
    poor.group = np.arange(600)
    poor = hnsw.Shard.opened(poor.packed())
    row, group, links = poor.counts(hnsw.probes(x, 0.9), np.full(600, -1), None, 0.9)
    assert links.sum() >= 0.98 * (hnsw.probes(x, 0.9) @ x.T >= 0.9).sum()


@pytest.mark.parametrize("n", [1, 30, 300])
def test_settled_labels_are_components(n):
    r = random.Random(n)
    label, edges = np.arange(n), []
    for _ in range(5):  # links come in batches
        u, v = [np.array([r.randrange(n) for _ in range(n // 6)], np.int64) for _ in range(2)]
        label = hnsw.settled(n, u, v, label)
        edges += zip(u.tolist(), v.tolist())
        want = list(range(n))
        while any(want[a] != want[b] for a, b in edges):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert label.tolist() == want
