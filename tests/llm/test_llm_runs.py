"""Periodic runs against a search over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SCHEMA, shuffled, text
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonometry.llm import common as C
from zonometry.llm import queries, runs

SF = "/root/testdata/sf0.001"


def all_runs(w: list, least: int = 12) -> list[tuple]:
    """(start, length, period) by trying every distance."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def quick(w: list[int]) -> list[tuple]:
    s, e, q = runs.find_runs(C.mix(np.array(w, np.uint64) + np.uint64(5)))
    return list(zip(s.tolist(), (e - s).tolist(), q.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 5), st.integers(0, 3)), max_size=8))
def test_runs_of_repeated_stretches(parts):
    w = []
    for unit, times, cut in parts:
        w += unit * times
        w = w[: len(w) - cut]
    assert quick(w) == all_runs(w)


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 64, 500])
def test_runs_of_one_word_two_words_and_fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for w in ([7] * n, [i % 2 for i in range(n)], b[:n], list(range(n))):
        assert quick(w) == all_runs(w)


def test_long_texts_take_no_square_of_time():
    assert quick([3] * 400_000) == [(0, 400_000, 1)]


def words(t) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def collapsed(w: list[str], found: list[tuple]) -> str:
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_operator_on_edge_rows(spark, edges):
    """Null ids and texts, empty, blank, long and repeated texts; extra columns pass through."""
    got = runs.periodic_runs(shuffled(edges)).collect()
    assert len(got) == edges.count()
    for r in got:
        w = words(r.text)
        assert r.n_words == len(w)
        if len(w) < 5000:
            assert [tuple(x) for x in r.runs] == all_runs(w)
            assert r.collapsed == collapsed(w, all_runs(w))
    assert got[0].__fields__ == [*edges.columns, "n_words", "runs", "collapsed"]


def test_empty_table_and_refused_names(spark, nothing):
    assert runs.periodic_runs(nothing).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(nothing.withColumn("Runs", F.lit(1)))


def check_query(found, rows) -> None:
    got = {r.doc_id: r for r in found}
    assert len(got) == len(rows)
    for doc_id, t in rows:
        w = words(t)
        n = len(w)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        own = all_runs(w)
        r = got[doc_id]
        assert r.n_runs == len(own)
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in own).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, own).encode()).hexdigest()


def test_query_against_every_period(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    small = [r for r in rows if len(words(r[1])) < 1200]
    got = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(got) == len(rows) > len(small) > 100
    keep = {i for i, _ in small}
    check_query([r for r in got if r.doc_id in keep], small)


def test_query_on_planted_runs(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(text(i, r.randint(1, 60)).split() + ["again", "and"] * r.randint(0, 9) + text(i, r.randint(1, 60)).split() * r.randint(1, 3))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "a " * 700), (None, "b c " * 40)]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check_query(queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect(), rows)
