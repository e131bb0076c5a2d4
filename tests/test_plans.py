"""Plan shapes that matter at scale, and the band calibration resample."""

import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import roles as R
from zonometry import session
from zonometry.operators import aggregates, rank, resample, serve, stats
from zonometry.plans import uncertainty as unc
from zonometry.sources import tabular

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parquet_scan_reads_two_columns(spark):
    text = plan(tabular.read_parquet(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "l_quantity"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_filters_reach_the_scans(spark, tmp_path):
    R.table(spark, SF, "customer").write.option("header", "true").csv(str(tmp_path / "c"))
    names = R.table(spark, SF, "customer").columns
    csv = plan(tabular.read_text_csv(spark, str(tmp_path / "c"), names, ["c_custkey"], F.col("c_mktsegment") == "BUILDING"))
    pushed = re.search(r"PushedFilters: \[([^]]*)\]", csv).group(1)
    assert "IsNotNull(c_mktsegment)" in pushed and "EqualTo(c_mktsegment,BUILDING)" in pushed
    # the corrupt-record column comes along, as a record is malformed by all of its fields
    assert "ReadSchema: struct<c_custkey:string,c_mktsegment:string,__corrupt:string>" in csv


def test_stage_tables_of_a_scratch_block_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with session.scratch(spark):
        a = session.stage(spark.range(5), "a")
        with session.scratch(spark):
            session.stage(a, "inner")
            up = session.stage(a, "up", keep=True)
        assert up.count() == 5 and len(list((tmp_path / "stages").iterdir())) == 2
        last = session.stage(up, "last", keep=True)
    assert [p.name.split("-")[0] for p in (tmp_path / "stages").iterdir()] == ["last"] and last.count() == 5
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.stage(spark.range(1), "b")
        raise ZeroDivisionError
    assert len(list((tmp_path / "stages").iterdir())) == 1


@pytest.mark.parametrize("lost", ["zonometry.llm.queries", "corpus_pipeline"])
def test_other_queries_survive_a_missing_text_part(monkeypatch, lost):
    """A module that cannot be imported (its folder or a library is missing) takes only its own queries along."""
    monkeypatch.setitem(sys.modules, lost, None)
    names = set(entry.queries())
    assert set(entry._merged("QUERIES")) <= names and "pipeline" not in names
    assert set(entry.oracle_sql()) <= names
    if lost == "zonometry.llm.queries":
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_top_k_keeps_only_k_rows_per_task(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("score"), F.lit(True).alias("scoreable"),
                                  F.lit(False).alias("institutional"), F.lit(False).alias("low_confidence"), F.lit(3).alias("n_dims_scored"))
    assert "TakeOrderedAndProject" in plan(serve.rankings(df, "score", "k", [], {"score"}, 10))


@pytest.mark.parametrize("build", [
    lambda d: rank.with_percentile(d, "v", "p", ["g"]),
    lambda d: rank.exact_quantiles(d, "v", [0.5], ["g"]),
    lambda d: aggregates.subtract_group_mean(d, "g", ["v"]),
    lambda d: aggregates.drop_duplicates_prefer(d, ["g"], [F.col("v")]),
    lambda d: stats.correlations(d, ["v"], ["w"], ["g"]),
])
def test_no_cartesian_product_and_no_python(spark, build):
    d = spark.range(100).select("id", (F.col("id") % 3).alias("g"), F.rand(1).alias("v"), F.rand(2).alias("w"))
    text = plan(build(d))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text and "InPandas" not in text


def test_group_means_use_a_combine_not_a_window(spark):
    d = spark.range(100).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    text = plan(aggregates.subtract_group_mean(d, "g", ["v"]))
    assert "Window" not in text and "partial_avg" in text


def test_block_sums_come_before_replication(spark):
    """Rows x replicates never exist: the replicate join reads one row per block."""
    d = spark.range(5000).select((F.col("id") % 7).cast("string").alias("block"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    g = resample.bootstrap_grams(d, ["x", "y"], "block", 20, 1)
    assert g.count() == 21
    assert {r.n for r in g.where("replicate = -1").collect()} == {5000.0}


def test_resampled_sd_follows_the_standard_error(spark):
    n = 400
    v = (np.arange(n) + 0.5) / n
    members = spark.createDataFrame([("m", float(x)) for x in v], "item string, value double")
    flat = [("s", float(x * 100)) for x in v]
    sub = spark.createDataFrame(flat, "subscore string, raw double")
    dim = spark.createDataFrame([("d", x) for _, x in flat], "dim string, raw double")
    rows = [(f"a{i}", "m", "s", "d", float(v[i] * 100), float(v[i]), 0.05 if i % 2 else None) for i in range(100, 300, 5)]
    samples = spark.createDataFrame(rows, "area string, item string, subscore string, dim string, base double, value double, se double")
    out = {r.area: r.sd for r in unc.resample_sd(samples, members, sub, dim, "area", 200, 3).collect()}
    moved = [sd for a, sd in out.items() if int(a[1:]) % 2]
    assert np.median(moved) == pytest.approx(5.0, rel=0.1)
    assert all(sd == 0 for a, sd in out.items() if int(a[1:]) % 2 == 0)


def test_calibration_gate_reads_the_median_ratio(spark):
    sds = spark.createDataFrame([(f"a{i}", "d", 5.0) for i in range(30)], "area string, dim string, sd double")
    sig = spark.createDataFrame([(f"a{i}", "d", 5.5 if i else 0.5) for i in range(30)], "area string, dim string, sigma double")
    row = unc.calibration_gate(sds, sig, "area").first()
    assert (row.n, round(row.ratio, 6), row.ok) == (29, 1.1, True)
