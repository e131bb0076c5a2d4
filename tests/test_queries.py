"""Registered queries against their SQL: all of them on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
QUERIES, SQL = entry._merged("QUERIES"), entry._merged("SQL")
# one treated state, or enough rows per cell, are missing in the smallest tables
TOO_SMALL = {"triple_diff", "loso_cv"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - TOO_SMALL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df.collect(), df.columns, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(TOO_SMALL))
def test_query_matches_sql_on_larger_tables(spark, name):
    df = QUERIES[name](spark, LARGER)
    assert compare(df.collect(), df.columns, connect(LARGER), SQL[name]) is None


def test_every_query_is_named_once_and_has_sql_or_a_reason():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"att_gt_dr", "att_dr_bootstrap", "band_gate_calibration"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 50
