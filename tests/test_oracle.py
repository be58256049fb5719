"""Every registered query equals its DuckDB SQL (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, fingerprint

from conftest import SF001

NAMES = sorted(E.suite.SUITE)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.queries()) and set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    s = fingerprint(df.columns, [tuple(r) for r in df.collect()])
    assert s[1] > 0, name
    rel = con.sql(E.oracle_sql()[name])
    d = fingerprint(rel.columns, rel.fetchall())
    assert s[:3] == d[:3], (name, s[:3], d[:3])


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"sfbr_id", "next_mount_id", "wait_us", "age_months", "age_days", "age_us"} <= set(df.columns)
