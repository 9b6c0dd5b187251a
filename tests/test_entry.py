"""Every geometry query equals its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from draftwell.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    rows = lambda df: sorted([tuple("" if pd.isna(v) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)])
    assert rows(a) == rows(b)


def test_no_plan_is_too_large_to_compile(spark):
    """The walk's plan compiles; without the fallback a method that is too long would raise."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert catalog.QUERIES["world_edges"](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
