"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from levelground import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{DATA}/orders.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES) if os.environ.get("ALL_QUERIES") else ["voxel_downsample", "seed_edge_filter", "sor_filter", "pca_classify", "patch_circularity", "hazard_all", "growth_ladder", "landing_zone_pipeline", "monte_carlo_summary", "overlapping_cells"])
def test_matches_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    listed = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert listed(df.select(*columns).collect()) == listed(expected.project(", ".join(columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
