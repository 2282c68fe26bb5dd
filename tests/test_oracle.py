"""Every dashboard query against its DuckDB oracle on the sf0.001 tables: the rows,
and their order where the query has one."""

import pytest
from fixtures import SF_SMALL

import __spark_entry__ as entry
from tools.compare import canon, duck, in_order

QUERIES = entry.dashboard_queries()
ORACLE = entry.dashboard_oracle()
# Queries whose row order is part of the answer.
ORDERED = sorted(
    n for n in QUERIES
    if n.removeprefix("rollup_").removeprefix("page_").removeprefix("view_").startswith(
        ("monthly", "weekday", "hour_of_day", "speed_histogram", "hotspot", "map_points")
    )
)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dk = con.execute(ORACLE[name]).fetchdf()
    assert canon(sp) == canon(dk)
    if name in ORDERED:
        assert in_order(sp) == in_order(dk)


def test_ordered_queries_are_named():
    assert {"hotspots", "map_points", "monthly_trend", "weekday_hour_matrix", "page_hotspots", "view_hotspots_after_removal"} <= set(ORDERED)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["GEOHASH", "lat", "lon", "messungen", "avg_speed", "stau_pct"]
    assert df.count() == 12
