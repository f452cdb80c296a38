"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import pages, sql_queries, values

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
ALL_QUERIES, ALL_ORACLES = (values.QUERIES | pages.QUERIES | sql_queries.QUERIES, values.ORACLES | pages.ORACLES | sql_queries.ORACLES)
CHOSEN = sorted(ALL_ORACLES)

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    got = ALL_QUERIES[name](spark, SF)
    found = con.execute(ALL_ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_every_oracle_has_a_query():
    assert not set(ALL_ORACLES) - set(ALL_QUERIES)


def test_rectangles_are_joined_without_a_broadcast(spark, monkeypatch):
    """Marked elements and their boxes grow with the pages: neither the tables on the way nor the result sends one to the driver."""
    plans, keep = [], pages.by_page
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(pages, "by_page", lambda df, name: told(df) or keep(df, name))
    told(pages.union_rect(spark, SF))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert not any("MapInArrow" in p for p in plans[1:])  # pages are parsed once
