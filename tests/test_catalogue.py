"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessella import catalogue
from tessella.plans.actions import counted

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    expected = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.columns, df.collect()) == ordered(names, expected.fetchall())


@pytest.mark.parametrize("name", ["include_list", "include_nested", "include_contents", "include_through"])
def test_a_tree_of_includes_is_one_action(spark, name):
    with counted(spark) as some:
        df = catalogue.QUERIES[name](spark, SF)
    with counted(spark) as all_of_it:
        df.collect()
    assert (some.actions, all_of_it.actions) == (0, 1)


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "LeftSemi" in plan(spark, "rel_some")
    assert "LeftAnti" in plan(spark, "rel_none") and "LeftAnti" in plan(spark, "rel_every")
    assert "WindowGroupLimit" in plan(spark, "include_take")
    assert "TakeOrderedAndProject" in plan(spark, "order_limit")
    for name in ("upsert_update", "upsert_nothing"):
        assert "FullOuter" not in plan(spark, name) and "BroadcastHashJoin" in plan(spark, name)
    assert "Window" not in plan(spark, "include_one") and "Window" not in plan(spark, "include_list")
    through = plan(spark, "include_through")
    assert "LeftSemi" in through and "Window" not in through
    assert "LeftSemi" in plan(spark, "related_through")
    scan = plan(spark, "filter_range")
    assert "PushedFilters: [IsNotNull(o_totalprice)" in scan and "o_orderdate" not in scan
