"""Every catalogue query against DuckDB over the same tables: names, and rows as multisets."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from ridgeline.plans import catalogue, statements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    con = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in con.description]
    assert df.columns == names
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in con.fetchall())


@pytest.mark.parametrize("name", list(statements.QUERIES))
def test_statements_give_the_same_rows(spark, duck, name):
    df = statements.QUERIES[name](spark, SF)
    con = duck.execute(statements.SQL[name])
    assert df.columns == [d[0] for d in con.description]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in con.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["filter_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus), GreaterThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_comma_join_is_no_cartesian_product(spark):
    plan = catalogue.QUERIES["comma_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
