"""The SQL forms against the queries, over whole tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from ridgeline.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()[name](spark, small)
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
