"""Every query with an oracle equals it on the smallest tables."""

import glob
import os
import re
from decimal import Decimal

import duckdb
import pytest

from mailgrain.plans import more_queries, round_three  # noqa: F401
from mailgrain.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else round(float(v), 5)
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE:
        return
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_pushed_filters(spark):
    plan = QUERIES["eq_list_window"](spark, SF)._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1].split(", ")  # in no fixed order
    assert {"IsNotNull(o_orderpriority)", "EqualTo(o_orderpriority,1-URGENT)"} <= set(pushed)
    assert "TakeOrderedAndProject" in plan
    assert "l_partkey" not in plan
