"""Every core query against its SQL on the smallest data, and invariants."""

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from guichet.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, data, db, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = db.execute(catalogue.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0


def test_no_cross_joins(spark, data):
    """No query multiplies two tables; joins of single rows aside."""
    for name in ("flow_balance_clamped", "assignment_by_category", "duplicates_jw", "top_keywords_by_group"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, data):
    plan = catalogue.QUERIES["ticket_detail"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id" in plan


def test_columns_are_pruned(spark, data):
    plan = catalogue.QUERIES["stock_totals"](spark, data)._jdf.queryExecution().toString()
    assert "suivis_description" not in plan.split("== Physical Plan ==")[1]
