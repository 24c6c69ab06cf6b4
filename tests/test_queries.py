"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import registered

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
NAMES = list(registered.QUERIES)
STREAMS = {n for n in NAMES if n.startswith("stream_")}
# A global order and a single total need one task for their last, small step.
ONE_TASK = {"deterministic_order"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def _sorted(found):
    return sorted(found, key=lambda r: [f"{x:.4f}" if isinstance(x, float) else str(x) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    if name not in STREAMS:
        _check_plan(name, df)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    place = [list(rel.columns).index(c) for c in columns]
    theirs = [tuple(r[i] for i in place) for r in rel.fetchall()]
    assert len(mine) == len(theirs)
    for x, y in zip(_sorted(mine), _sorted(theirs)):
        assert all(_same(a, b) for a, b in zip(x, y)), (x, y)


def _check_plan(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    # A window without a partition key would pull every row into one task.
    for spec in re.findall(r"Window \[.*?\], (.*)", plan):
        assert not spec.startswith("[") or "ASC" not in spec.split("]")[0], spec
    if name not in ONE_TASK:
        sorts = re.findall(r"Exchange SinglePartition", plan)
        windows = re.findall(r"windowspecdefinition\((?![^()]*#)", plan)
        assert not windows, "window without partition"
        assert len(sorts) <= plan.count("HashAggregate") + plan.count("ObjectHashAggregate") + plan.count("SortAggregate")


def test_flagship_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 1 and got[0]["level"] in ("NORMAL", "WATCH", "ELEVATED", "STRESS")


def test_scans_prune_columns_and_push_filters(spark):
    from seriesloom.operators import clean

    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderpriority AS series_id", "o_orderdate AS obs_date")
    plan = clean.asof_cutoff(rows, "1996-01-01")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<o_orderdate:\w+,o_orderpriority:string>", plan)
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan
