"""Every query against its SQL on DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quirewise.plans import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict(True).items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_plans_have_no_cartesian_product(spark, data):
    for name in ("overlap_light", "ref_consistency", "near_duplicate_documents", "citation_status"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalog.queries()["pricing_summary"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
