"""Registered queries against their SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

from riftline.plans.livedata import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: repr(float(x)) if isinstance(x, float) else "nan" if x is None else str(x)
    return sorted(tuple(text(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).toPandas().columns.is_unique


def test_cascade_is_one_shuffle(spark):
    from riftline.operators import evidence
    from riftline.sources import views

    plan = evidence.cascade(evidence.canonical(views.reads(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
