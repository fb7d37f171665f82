"""Plans that matter at size: how often rows move, and what is read."""

import os

import pytest

from tracefold.operators import detectors
from tracefold.plans import data_queries, run_queries  # noqa: F401
from tracefold.sources import views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detectors_move_calls_once(spark):
    p = plan(detectors.call_facts(views.calls(spark, FOLDER)))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("FileScan") == 1


def test_recoveries_read_no_contents(spark):
    p = plan(run_queries.recovery_levels(spark, FOLDER))
    scan = next(x for x in p.split("\n") if "ReadSchema" in x)
    assert "result_content" not in scan and "params:" not in scan


def test_every_query_runs_and_has_its_columns(spark):
    for name, f in run_queries.QUERIES.items():
        assert f(spark, FOLDER).columns, name


def test_sql_gives_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("tool_call_events", "trajectories", "tasks", "documents", "events", "lineitem", "orders", "customer", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name in ("recovery_levels", "outcome_labels", "blocked_by_errors", "message_drop_oldest", "asof_last_signup", "test_commands"):
        got = sorted(map(str, (tuple(r[k] for k in sorted(r.asDict())) for r in run_queries.QUERIES[name](spark, FOLDER).collect())))
        rel = c.sql(run_queries.SQL[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert got == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall()), name
