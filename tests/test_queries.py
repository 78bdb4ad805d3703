"""Registered queries against DuckDB on the smallest tables, and what their plans must not contain."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, cell

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# One of every family; TEST_ALL=1 runs every query.
SAMPLE = ["a09_customer_mart", "a34_monthly_customers", "a36_session_fact", "j05_star_summary", "j12_scd2_merge", "j13_as_of_version", "snk10_upsert", "w01_ntile_scores", "w07_percent_rank",
          "w14_rank_change", "t02_top_per_category", "f01_strings", "f07_season_flags", "d02_rfm_segments", "d15_best_sellers", "d26_validate", "d28_recommend", "d34_sentiment", "d40_topic_trends",
          "d44_time_dimension", "p01_sales_fact", "p28_clean_catalogue", "q06_profile", "q09_contract_strict", "st01_activity_windows", "m13_metrics_at_k", "m14_similar_customers"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def names():
    return list(entry.oracle_sql()) if os.environ.get("TEST_ALL") else SAMPLE


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    left = sorted(tuple(cell(r[c]) for c in sorted(cols)) for r in df.collect())
    right = sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert left == right


def test_every_oracle_belongs_to_a_query_and_views_resolve():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 250
    assert all(" ord AS " in s or "ord" not in s.split() for s in oracles.values())


@pytest.mark.parametrize("name", ["j05_star_summary", "j11_validity_join", "d28_recommend", "d40_topic_trends", "w01_ntile_scores", "w06_mean_gap", "a23_customer_insights", "a06_payment_distribution"])
def test_plans_have_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["snk12_retain"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["region", "month", "orders", "quantity", "net_revenue", "avg_order_value", "finished_pct", "share_of_month_pct"]
