"""Physical-plan properties the operators rely on at scale."""

import posixpath

import pytest

import __spark_entry__ as E
from conftest import SMALL
from gridlens.operators import dashboard as D
from gridlens.operators import periods as P
from gridlens.sources import fixtures as fx
from gridlens.sources.ingest import read_readings
from gridlens.sources.sinks import write_table
from gridlens.streaming.streams import work_dir


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = posixpath.join(work_dir(spark, "plans"), "readings")
    write_table(fx.readings(spark, SMALL), path)
    return read_readings(spark, path)


def test_period_filter_prunes_partitions_and_pushes_time(stored):
    plan = _plan(P.in_period(stored, "2024-01-08", "2024-01-15").select("device_id", "today_kwh"))
    assert "PartitionFilters: [isnotnull(event_date" in plan and "(event_date" in plan
    assert "GreaterThanOrEqual(event_ts,2024-01-08T00:00)" in plan
    assert "ReadSchema: struct<device_id:string,has_energy:boolean,event_ts:timestamp_ntz,today_kwh:double>" in plan


def test_dashboard_pushes_processing_time(stored):
    plan = _plan(D.dashboard_hourly(stored, "2024-01-30 18:00:00"))
    assert "GreaterThanOrEqual(processing_ts,2024-01-29T17:00)" in plan


def test_newest_readings_is_top_k(spark, stored):
    assert "TakeOrderedAndProject" in _plan(P.recent_readings(stored, "2024-01-31 00:00:00", 48, 10_000))
    assert "TakeOrderedAndProject" in _plan(D.dashboard_today(stored, "2024-01-30 18:00:00", limit=1440))


@pytest.mark.parametrize("name", ["daily_report", "device_breakdown", "weekly_report", "audit_full", "append_ledger",
                                  "period_comparison", "expanding_splits", "classify_anomalies", "forecast_by_device",
                                  "forecast", "detect_anomalies", "dashboard_cost", "data_sufficiency", "append_ledger_counts"])
def test_no_cartesian_or_nested_loop_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_aggregates_are_partial_first(spark):
    plan = _plan(E.queries()["daily_report"](spark, SMALL))
    assert "partial_max" in plan


def test_bucketed_audit_joins_without_an_exchange(spark):
    df = E.queries()["audit_bucketed"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_free_form_hashing_stays_in_the_jvm(spark):
    plan = E.queries()["hash_readings_free_form"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
