"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.driver import queries as q
from tidemark.driver import settings as cfg
from tidemark.operators.segments import segment_members
from tidemark.operators.sweep import CHUNK, sweep, with_chunk
from tidemark.plans import tables as tb
from tidemark.sources import tables as st

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

LAZY = ("rule_label", "status_flags", "flag_union", "episodes", "first_value_pivot", "nearest_end",
        "best_per_key", "interval_extract", "interval_union", "densify", "interpolate",
        "channel_ratio", "nearest_snap", "segment_features", "filled_features", "label_means",
        "stratified_split", "risk", "spread_stats", "icu_chart")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan  # everything stays in the JVM


def test_rows_at_limits_are_never_broadcast(spark):
    """Spark takes exploded rows for as few as those they come from."""
    rows = q.long_events(spark, SF).withColumns({"_first_ts": F.col("ts"), "_last_ts": F.col("ts")})
    plan = plan_of(segment_members(rows, ["user_id"], "event_type", "ts", "value", 48))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(q.rule_label(spark, SF))
    assert re.search(r"PushedFilters: \[In\(event_type", plan)
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_episodes_scan_and_shuffle_the_rows_once(spark, no_broadcast):
    plan = final_plan(q.episodes_query(spark, SF))
    assert plan.count("FileScan parquet") == 1
    assert plan.count("ReusedExchange") >= 2


def test_interpolation_scans_once(spark, no_broadcast):
    plan = final_plan(q.interpolate(spark, SF))
    assert plan.count("FileScan parquet") == 1


def test_features_scan_once(spark, no_broadcast):
    long = q.long_events(spark, SF)
    df = tb.feature_table(long, q.USER, *q.LONG, cfg.CHANNELS, (), cfg.SEG_HOURS, ["mean"])
    assert final_plan(df).count("FileScan parquet") == 1


@pytest.mark.parametrize("query", [q.interpolate, q.episodes_query, q.snap])
def test_row_windows_are_clustered_by_chunk(spark, query):
    """A window by entity alone may order chunks or segment cells, never rows by time."""
    plan = plan_of(query(spark, SF))
    specs = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan)
    assert specs
    for spec in specs:
        assert "ts#" not in spec or "_chunk#" in spec.split(" ASC")[0], spec


def test_a_long_entity_is_split(spark):
    hot = q.long_events(spark, SF).withColumn("user_id", F.lit(1).cast("bigint"))
    chunks = with_chunk(hot, "ts", 24).groupBy("user_id", CHUNK).count()
    total, largest = chunks.agg(F.sum("count"), F.max("count")).first()
    assert chunks.count() >= 28 and largest < total / 10


def test_clustered_rows_need_no_exchange(spark, no_broadcast, tmp_path):
    rows = st.write_clustered(q.long_events(spark, SF), "clustered_rows", str(tmp_path / "rows"), q.USER, "ts", buckets=4)
    own = Window.partitionBy("user_id", CHUNK).orderBy("ts")
    plan = plan_of(rows.withColumn("n", F.row_number().over(own)))
    assert "Window" in plan and "Exchange" not in plan
    assert "Exchange" not in plan_of(rows.groupBy("user_id", CHUNK).agg(F.max("value").alias("v")))
    assert "Exchange" not in plan_of(rows.join(rows.groupBy("user_id", CHUNK).count(), ["user_id", CHUNK]))
    # A sweep shuffles its summaries, one row for each chunk, never the rows.
    swept = final_plan(sweep(rows, q.USER, ["ts"], position="at"))
    for below in re.findall(r"Exchange[^\n]*\n([^\n]*)", swept):
        assert "FileScan" not in below
