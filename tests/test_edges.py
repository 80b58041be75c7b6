"""Cases that once gave wrong answers: equal times, small values, partial folders, overlaps."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, rows
from tidemark.functions.stats import stat
from tidemark.operators import features as ft
from tidemark.operators.extract import extract_interval
from tidemark.operators.order_stats import spread_median, spread_mode, value_cell
from tidemark.operators.rules import LabelRule, rule_table
from tidemark.operators.segments import segment_features
from tidemark.session import shared_dir
from tidemark.sources import tables as st


def test_equal_times_at_a_boundary(spark):
    long = spark.createDataFrame([(1, "a", at(h), v) for h, v in ((0, 1.0), (3, 10.0), (3, 20.0), (6, 5.0))],
                                 "stay int, channel string, ts timestamp_ntz, value double")
    for _ in range(2):
        got = segment_features(long, ["stay"], "channel", "ts", "value", ["a"], 3.0, ["mean"])
        assert [round(r["a_mean"], 3) for r in got.orderBy("label").collect()] == [11.667, 10.333]


def test_segments_against_inclusive_limits(spark):
    rng = random.Random(2)
    data = [(e, rng.choice("ab"), at(rng.randrange(0, 40)), float(rng.randrange(9))) for e in range(6) for _ in range(40)]
    long = spark.createDataFrame(data, "stay int, channel string, ts timestamp_ntz, value double")
    got = {(r["stay"], r["label"]): r for r in segment_features(
        long, ["stay"], "channel", "ts", "value", ["a", "b"], 7.0, ["mean"]).collect()}
    for e in range(6):
        times = sorted(t for s, _, t, _ in data if s == e)
        for label in range(1, 8):
            row = got.get((e, label))
            if row is None:
                continue
            for c in "ab":
                own = sorted({t for s, k, t, _ in data if (s, k) == (e, c)})
                low, high = (min(own, key=lambda t: (abs(t - x), t)) for x in (row["seg_start_time"], row["seg_end_time"]))
                inside = [v for s, k, t, v in data if (s, k) == (e, c) and low <= t <= high]
                assert row[f"{c}_mean"] == pytest.approx(sum(inside) / len(inside))
        assert (e, 1) in got and got[e, 1]["seg_end_time"] == times[-1]


def test_mode_of_small_values(spark):
    df = spark.createDataFrame([(1.1e-10,), (1.1e-10,), (3e-10,)], "v double")
    assert df.agg(stat("mode", F.col("v"))).first()[0] == 1.1e-10
    keyed = df.withColumn("k", F.lit(1))
    assert spread_mode(keyed, ["k"], "v").first()["mode"] == 1.1e-10
    assert spread_median(keyed, ["k"], "v").first()["median"] == 1.1e-10


def test_small_values_spread_over_cells(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1e-5, 1e-5) for _ in range(1000)] + [5e-324, -5e-324, 0.0, 1e308]
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double")
    cells = [r["c"] for r in df.orderBy("v").select(value_cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells) and len(set(cells)) > 900


def test_means_stored_twice_or_missing(spark):
    table = spark.createDataFrame([(1, None, 2.0)], "k int, a double, b double")
    twice = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0)], "feature string, mean double")
    assert rows(ft.align_and_fill(table, ["k"], ["a", "b"], twice)) == [(1, 1.0, 2.0)]
    with pytest.raises(ValueError, match="no mean"):
        ft.align_and_fill(table, ["k"], ["a", "b"], twice.filter("feature = 'b'"))
    with pytest.raises(ValueError, match="several"):
        ft.align_and_fill(table, ["k"], ["a"], twice.union(spark.createDataFrame([("a", 2.0)], twice.schema)))


def test_partial_folder_is_no_result(spark, tmp_path):
    def build():
        return spark.range(100)
    st.cached(spark, str(tmp_path), "n", {"a": 1}, build)
    folder, = tmp_path.iterdir()
    assert st.cached(spark, str(tmp_path), "n", {"a": 1}, lambda: pytest.fail("built again")).count() == 100
    spark.range(5).write.mode("overwrite").parquet(str(folder))
    (folder / "_SUCCESS").unlink()
    assert st.load_table(spark, str(folder)) is None
    assert st.cached(spark, str(tmp_path), "n", {"a": 1}, build).count() == 100


def test_failed_build_keeps_the_table(spark):
    def fail():
        raise RuntimeError("no")
    st.ensure_table(spark, "edge_table", lambda: spark.range(3), rebuild=True)
    with pytest.raises(RuntimeError):
        st.ensure_table(spark, "edge_table", fail, rebuild=True)
    assert spark.table("edge_table").count() == 3
    assert st.ensure_table(spark, "edge_table", lambda: spark.range(4), rebuild=True).count() == 4
    st.drop_table(spark, "edge_table")


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_overlapping_rules(spark):
    with pytest.raises(ValueError, match="several rules"):
        rule_table(spark, (LabelRule("a", (1, 2)), LabelRule("b", (2, 3))))


def test_windows_meet_rows_in_cells(spark):
    """One subject with many windows and rows: few of their pairs are made."""
    windows = spark.createDataFrame([(1, i, at(10 * i), at(10 * i + 9)) for i in range(300)] + [(1, 999, at(5), at(1)), (2, 1000, None, at(3))],
                                    "subject int, stay int, start timestamp_ntz, stop timestamp_ntz")
    events = spark.createDataFrame([(1, at(h)) for h in range(3000)] + [(2, at(1)), (1, None)], "subject int, ts timestamp_ntz")
    got = extract_interval(windows, events, ["subject"], "ts", "start", "stop", keep=["stay"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan[plan.index("Join"):].split("\n")[0]
    assert got.count() == 3000
    assert {r["n"] for r in got.groupBy("stay").agg(F.count("*").alias("n")).collect()} == {10}
