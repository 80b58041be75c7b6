import pytest
from pyspark.sql import functions as F

from tidemark.presets import icu
from tidemark.session import settle
from tidemark.sources import signals as sg
from tidemark.sources import tables as st

from .conftest import at, rows


def test_ensure_table(spark):
    calls = []

    def build(v):
        def run():
            calls.append(v)
            return spark.createDataFrame([(v,)], "v int")
        return run
    assert not st.table_exists(spark, "made")
    assert rows(st.ensure_table(spark, "made", build(1))) == [(1,)]
    assert rows(st.ensure_table(spark, "made", build(2))) == [(1,)]
    assert rows(st.ensure_table(spark, "made", build(3), rebuild=True)) == [(3,)]
    assert calls == [1, 3]
    empty = st.empty_like(spark, "made")
    assert empty.columns == ["v"] and empty.count() == 0
    made = st.create_from_sql(spark, "made2", "SELECT v + :n AS v FROM IDENTIFIER(:t)",
                              {"n": 4, "t": "made"})
    assert rows(made) == [(7,)]
    st.drop_table(spark, "made2")
    assert not st.table_exists(spark, "made2")


def test_cache_key_covers_all_parameters(spark, tmp_path):
    def build(v):
        return lambda: spark.createDataFrame([(v,)], "v int")
    folder = str(tmp_path)
    assert rows(st.cached(spark, folder, "x", {"stay": 1, "end": at(1)}, build(1))) == [(1,)]
    assert rows(st.cached(spark, folder, "x", {"stay": 1, "end": at(2)}, build(2))) == [(2,)]
    assert rows(st.cached(spark, folder, "x", {"stay": 1, "end": at(1)}, build(3))) == [(1,)]
    assert rows(st.cached(spark, folder, "", {"stay": 1}, build(4))) == [(4,)]


def test_bucketed_store_and_one_entity(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(70)], "stay bigint, v double")
    path = str(tmp_path / "chart")
    st.write_by_bucket(df, path, "stay", 4)
    assert rows(st.read_entity(spark, path, "stay", 3, 4)) == rows(df.filter("stay = 3"))
    assert spark.read.parquet(path).count() == 70


def test_feature_store_and_absent_tables(spark, tmp_path):
    path = str(tmp_path / "means")
    assert st.load_table(spark, path) is None
    st.save_table(spark.createDataFrame([("a", 1.0)], "feature string, mean double"), path)
    assert rows(st.load_table(spark, path)) == [("a", 1.0)]


def test_items_with_commas_in_quotes(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("itemid,label,LEVEL1,LEVEL2,mean,stdev,missing percent\n"
                    '7,"rate, of heart",a,"b, c",85.1,17.1,48.4\n8,spo2,x,y,97.0,3.4,\n')
    got = rows(st.read_items(spark, str(path)))
    assert got == [(7, "rate, of heart", "a", "b, c", 85.1, 17.1, 48.4),
                   (8, "spo2", "x", "y", 97.0, 3.4, None)]


def test_padded_id_keeps_long_numbers(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "n bigint")
    assert rows(df.select(st.padded_id("p", F.col("n")).alias("p"))) == [("p000007",),
                                                                         ("p1234567",)]


def test_record_lookup(spark, tmp_path):
    path = tmp_path / "records.txt"
    path.write_text("p00/p000020/p000020-2183-04-28-17-47n\n"
                    "p00/p000020/p000020-2183-05-01-10-00n\n"
                    "p00/p000033/p000033-2116-12-24-12-35n\nother/line\n")
    got = sg.find_records(spark, str(path), icu.RECORD_PATTERN, "000020")
    assert rows(got) == [("p000020-2183-04-28-17-47n",), ("p000020-2183-05-01-10-00n",)]


def test_signals_to_rows(spark):
    df = spark.createDataFrame(
        [("r", "2130-03-01", "08:00:00", 1 / 60, "ABPSys", [1.0, None, 3.0]),
         ("r", "2130-03-01", "08:00:00", 1 / 60, "NBP SYS", [9.0, 8.0, 7.0]),
         ("r", "2130-03-01", "08:00:00", 1 / 60, "junk", [0.0])],
        "record string, day string, clock string, fs double, channel string, "
        "samples array<double>").withColumn("day", F.col("day").cast("date"))
    wide = sg.expand_signals(df, ["record"], sg.record_start("day", "clock"), "fs", "samples",
                             "channel", icu.SIGNAL_CHANNELS, icu.SIGNAL_NAMES)
    assert rows(wide, "time", "SBP") == [(at(0), 1.0), (at(0, 60), 8.0), (at(0, 120), 3.0)]


@pytest.mark.parametrize("fs,period", [(1.0, 1), (0.4, 2), (2.0, 0), (0.016, 62)])
def test_sampling_period_rounds_half_to_even(spark, fs, period):
    from tidemark.functions.times import sampling_period
    got = spark.range(1).select(sampling_period(F.lit(fs)).alias("p")).first()["p"]
    assert got == period


def test_time_differences_ignore_the_session_zone(spark):
    from tidemark.functions.times import micros_between, whole_hours
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00' a, "
                        "TIMESTAMP_NTZ'2024-03-10 02:30:00.5' b").select(
            whole_hours(F.col("a"), F.col("b")).alias("h"),
            micros_between(F.col("a"), F.col("b")).alias("u"),
            whole_hours(F.col("b"), F.col("a")).alias("back")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(got) == (1, 3_600_500_000, -1)


def test_settle_cuts_lineage_in_the_shared_folder(spark):
    df = settle(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert spark.sparkContext.getCheckpointDir().startswith("file:") or \
        spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
