import pytest
from pyspark.sql import functions as F

from tidemark.operators.first_value import first_value_pivot, with_bmi
from tidemark.operators.rules import (Bounds, LabelRule, Match, fixed_flags, keep_valid,
                                      label_channels, rename_channels, status_flags)
from tidemark.presets import icu

from .conftest import at, rows


def label(spark, pairs):
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(pairs)],
                               "i int, itemid bigint, valuenum double")
    out = label_channels(df, icu.CHANNEL_RULES, "itemid", "valuenum", icu.CHANNEL_UNITS,
                         icu.CHANNEL_CONVERSIONS, icu.CHANNEL_REPAIRS)
    return {r["i"]: (r["label"], r["converted"], r["unit"]) for r in out.collect()}


def test_bounds_open_and_closed(spark):
    got = label(spark, [(211, 0.0), (211, 300.0), (211, 299.9), (646, 25.0), (646, 100.0),
                        (198, 3.0), (198, 15.0), (198, 15.5), (779, 800.0), (113, 0.0)])
    assert [got[i][0] for i in range(10)] == [None, None, "HR", None, "SpO2", "GCStot", "GCStot",
                                              None, "PaO2", "CVP"]
    assert got[0][1:] == (0.0, "bpm")  # out of range rows survive


def test_gate_looks_at_the_raw_value(spark):
    got = label(spark, [(678, 98.6), (678, 37.0), (676, 37.0), (3688, 0.5), (684, 500.0)])
    assert got[0][0] == "Temp" and got[0][1] == pytest.approx(37.0) and got[0][2] == "C"
    assert got[1][0] is None
    assert got[2] == ("Temp", 37.0, "C")
    assert got[3] == ("VTspot", 500.0, "ml")
    assert got[4] == ("VTspot", 500.0, "ml")


def test_oxygen_fraction_repair(spark):
    values = [0.0, 0.5, 1.0, 20.0, 21.0, 100.0, 101.0, None]
    got = label(spark, [(223835, v) for v in values])
    assert [got[i][1] for i in range(8)] == [None, 50.0, 100.0, None, 21.0, 100.0, None, None]
    assert {got[i][0] for i in range(8)} == {"FiO2"}  # no gate on this channel
    old = label(spark, [(190, 0.20), (190, 0.5), (190, 1.0), (190, 40.0), (3420, 40.0)])
    assert [old[i][1] for i in range(5)] == [0.20, 50.0, 1.0, 40.0, 40.0]
    assert old[0][2] == "%" and old[4][2] is None


def test_unknown_code_is_left_out(spark):
    assert label(spark, [(999999, 5.0)]) == {}


def test_no_code_in_two_rules():
    codes = [c for r in icu.CHANNEL_RULES for c in r.codes]
    assert len(codes) == len(set(codes)) == 63
    assert {r.label for r in icu.CHANNEL_RULES} == set(icu.CHANNELS)


def test_exclusions(spark):
    df = spark.createDataFrame(
        [(1, None, "a", 1.0), (2, 0, "a", 1.0), (3, 1, "a", 1.0), (4, 0, "", 1.0),
         (5, 0, None, 1.0), (6, 0, "a", None), (7, 0, "a", 0.0)],
        "i int, error int, value string, valuenum double")
    assert rows(keep_valid(df, error="error"), "i") == [(1,), (2,), (4,), (5,), (6,), (7,)]
    assert rows(keep_valid(df, text="value"), "i") == [(1,), (2,), (3,), (6,), (7,)]
    assert rows(keep_valid(df, value="valuenum"), "i") == [(1,), (2,), (3,), (4,), (5,)]


CHART = "icustay_id bigint, charttime timestamp_ntz, itemid bigint, value string"


def test_texts_match_exactly(spark):
    df = spark.createDataFrame(
        [(1, at(0), 226732, "Trach mask "), (1, at(1), 226732, "Trach mask"),
         (1, at(2), 720, "Other/Remarks"), (1, at(3), 720, "CMV"), (1, at(4), 467, "Ventilator"),
         (1, at(5), 640, "Self Extubation"), (1, at(6), 470, "5"), (1, at(7), 223849, "x")], CHART)
    got = rows(status_flags(df, icu.STATUS_FLAGS, "icustay_id", "charttime", "itemid", "value"))
    assert [r[2:] for r in got] == [
        (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1),
        (0, 0, 0, 0), (1, 0, 0, 0)]


def test_flags_roll_up_and_union_drops_duplicates(spark):
    chart = spark.createDataFrame(
        [(1, at(0), 720, "CMV"), (1, at(0), 467, "Cannula"), (None, at(0), 720, "CMV"),
         (1, at(2), 640, "Extubated")], CHART)
    done = spark.createDataFrame(
        [(1, at(0), 227194), (1, at(2), 227194), (1, at(2), 225477), (1, at(3), 225468)],
        "icustay_id bigint, starttime timestamp_ntz, itemid bigint")
    extra = fixed_flags(done, "icustay_id", "starttime", "itemid", icu.EXTUBATION_PROCEDURES,
                        {"MechVent": 0, "OxygenTherapy": 0, "Extubated": 1},
                        {"SelfExtubated": [icu.SELF_EXTUBATION_PROCEDURE]}, ts_as="charttime")
    got = rows(status_flags(chart, icu.STATUS_FLAGS, "icustay_id", "charttime", "itemid", "value",
                            extra))
    assert got == [(None, at(0), 1, 0, 0, 0), (1, at(0), 0, 0, 1, 0), (1, at(0), 1, 1, 0, 0),
                   (1, at(2), 0, 0, 1, 0), (1, at(3), 0, 0, 1, 1)]


def test_status_codes_read():
    assert 459 not in icu.STATUS_CODES and 470 in icu.STATUS_CODES
    assert len(set(icu.STATUS_CODES)) == len(icu.STATUS_CODES)


def test_first_value_and_bmi(spark):
    df = spark.createDataFrame(
        [(1, 10, at(5), 762, 90.0), (1, 10, at(2), 3581, 200.0), (1, 10, at(3), 3582, 1.0),
         (1, 10, at(1), 920, 70.0), (1, 10, at(4), 3485, 180.0), (2, 20, at(0), 3485, 170.0),
         (2, 20, at(1), 762, 0.0), (2, 20, at(1), 763, None)],
        "icustay_id bigint, subject_id bigint, charttime timestamp_ntz, itemid bigint, "
        "valuenum double")
    got = with_bmi(first_value_pivot(df, icu.BODY_RULES, ["icustay_id", "subject_id"],
                                     "charttime", "itemid", "valuenum", icu.BODY_CONVERSIONS))
    got = {r["icustay_id"]: r for r in got.collect()}
    kg, cm = 200 * 0.45359237, 70 * 2.54
    assert (got[1]["height"], got[1]["weight"]) == (round(cm, 2), round(kg, 2))
    assert got[1]["bmi"] == pytest.approx(kg / (cm / 100) ** 2)
    assert (got[2]["height"], got[2]["weight"], got[2]["bmi"]) == (170.0, None, None)


def test_rename_coalesces_by_priority(spark):
    df = spark.createDataFrame([(1, None, 5.0, 2.0), (2, 4.0, 6.0, 3.0)],
                               "i int, ABPSys double, `NBP SYS` double, HR double")
    got = rename_channels(df, icu.SIGNAL_NAMES)
    assert rows(got, "i", "SBP", "HR") == [(1, 5.0, 2.0), (2, 4.0, 3.0)]


def test_string_codes_and_bounds(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "code string, v double")
    got = label_channels(df, (LabelRule("x", ("a",), Bounds(1, 2)),), "code", "v")
    assert rows(got, "code", "label") == [("a", "x")]
    assert df.filter(Match(("a",)).test(F.col("code"), F.col("code"))).count() == 1
