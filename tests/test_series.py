import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import series as sr

from .conftest import at, rows

LONG = "id bigint, ch string, ts timestamp_ntz, v double, unit string"


def long(spark, data):
    return spark.createDataFrame(data, LONG)


def test_positional_interpolation(spark):
    hours = [0, 1, 5, 6, 7]
    data = [(1, "a", at(1), 10.0, None), (1, "a", at(6), 20.0, "x")]
    data += [(1, "b", at(h), 1.0, None) for h in hours]
    got = sr.impute(long(spark, data), ["id"], "ch", "ts", "v", ["a", "b", "c"], ["unit"])
    a = [r for r in rows(got, "ch", "ts", "v", "unit") if r[0] == "a"]
    assert [r[2] for r in a] == [10, 10, 15, 20, 20]
    assert [r[3] for r in a] == ["x"] * 5
    assert {r[0] for r in rows(got, "ch")} == {"a", "b"}  # absent channels stay absent


def test_fill_runs_forward_then_backward(spark):
    data = [(1, "a", at(0), 1.0, None), (1, "a", at(1), 1.0, "p"), (1, "a", at(2), 1.0, None),
            (1, "a", at(3), 1.0, "q"), (1, "a", at(4), 1.0, None)]
    got = sr.impute(long(spark, data), ["id"], "ch", "ts", "v", ["a"], ["unit"], chunk_hours=1)
    assert [r[1] for r in rows(got, "ts", "unit")] == ["p", "p", "p", "q", "q"]


def test_repeated_times_and_unknown_channels(spark):
    data = [(1, "a", at(0), 1.0, "k"), (1, "a", at(0), 3.0, "m"), (1, None, at(9), 5.0, None),
            (None, "a", at(9), 5.0, None), (1, "b", at(1), None, None)]
    got = sr.impute(long(spark, data), ["id"], "ch", "ts", "v", ["a", "b"], ["unit"])
    assert rows(got, "ch", "ts", "v", "unit") == [
        ("a", at(0), 2.0, "m"), ("a", at(1), 2.0, "m"),
        ("b", at(0), None, None), ("b", at(1), None, None)]  # present, nothing known


def test_densify_size(spark):
    data = [(1, "a", at(0), 1.0, None), (1, "b", at(1), 2.0, None), (2, "a", at(0), 1.0, None)]
    got = sr.densify(long(spark, data), ["id"], "ch", "ts", "v", ["a", "b"])
    assert rows(got, "id", "ch", "ts", "v") == [
        (1, "a", at(0), 1.0), (1, "a", at(1), None), (1, "b", at(0), None), (1, "b", at(1), 2.0),
        (2, "a", at(0), 1.0)]


@pytest.mark.parametrize("chunk_hours", [0.7, 6.0, 9999.0])
def test_impute_matches_pandas(spark, chunk_hours):
    rng = random.Random(11)
    data = []
    for key in range(4):
        for ch in "abc":
            for h in sorted(rng.sample(range(0, 200), rng.randint(1, 25))):
                data.append((key, ch, at(h / 4), round(rng.uniform(0, 100), 2), None))
    got = {(r["id"], r["ch"], r["ts"]): r["v"] for r in sr.impute(
        long(spark, data), ["id"], "ch", "ts", "v", list("abc"), chunk_hours=chunk_hours).collect()}
    want = {}
    frame = pd.DataFrame(data, columns=["id", "ch", "ts", "v", "unit"])
    for key, mine in frame.groupby("id"):
        grid = np.sort(mine["ts"].unique())
        for ch, one in mine.groupby("ch"):
            line = (one.set_index("ts")["v"].reindex(grid)
                    .interpolate(method="linear", limit_direction="both"))
            want.update({(key, ch, pd.Timestamp(t).to_pydatetime()): v for t, v in line.items()})
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_sum_needs_all_parts(spark):
    data = [(1, "x", at(0), 1.0, "u"), (1, "y", at(0), 2.0, "u"), (1, "z", at(0), 3.0, "u"),
            (1, "x", at(1), 1.0, "u"), (2, "x", at(0), 1.0, "u"), (2, "y", at(0), 1.0, "u"),
            (1, "t", at(0), 10.0, "u")]
    got = sr.derive_sum(long(spark, data), ["id"], "ch", "ts", "v", ["x", "y", "z"], "t", "unit")
    assert [r for r in rows(got, "id", "ch", "ts", "v", "unit") if r[1] == "t"] == [
        (1, "t", at(0), 6.0, None), (1, "t", at(0), 10.0, "u")]
    one = sr.derive_sum(long(spark, data), ["id"], "ch", "ts", "v", ["x", "y", "z"], "t", "unit",
                        dedupe=True)
    assert [r for r in rows(one, "id", "ch", "v") if r[1] == "t"] == [(1, "t", 8.0)]


def test_ratio_and_product(spark):
    data = [(1, "RR", at(0), 20.0, "bpm"), (1, "RR", at(1), 10.0, "bpm"),
            (1, "VT", at(0), 500.0, "ml"), (2, "RR", at(0), 10.0, "bpm"),
            (1, "VT", at(2), 400.0, "ml")]
    got = sr.derive_ratio_product(long(spark, data), ["id"], "ch", "ts", "v", "RR", "VT", 1000.0,
                                  ("RSBI", "VE"), "unit", ("bpm/l", "min/l"))
    assert [r for r in rows(got, "id", "ch", "ts", "v", "unit") if r[1] in ("RSBI", "VE")] == [
        (1, "RSBI", at(0), 40.0, "bpm/l"), (1, "RSBI", at(1), None, "bpm/l"),
        (1, "VE", at(0), 10.0, "min/l"), (1, "VE", at(1), None, "min/l")]


def test_series_markers_and_steps(spark):
    data = [(1, "a", at(0), 1.0, "u"), (1, "a", at(0), 3.0, "u"), (1, "b", at(2), 9.0, "w")]
    df = long(spark, data)
    assert rows(sr.channel_series(df, "id", "ch", "ts", "v", "a", "unit")) == [
        (1, at(0), 2.0, "u")]
    assert rows(sr.series_markers(df, "id", "ts")) == [(1, at(0), at(2))]
    pred = spark.createDataFrame([(1, at(0), at(3), 0.5)],
                                 "id int, s timestamp_ntz, e timestamp_ntz, risk double")
    assert rows(sr.step_points(pred, "s", "e")) == [
        (1, 0.5, at(0) + dt.timedelta(seconds=1)), (1, 0.5, at(3))]
