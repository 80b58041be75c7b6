import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.functions.stats import STATS
from tidemark.operators.segments import nearest_snap, segment_features, segment_limits

from .conftest import at, rows

LONG = "id bigint, ch string, ts timestamp_ntz, v double"
ALL = list(STATS)


def brute(data, seg_hours):
    """Compare every boundary with every row, channel by channel."""
    out = {}
    frame = pd.DataFrame(data, columns=["id", "ch", "ts", "v"])
    for key, mine in frame.groupby("id"):
        first, last = mine["ts"].min(), mine["ts"].max()
        end, label = last, 0
        while end > first:
            start, label = end - pd.Timedelta(hours=seg_hours), label + 1
            for ch, one in mine.groupby("ch"):
                one = one.sort_values("ts").reset_index(drop=True)
                lo = one["ts"][(one["ts"] - start).abs().idxmin()]
                hi = one["ts"][(one["ts"] - end).abs().idxmin()]
                v = one[(one["ts"] >= lo) & (one["ts"] <= hi)]["v"]
                out[(key, label, ch)] = {
                    "mean": v.mean(), "median": v.median(), "mode": v.mode()[0],
                    "kurtosis": v.kurtosis(), "skew": v.skew(), "std": v.std()}
            end = start
    return out


def features(spark, data, seg_hours, chs, **kw):
    df = spark.createDataFrame(data, LONG)
    return segment_features(df, ["id"], "ch", "ts", "v", chs, seg_hours, ALL, **kw)


@pytest.mark.parametrize("seed,chunk_hours", [(1, 3.0), (2, 9999.0), (3, 24.0), (4, 0.9)])
def test_features_match_pandas(spark, seed, chunk_hours):
    rng = random.Random(seed)
    data = []
    for key in range(5):
        for ch in "ab":
            times = rng.sample(range(0, 160), rng.randint(1, 30))
            # Quarter hours, with a long hole, give ties, exact multiples and empty segments.
            data += [(key, ch, at(t / 4 + (30 if t > 90 else 0)), float(rng.randint(1, 6)))
                     for t in times]
    want = brute(data, 3)
    got = features(spark, data, 3, ["a", "b"], chunk_hours=chunk_hours).collect()
    assert {(r["id"], r["label"]) for r in got} == {k[:2] for k in want}
    for r in got:
        for ch in "ab":
            expected = want.get((r["id"], r["label"], ch))
            for s in ALL:
                have = r[f"{ch}_{s}"]
                if expected is None or pd.isna(expected[s]):
                    assert have is None
                else:
                    assert have == pytest.approx(expected[s], abs=1e-9), (r["id"], r["label"], s)


def test_known_statistics(spark):
    data = [(1, "a", at(i / 10), float(v)) for i, v in enumerate([1, 2, 2, 5, 9])]
    r = features(spark, data, 3, ["a"]).first()
    assert r["a_skew"] == pytest.approx(1.294263, abs=1e-6)
    assert r["a_kurtosis"] == pytest.approx(0.905756, abs=1e-6)
    assert r["a_std"] == pytest.approx(3.271085, abs=1e-6)
    assert (r["a_mean"], r["a_median"], r["a_mode"]) == (3.8, 2.0, 2.0)


@pytest.mark.parametrize("values,skew,kurt,std", [
    ([4], None, None, None), ([4, 4], None, None, 0.0), ([4, 4, 4], 0.0, None, 0.0),
    ([4, 4, 4, 4], 0.0, 0.0, 0.0)])
def test_small_and_constant_groups(spark, values, skew, kurt, std):
    data = [(1, "a", at(i / 10), float(v)) for i, v in enumerate(values)]
    data.append((1, "b", at(2), 1.0))
    r = features(spark, data, 3, ["a", "b"]).first()
    assert (r["a_skew"], r["a_kurtosis"], r["a_std"]) == (skew, kurt, std)


def test_tied_modes_take_the_smallest(spark):
    data = [(1, "a", at(i / 10), v) for i, v in enumerate([7.0, 3.0, 7.0, 3.0])]
    assert features(spark, data, 3, ["a"]).first()["a_mode"] == 3.0


def test_single_time_has_no_segment(spark):
    assert features(spark, [(1, "a", at(0), 1.0), (1, "b", at(0), 1.0)], 3, ["a", "b"]).count() == 0


def test_exact_multiple_and_partial_span(spark):
    spans = spark.createDataFrame([(1, at(0), at(6)), (2, at(0), at(6, 1)), (3, at(0), at(0))],
                                  "id int, a timestamp_ntz, b timestamp_ntz")
    got = rows(segment_limits(spans, ["id"], "a", "b", 3))
    assert [r[:2] for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert got[1] == (1, 2, at(0), at(3))
    assert len(rows(segment_limits(spans, ["id"], "a", "b", 3, max_segments=1))) == 2


def test_halfway_boundary_snaps_to_the_earlier_time(spark):
    data = [(1, "a", at(h), 1.0) for h in (0, 2, 4, 6)]  # limits at 3 and 0
    got = rows(nearest_snap(spark.createDataFrame(data, LONG), ["id"], "ch", "ts", "v", 3),
               "label", "start_ts", "end_ts")
    assert got == [(1, at(2), at(6)), (2, at(0), at(2))]


def test_gap_longer_than_a_segment_repeats_one_row(spark):
    data = [(1, "a", at(0), 5.0), (1, "a", at(20), 7.0)]
    got = {r["label"]: (r["a_mean"], r["a_std"]) for r in features(spark, data, 3, ["a"]).collect()}
    assert len(got) == 7
    assert got[1] == (7.0, None) and got[2] == (7.0, None) and got[6] == (5.0, None)


def test_two_series_of_one_channel_share_a_segment(spark):
    data = [(1, "a", 0, at(h), float(h)) for h in range(4)]
    data += [(1, "a", 1, at(h), 10.0 + h) for h in range(4)]
    df = spark.createDataFrame(data, "id bigint, ch string, s int, ts timestamp_ntz, v double")
    r = segment_features(df, ["id"], "ch", "ts", "v", ["a"], 3, ["mean"], series="s").collect()
    assert [(x["label"], x["a_mean"]) for x in r] == [(1, 6.5)]


def test_only_wanted_segments(spark):
    data = [(1, "a", at(h), float(h)) for h in range(0, 30)]
    every = {r["label"]: r["a_mean"] for r in features(spark, data, 3, ["a"]).collect()}
    few = {r["label"]: r["a_mean"]
           for r in features(spark, data, 3, ["a"], max_segments=4).collect()}
    assert few == {k: v for k, v in every.items() if k <= 4}
    assert at(29) - dt.timedelta(hours=3) == at(26)


def test_spread_statistics_are_the_same(spark):
    rng = random.Random(9)
    data = [(k, c, at(h / 7), rng.choice([-3.0, -0.5, 0.0, 2.25, 2.25, 7.0, 1e6 * rng.random()]))
            for k in range(3) for c in "ab" for h in range(rng.randint(2, 80))]
    plain = sorted(features(spark, data, 3, ["a", "b"]).collect())
    spread = sorted(features(spark, data, 3, ["a", "b"], spread=True).collect())
    for p, q in zip(plain, spread, strict=True):
        for x, y in zip(p, q, strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-12)


@pytest.mark.parametrize("limit", [0, 15, 10**6])
def test_large_segments_alone_are_spread(spark, limit):
    rng = random.Random(10)
    data = [(k, c, at(h / 9), rng.choice([-3.0, 0.0, 2.25, 2.25, 7.0, rng.random()]))
            for k in range(2) for c in "ab" for h in range(rng.randint(2, 90))]
    plain = sorted(features(spark, data, 3, ["a", "b"]).collect())
    sized = sorted(features(spark, data, 3, ["a", "b"], spread_over=limit).collect())
    for p, q in zip(plain, sized, strict=True):
        for x, y in zip(p, q, strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-12)
