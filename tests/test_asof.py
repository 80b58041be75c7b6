"""As-of joins against a search over all pairs, and the interval index."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.extract import extract_interval

from .conftest import at
from .test_plans import final_plan


def matched(row, right, direction, within):
    key, t = row[0], row[1]
    best = None
    for k, u, v in right:
        if key is None or t is None or k != key or u is None:
            continue
        if (direction == "backward" and u > t) or (direction == "forward" and u < t):
            continue
        off = abs((u - t).total_seconds())
        if within is not None and off > within:
            continue
        rank = (off, u, (v is not None, v or 0))
        if best is None or rank < best[0]:
            best = rank, (u, v)
    return best[1] if best else (None, None)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)

    def some(n, clash):
        keys = [1] * 6 + [2, 3, None]
        return [(rng.choice(keys), None if rng.random() < 0.04 else at(rng.randint(0, 400) / 4), rng.choice([None, *range(9)]), *clash)
                for _ in range(n)]
    left = some(250, ("x",)) + [(7, at(1), 1, "x"), (1, at(5), 1, "x"), (1, at(5), 1, "x")]
    right = [r[:3] for r in some(160, ())] + [(1, at(5), 4), (1, at(5), 3)]
    return (spark.createDataFrame(left, "k int, t timestamp_ntz, own int, at string"), left,
            spark.createDataFrame(right, "k int, u timestamp_ntz, v int"), right)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("within", [None, 1800])
def test_asof(sides, direction, within):
    left, lrows, right, rrows = sides
    got = asof_join(left, right, ["k"], "t", "u", ["v"], direction, within, chunk_hours=5.0)
    assert got.columns == ["k", "t", "own", "at", "found_ts", "v"]
    key = lambda r: [(x is not None, x) for x in r]
    want = sorted(((*r, *matched(r, rrows, direction, within)) for r in lrows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want


def test_asof_of_empty_tables(sides):
    left, lrows, right, _ = sides
    assert asof_join(left.limit(0), right, ["k"], "t", "u", ["v"]).count() == 0
    got = asof_join(left, right.limit(0), ["k"], "t", "u", ["v"])
    assert got.count() == len(lrows) and got.filter("found_ts IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "u", ["v"], "sideways")


def test_a_hot_entity_is_spread(spark):
    """No window of the plan is by the entity's rows alone: chunks hold them."""
    hot = spark.range(4000).select(F.lit(1).alias("k"), F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(at(0))).alias("t"))
    joined = asof_join(hot, hot.select("k", F.col("t").alias("u"), F.lit(1).alias("v")).filter("minute(u) = 0"), ["k"], "t", "u", ["v"])
    plan = final_plan(joined)
    assert joined.filter("v IS NULL").count() == 0
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_an_endless_window_changes_nothing_for_the_others(spark):
    rng = random.Random(6)
    windows = [(rng.randint(1, 3), i, at(rng.randint(0, 500)), rng.choice([0, 1, 5, 30, 400])) for i in range(60)]
    windows = [(k, i, s, s + dt.timedelta(hours=h)) for k, i, s, h in windows]
    windows += [(1, 900, at(0), dt.datetime(9999, 12, 31)), (1, 901, dt.datetime(1, 1, 1), at(3)), (2, 902, at(9), at(2)), (2, 903, None, at(3)),
                (None, 904, at(0), at(9))]
    events = [(rng.choice([1, 2, 3, 4, None]), at(rng.randint(-50, 1000)), i) for i in range(400)] + [(1, None, 999)]
    w = spark.createDataFrame(windows, "k int, w int, start timestamp_ntz, stop timestamp_ntz")
    e = spark.createDataFrame(events, "k int, ts timestamp_ntz, e int")
    spark.sparkContext.setJobGroup("building", "plan only")
    got = extract_interval(w, e, ["k"], "ts", "start", "stop", keep=["w"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = sorted((i, j) for k, t, i in events for l, j, s, x in windows if k is not None and k == l and t and s and s <= t <= x)
    assert sorted((r["e"], r["w"]) for r in got.collect()) == want
    # Pairs of the join before the filter: not many more than results.
    short = spark.createDataFrame([(1, i, at(10 * i), at(10 * i + 9)) for i in range(300)] + [(1, 999, at(0), dt.datetime(9999, 1, 1))],
                                  "k int, w int, start timestamp_ntz, stop timestamp_ntz")
    many = spark.createDataFrame([(1, at(h)) for h in range(3000)], "k int, ts timestamp_ntz")
    assert extract_interval(short, many, ["k"], "ts", "start", "stop", keep=["w"]).count() == 6000
