import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.episodes import episodes
from tidemark.operators.nearest import best_event_per_entity, nearest_end_events, repeated_keys
from tidemark.operators.sweep import suggest_chunk_hours, sweep, with_chunk

from .conftest import at, rows

FLAGS = "id bigint, ts timestamp_ntz, on_ int, alt int, end_ int"


def found(spark, data, chunk_hours=24.0, **kw):
    df = spark.createDataFrame(data, FLAGS)
    return rows(episodes(df, "id", "ts", "on_", "alt", "end_", chunk_hours=chunk_hours, **kw))


def test_gap_of_exactly_eight_hours_continues(spark):
    got = found(spark, [(1, at(0), 1, 0, 0), (1, at(8), 1, 0, 0)])
    assert got == [(1, 1, at(0), at(8), 8.0)]
    apart = found(spark, [(1, at(0), 1, 0, 0), (1, at(1), 1, 0, 0), (1, at(9, 1), 1, 0, 0),
                          (1, at(10), 1, 0, 0)])
    assert [r[:4] for r in apart] == [(1, 1, at(0), at(1)), (1, 2, at(9, 1), at(10))]


def test_end_flag_and_alternate_state(spark):
    ended = found(spark, [(1, at(0), 1, 0, 0), (1, at(1), 0, 0, 1), (1, at(2), 1, 0, 0),
                          (1, at(3), 1, 0, 0)])
    assert [r[1:4] for r in ended] == [(1, at(0), at(1)), (2, at(2), at(3))]
    off = found(spark, [(1, at(0), 1, 0, 0), (1, at(1), 1, 0, 0), (1, at(2), 0, 1, 0),
                        (1, at(3), 1, 0, 0), (1, at(4), 1, 0, 0)])
    assert [r[1:4] for r in off] == [(1, at(0), at(1)), (2, at(3), at(4))]


def test_short_and_inactive_episodes_are_dropped(spark):
    assert found(spark, [(1, at(0), 1, 0, 0)]) == []
    assert found(spark, [(1, at(0), 0, 0, 1), (1, at(1), 0, 1, 0), (1, at(2), 0, 0, 1)]) == []


def test_null_entities(spark):
    data = [(None, at(0), 1, 0, 0), (None, at(1), 1, 0, 0), (2, at(0), 1, 0, 0),
            (2, at(1), 1, 0, 0)]
    assert [r[0] for r in found(spark, data)] == [2]
    assert [r[:4] for r in found(spark, data, keep_null_keys=True)] == [
        (None, 1, at(0), at(1)), (2, 1, at(0), at(1))]


def brute(data, gap=8.0):
    out = []
    for key in sorted({r[0] for r in data}):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[4], r[2], r[3]))
        last_on, last_end, opened, marks = None, None, [], []
        for _, t, on, alt, end in mine:
            active = on or end
            new = int(bool((active and last_end == 1) or (not on and alt)
                           or (on and last_on is not None
                               and (t - last_on).total_seconds() // 1 / 3600 > gap)))
            opened.append((t, new))
            if active:
                marks.append((t, on))
                last_end = end
            if on:
                last_on = t
        groups = {}
        for t, on in marks:
            groups.setdefault(sum(n for s, n in opened if s <= t), []).append((t, on))
        kept = [(min(t for t, _ in g), max(t for t, _ in g)) for _, g in sorted(groups.items())
                if max(o for _, o in g) == 1 and len({t for t, _ in g}) > 1]
        out += [(key, i + 1, a, b) for i, (a, b) in enumerate(kept)]
    return out


@pytest.mark.parametrize("chunk_hours", [0.5, 7.0, 10_000.0])
def test_random_flags_match_brute_force_for_any_chunk(spark, chunk_hours):
    rng = random.Random(7)
    data = []
    for key in range(6):
        t = at(0)
        for _ in range(60):
            t += dt.timedelta(minutes=rng.choice([0, 5, 60, 240, 470, 480, 500, 900]))
            data.append((key, t, rng.choice([0, 1, 1]), rng.choice([0, 0, 1]),
                         rng.choice([0, 0, 0, 1])))
    data = list(dict.fromkeys(data))
    got = [r[:4] for r in found(spark, data, chunk_hours)]
    assert got == brute(data)
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or (a[1] + 1 == b[1] and a[3] <= b[2])


def test_sweep_totals_share_ties_and_cross_chunks(spark):
    df = spark.createDataFrame([(1, at(0), 1), (1, at(0), 2), (1, at(30), 4), (1, at(60), 8)],
                               "id int, ts timestamp_ntz, v int")
    got = sweep(with_chunk(df, "ts", 24), ["id"], ["ts", "v"], totals={"total": F.col("v")},
                before={"prev": F.col("v")}, position="n", facts={"top": ("max", F.col("v"))})
    assert rows(got, "v", "total", "prev", "n", "top") == [
        (1, 3, None, 1, 8), (2, 3, 1, 2, 8), (4, 7, 2, 3, 8), (8, 15, 4, 4, 8)]


def test_suggested_chunk(spark):
    df = spark.createDataFrame([(1, at(0, i)) for i in range(100)], "id int, ts timestamp_ntz")
    assert suggest_chunk_hours(df, ["id"], "ts", target_rows=50) == pytest.approx(0.5)


EPS = "id bigint, starttime timestamp_ntz, endtime timestamp_ntz, duration_hours double"


def test_nearest_end_keeps_ties_in_whole_hours(spark):
    flags = spark.createDataFrame(
        [(1, at(5, 1800), 1), (1, at(6, 60), 1), (1, at(20), 1), (1, at(1), 0), (2, at(3), 1)],
        "id bigint, ts timestamp_ntz, special int")
    eps = spark.createDataFrame([(1, at(0), at(5), 5.0), (1, at(8), at(19, 10), 11.0),
                                 (3, at(0), at(3), 3.0)], EPS)
    got = rows(nearest_end_events(flags, eps, "id", "ts", "special"), "id", "endtime",
               "se_charttime", "se_diff")
    assert got == [(1, at(5), at(5, 1800), 0), (1, at(19, 10), at(20), 0)]


@pytest.mark.parametrize("chunk_hours", [1.0, 1000.0])
def test_nearest_end_matches_brute_force(spark, chunk_hours):
    rng = random.Random(3)
    flags = [(k, at(rng.uniform(0, 400)), 1) for k in range(8) for _ in range(rng.randint(1, 12))]
    eps = []
    for k in range(8):
        for _ in range(rng.randint(1, 12)):
            a = rng.uniform(0, 400)
            eps.append((k, at(a), at(a + rng.uniform(0.1, 20)), 1.0))
    want = []
    for k in range(8):
        pairs = [(k, e[2], f[1], int(abs((f[1] - e[2]).total_seconds()) // 3600))
                 for f in flags if f[0] == k for e in eps if e[0] == k]
        low = min(p[3] for p in pairs)
        want += [p for p in pairs if p[3] == low]
    got = rows(nearest_end_events(
        spark.createDataFrame(flags, "id bigint, ts timestamp_ntz, special int"),
        spark.createDataFrame(eps, EPS), "id", "ts", "special", chunk_hours=chunk_hours),
        "id", "endtime", "se_charttime", "se_diff")
    assert got == sorted(want)


def test_best_event(spark):
    df = spark.createDataFrame(
        [(1, 10.0, at(1), at(2)), (1, 10.0, at(3), at(2)), (1, 10.0, at(5), at(2)),
         (1, 9.0, at(2), at(2)), (2, 5.0, at(0), at(2))],
        "id bigint, duration_hours double, event timestamp_ntz, stop timestamp_ntz")
    got = best_event_per_entity(df, "id", "duration_hours", "event", "stop")
    assert rows(got, "id", "event") == [(1, at(3)), (2, at(0))]
    assert rows(repeated_keys(df, ["id"])) == [(1, 4)]
