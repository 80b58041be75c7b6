"""The preset end to end on a few invented stays."""

import random

import pytest

from tidemark.operators import model as md
from tidemark.plans import chart as ch
from tidemark.plans import cohort as co
from tidemark.plans import tables as tb
from tidemark.presets import icu
from tidemark.schema import CHARTEVENTS, ICUSTAYS, LABEVENTS, PROCEDURES

from .conftest import at, rows

STAYS = [(100 + s, 200 + s, s) for s in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(1)
    chart, labs, done = [], [], []

    def add(s, t, item, value=None, num=None, error=None):
        chart.append((100 + s, 200 + s, s, t, item, value, num, error))
    for s, hours in ((1, 20), (2, 13), (3, 11)):
        for h in range(hours + 1):
            add(s, at(h), 223849, "CMV")
            add(s, at(h), 211, str(80 + h), 80.0 + h + rng.random())
            add(s, at(h, 600), 618, "20", 18.0 + rng.randint(0, 5))
            if h % 3 == 0:
                add(s, at(h), 682, "500", 450.0 + 10 * rng.randint(0, 9))
                for item, top in ((220739, 4), (223900, 5), (223901, 6)):
                    add(s, at(h), item, "x", float(rng.randint(1, top)))
            if h % 5 == 0:
                add(s, at(h), 198, "9", float(rng.randint(3, 15)))
                labs.append((100 + s, at(h, 60), 50821, 90.0 + h))
        add(s, at(hours, 1800), 640, "Self Extubation")
    add(1, at(2), 762, "80", 80.0)
    add(1, at(1), 920, "70", 70.0)
    add(1, at(3), 211, "999", 999.0)      # out of range: kept without label
    add(1, at(3), 211, "70", 70.0, 1)     # marked as error: dropped
    labs += [(101, at(4), 50821, 0.5), (101, at(400), 50821, 95.0), (101, at(4), 50000, 1.0)]
    done.append((2, at(13, 3000), 225468))
    done.append((4, at(1), 225468))       # no ventilation episode
    return (spark.createDataFrame(chart, CHARTEVENTS), spark.createDataFrame(labs, LABEVENTS),
            spark.createDataFrame(done, PROCEDURES), spark.createDataFrame(STAYS, ICUSTAYS))


@pytest.fixture(scope="module")
def cohort(inputs):
    chart, _, done, stays = inputs
    return co.build_cohort(chart, done, stays).cache()


def test_cohort(cohort):
    got = {r["icustay_id"]: r for r in cohort.collect()}
    assert sorted(got) == [1, 2]  # stay 3 is too short, stay 4 was never ventilated
    one = got[1]
    assert (one["subject_id"], one["hadm_id"]) == (101, 201)
    assert (one["vent_start"], one["vent_end"]) == (at(0), at(20, 1800))
    assert one["se_charttime"] == at(20, 1800) and one["duration_hours"] == 20.5
    assert (one["height"], one["weight"]) == (177.8, 80.0)
    assert one["bmi"] == pytest.approx(80 / 1.778 ** 2)
    assert got[2]["weight"] is None
    # The procedure lies after the end flag, so it starts no episode of its own.
    assert got[2]["vent_end"] == at(13, 1800) and got[2]["duration_hours"] == 13.5


def test_minimum_duration_is_inclusive(inputs, cohort):
    chart, _, done, stays = inputs
    assert co.final_cohort(cohort, 13.5).count() == 2
    assert co.final_cohort(cohort, 13.51).count() == 1


def test_ids_and_summary(cohort):
    assert [r[0] for r in co.entity_ids(cohort).collect()] == ["1", "2"]
    r = co.stay_summary(cohort, 1).first()
    assert (r["bmi"], r["duration_hours"], r["weight"]) == (25.31, 20.5, 80.0)


def test_chart_data(inputs, cohort):
    chart, labs, _, _ = inputs
    long = ch.chart_data(cohort, chart, labs)
    assert long.columns == list(ch.LONG)
    got = rows(long.filter("icustay_id = 1 and vital_sign is null"), "charttime", "valuenum")
    assert got == [(at(3), 999.0), (at(4), 0.5)]
    lab = rows(long.filter("vital_sign = 'PaO2'"), "icustay_id", "charttime", "valuenum", "unit")
    assert lab[0] == (1, at(0, 60), 90.0, "mmHg") and len([r for r in lab if r[0] == 1]) == 5
    assert rows(long.filter("valuenum = 70.0 and vital_sign = 'HR'")) == []
    lists = dict(rows(ch.stay_channels(long)))
    assert lists[1] == ["GCSeye", "GCSmotor", "GCStot", "GCSverbal", "HR", "PaO2", "RR", "VTobs"]


def test_features_train_and_score(spark, inputs, cohort):
    chart, labs, _, _ = inputs
    long = ch.chart_data(cohort, chart, labs).cache()
    names = [f"{c}_{s}" for c in (*icu.CHANNELS, *icu.DERIVED_CHANNELS) for s in icu.STATS]
    args = (["icustay_id"], "vital_sign", "charttime", "valuenum", icu.CHANNELS, tb.icu_derived())
    features = tb.feature_table(long, *args).cache()
    got = {(r["icustay_id"], r["label"]): r for r in features.collect()}
    assert len([k for k in got if k[0] == 1]) == 7  # 20 h of data in 3 h steps
    first = got[(1, 1)]
    assert first["RSBIobs_mean"] is not None and first["RSBIspot_mean"] is None
    # Charted and summed coma scores both count.
    both = rows(tb.filled_series(long, *args).filter("vital_sign = 'GCStot' and icustay_id = 1"),
                "charttime", "_series")
    assert len({r[0] for r in both}) * 2 == len(both)
    table, means, kept = tb.training_table(features, names, icu.TRAINING_HOURS, icu.SEG_HOURS)
    assert "HR_mean" in kept and "CVP_mean" not in kept
    assert {r[0] for r in rows(table, "label")} == {1, 2, 3, 4}
    assert all(x is not None for r in rows(table, *kept) for x in r)
    model = md.fit(table, kept, "label", md.random_forest().setNumTrees(3))
    scoring = tb.scoring_table(long, means, kept, *args)
    assert scoring.count() == 7 + 5
    pred = tb.score(model, scoring, ["icustay_id"]).collect()
    assert all(p["ser_risk"] is None or 0 <= p["ser_risk"] <= 1 for p in pred)
    assert tb.scoring_table(long, None, kept, *args) is None
