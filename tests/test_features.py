import pytest

from tidemark.functions.risk import risk
from tidemark.operators import features as ft
from tidemark.plans import tables as tb

from .conftest import at, rows

SCHEMA = ("label int, icustay_id bigint, seg_start_time timestamp_ntz, "
          "seg_end_time timestamp_ntz, full double, some double, rare double")


@pytest.fixture
def features(spark):
    data = []
    for label in (1, 2, 3):
        for i in range(6):
            data.append((label, i, at(0), at(3), float(i), float(i) if label > 1 or i < 3 else None,
                         1.0 if i < 3 else None))
    return spark.createDataFrame(data, SCHEMA)


NAMES = ["full", "some", "rare"]


def test_sparse_only_if_sparse_in_every_label(features):
    assert ft.dense_features(features, NAMES) == ["full", "some"]
    assert rows(ft.share_dense(features, NAMES)) == [("full", 1), ("rare", 0), ("some", 1)]


def test_exactly_two_thirds_is_kept(spark):
    df = spark.createDataFrame([(1, 1, at(0), at(3), 1.0, 1.0 if i < 4 else None, None)
                                for i in range(6)], SCHEMA)
    assert ft.dense_features(df, NAMES) == ["full", "some"]


def test_training_table_fills_with_population_means(features):
    table, means, kept = tb.training_table(features, NAMES, 6, 3)
    assert kept == ["full", "some"]
    mean = dict(rows(means))
    assert mean["some"] == pytest.approx(33 / 15)  # all three labels, before the cut
    got = rows(table, "label", "icustay_id", "some")
    assert len(got) == 12 and {r[0] for r in got} == {1, 2}
    assert [r[2] for r in got if r[0] == 1] == [0.0, 1.0, 2.0] + [pytest.approx(2.2)] * 3


def test_training_table_can_fill_by_label(features):
    table, _, _ = tb.training_table(features, NAMES, 6, 3, fill="label")
    assert [r[1] for r in rows(table.filter("label = 1"), "icustay_id", "some")] == [
        0.0, 1.0, 2.0, 1.0, 1.0, 1.0]


def test_alignment_adds_missing_columns(spark, features):
    means = spark.createDataFrame([("some", 7.0), ("other", 9.0)], "feature string, mean double")
    got = ft.align_and_fill(features.filter("label = 1"), ["icustay_id"], ["other", "some"], means)
    assert got.columns == ["icustay_id", "other", "some"]
    assert rows(got)[5] == (5, 9.0, 7.0)


def test_means_and_counts(features):
    assert rows(ft.label_means(features, ["full"])) == [(1, 2.5), (2, 2.5), (3, 2.5)]
    assert rows(ft.label_counts(features, ["some"])) == [(1, 6, 3), (2, 6, 6), (3, 6, 6)]
    assert ft.nearest_segments(features, 6, 3).count() == 12
    assert rows(ft.fill_defaults(features, {"rare": 0.0}), "rare")[0] == (0.0,)


def test_risk_curve(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 3), (2, 3)], "id int, y_pred int")
    got = rows(risk(df, ["id"]))
    assert got[0] == (1, 1, 1.0) and got[2] == (1, 4, 0.0)
    assert got[1][2] == pytest.approx(0.5)
    assert [r[2] for r in got[3:]] == [None, None]  # no spread, no risk
