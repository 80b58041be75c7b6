"""Labelled measurements of every stay inside its own window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract_interval
from ..operators.rules import keep_valid, label_channels
from ..presets import icu

LONG = ("subject_id", "icustay_id", "charttime", "vital_sign", "valuenum", "unit")


def chart_data(cohort: DataFrame, chartevents: DataFrame, labevents: DataFrame | None = None,
               start: str = "vent_start", end: str = "vent_end") -> DataFrame:
    """Long chart data for all stays of the cohort in one job.

    The cohort needs subject_id, hadm_id, icustay_id and its window.  Values out of
    bounds stay with a NULL label.
    """
    valid = keep_valid(chartevents, error="error")
    labelled = label_channels(
        valid.select("subject_id", "hadm_id", "icustay_id", "charttime", "itemid", "valuenum"),
        icu.CHANNEL_RULES, "itemid", "valuenum", icu.CHANNEL_UNITS, icu.CHANNEL_CONVERSIONS,
        icu.CHANNEL_REPAIRS, label_col="vital_sign", value_col="_converted", unit_col="unit")
    charted = extract_interval(cohort, labelled, ["subject_id", "hadm_id", "icustay_id"],
                               "charttime", start, end)
    charted = charted.select("subject_id", "icustay_id", "charttime", "vital_sign",
                             F.col("_converted").alias("valuenum"), "unit")
    if labevents is None:
        return charted
    labs = label_channels(labevents, icu.LAB_RULES, "itemid", "valuenum", icu.LAB_UNITS,
                          label_col="vital_sign", value_col="_converted", unit_col="unit")
    # Labs carry no stay, so a subject's result joins every stay whose window holds it.
    drawn = extract_interval(cohort, labs, ["subject_id"], "charttime", start, end,
                             keep=["icustay_id"])
    drawn = drawn.select("subject_id", "icustay_id", "charttime", "vital_sign",
                         F.col("_converted").alias("valuenum"), "unit")
    return charted.unionByName(drawn)


def stay_channels(chart: DataFrame, entity: str = "icustay_id",
                  channel: str = "vital_sign") -> DataFrame:
    """Sorted list of the channels each stay has; at most one entry per known channel."""
    return (chart.filter(F.col(channel).isNotNull()).groupBy(entity)
            .agg(F.sort_array(F.collect_set(channel)).alias("channels")))
