"""From raw events to one event per stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.episodes import episodes
from ..operators.extract import join_dimension
from ..operators.first_value import first_value_pivot, with_bmi
from ..operators.nearest import best_event_per_entity, nearest_end_events
from ..operators.rules import fixed_flags, keep_valid, status_flags
from ..presets import icu
from ..session import settle


def ventilation_status(chartevents: DataFrame, procedures: DataFrame) -> DataFrame:
    """0/1 status flags per (stay, time) from charted settings and procedures."""
    charted = keep_valid(chartevents, error="error", text="value", code="itemid",
                         codes=icu.STATUS_CODES)
    done = fixed_flags(procedures, "icustay_id", "starttime", "itemid", icu.EXTUBATION_PROCEDURES,
                       {"MechVent": 0, "OxygenTherapy": 0, "Extubated": 1},
                       {"SelfExtubated": [icu.SELF_EXTUBATION_PROCEDURE]}, ts_as="charttime")
    return status_flags(charted, icu.STATUS_FLAGS, "icustay_id", "charttime", "itemid", "value",
                        extra=done)


def ventilation_episodes(flags: DataFrame, chunk_hours: float = 24.0) -> DataFrame:
    return episodes(flags, "icustay_id", "charttime", "MechVent", "OxygenTherapy", "Extubated",
                    icu.GAP_HOURS, chunk_hours)


def body_measures(chartevents: DataFrame) -> DataFrame:
    """First height and weight per stay, and the body mass index."""
    valid = keep_valid(chartevents, error="error")
    first = first_value_pivot(valid, icu.BODY_RULES, ["icustay_id", "subject_id"], "charttime",
                              "itemid", "valuenum", icu.BODY_CONVERSIONS)
    return with_bmi(first)


def all_events(flags: DataFrame, vent: DataFrame, body: DataFrame, stays: DataFrame,
               chunk_hours: float = 24.0) -> DataFrame:
    """Self-extubations with their closest ventilation episode, measures and ids."""
    pairs = nearest_end_events(flags, vent, "icustay_id", "charttime", "SelfExtubated",
                               chunk_hours=chunk_hours)
    shaped = pairs.select("icustay_id", F.col("starttime").alias("vent_start"),
                          F.col("endtime").alias("vent_end"), "se_charttime", "duration_hours")
    measured = join_dimension(shaped, body, "icustay_id", ["weight", "height", "bmi"])
    named = join_dimension(measured, stays, "icustay_id", ["subject_id", "hadm_id"])
    return named.select("subject_id", "hadm_id", "icustay_id", "vent_start", "vent_end",
                        "se_charttime", "duration_hours", "weight", "height", "bmi")


def reduced_cohort(events: DataFrame) -> DataFrame:
    """One event per stay."""
    return best_event_per_entity(events, "icustay_id", "duration_hours", "se_charttime",
                                 "vent_end")


def final_cohort(reduced: DataFrame, min_hours: float = icu.MIN_VENT_HOURS) -> DataFrame:
    return reduced.filter(F.col("duration_hours") >= min_hours)


def build_cohort(chartevents: DataFrame, procedures: DataFrame, stays: DataFrame,
                 min_hours: float = icu.MIN_VENT_HOURS, chunk_hours: float = 24.0) -> DataFrame:
    """The whole chain. Flags and episodes are read more than once, so each is stored
    in the shared folder when it is ready."""
    flags = settle(ventilation_status(chartevents, procedures)
                   .filter(F.col("icustay_id").isNotNull()))
    vent = settle(ventilation_episodes(flags, chunk_hours))
    events = all_events(flags, vent, body_measures(chartevents), stays, chunk_hours)
    return final_cohort(reduced_cohort(events), min_hours)


def entity_ids(cohort: DataFrame, key: str = "icustay_id") -> DataFrame:
    """Sorted ids as text."""
    return cohort.select(F.col(key).cast("string").alias(key)).orderBy(key)


def stay_summary(cohort: DataFrame, icustay_id: int) -> DataFrame:
    """Display record of one stay."""
    return cohort.filter(F.col("icustay_id") == icustay_id).select(
        "icustay_id", "subject_id", "hadm_id", "weight", "height",
        F.round("bmi", 2).alias("bmi"), "vent_start", "vent_end",
        F.round("duration_hours", 2).alias("duration_hours"))
