"""Schemas of the input tables and of the stored derived tables."""

from __future__ import annotations

ICUSTAYS = "subject_id bigint, hadm_id bigint, icustay_id bigint"
CHARTEVENTS = ("subject_id bigint, hadm_id bigint, icustay_id bigint, charttime timestamp_ntz, "
               "itemid bigint, value string, valuenum double, error int")
LABEVENTS = "subject_id bigint, charttime timestamp_ntz, itemid bigint, valuenum double"
PROCEDURES = "icustay_id bigint, starttime timestamp_ntz, itemid bigint"
ITEMS = ("itemid bigint, label string, LEVEL1 string, LEVEL2 string, mean double, "
         "stdev double, missing_percent double")
SIGNALS = ("subject_id bigint, record string, base_date date, base_time string, fs double, "
           "channel string, samples array<double>")
FLAGS = ("icustay_id bigint, charttime timestamp_ntz, MechVent int, OxygenTherapy int, "
         "Extubated int, SelfExtubated int")
EPISODES = ("icustay_id bigint, ventnum bigint, starttime timestamp_ntz, "
            "endtime timestamp_ntz, duration_hours double")
CHART_LONG = ("subject_id bigint, icustay_id bigint, charttime timestamp_ntz, "
              "vital_sign string, valuenum double, unit string")
MEANS = "feature string, mean double"

INPUTS = {"icustays": ICUSTAYS, "chartevents": CHARTEVENTS, "labevents": LABEVENTS,
          "procedureevents_mv": PROCEDURES}
