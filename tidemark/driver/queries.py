"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.risk import risk
from ..functions.times import whole_hours
from ..operators import features as ft
from ..operators import model as md
from ..operators import search as sc
from ..operators import series as sr
from ..operators.asof import asof_join
from ..operators.episodes import episode_marks, episodes
from ..operators.extract import entity_rows, extract_interval, join_dimension
from ..operators.first_value import first_value_pivot, with_bmi
from ..operators.nearest import best_event_per_entity, nearest_end_events, repeated_keys
from ..operators.order_stats import spread_median, spread_mode
from ..operators.rules import (Bounds, Conversion, LabelRule, Match, Repair, Units, fixed_flags,
                               keep_valid, label_channels, rename_channels, status_flags)
from ..operators.segments import nearest_snap, segment_features, segment_limits
from ..operators.sweep import sweep
from ..plans import tables as tb
from ..plans.chart import chart_data, stay_channels
from ..plans.cohort import body_measures, ventilation_status
from ..session import settle, shared_dir
from ..sources import signals as sg
from ..sources import tables as st
from . import settings as cfg

USER = ["user_id"]
LONG = ("event_type", "ts", "value")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals; the small step keeps exact halves off the rounding boundary."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(c, 9) + F.lit(4e-10), 6)


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def events(spark, sf):
    return table(spark, sf, "events")


def long_events(spark, sf):
    return events(spark, sf).select("user_id", *LONG)


# --- rules ---------------------------------------------------------------------------------

RULES = (LabelRule("rate", ("click", "view"), Bounds(0, 100, False, False)),
         LabelRule("temp", ("error",), Bounds(10, 50, True, False)),
         LabelRule("flow", ("purchase",), Bounds(25, 100, False, True)))
CONVERSIONS = (Conversion(("error",), divisor=1.8, offset=32.0),
               Conversion(("purchase",), factor=1000.0))
UNITS = (Units("bpm", ("click", "view")), Units("ml", ("purchase",)))
REPAIRS = (Repair(("click",), ((Bounds(0, 1, False, True), 100.0),
                               (Bounds(1, 21, False, False), None), (Bounds(21, 100), 1.0))),
           Repair(("view",), ((Bounds(0.2, 1, False, False), 100.0),), keep_rest=True))


def rule_label(spark, sf):
    out = label_channels(events(spark, sf).select("event_id", "event_type", "value"), RULES,
                         "event_type", "value", UNITS, CONVERSIONS)
    return out.select("event_id", "label", r6("converted").alias("converted"), "unit")


def repair_nested(spark, sf):
    every = (LabelRule("all", tuple(cfg.CHANNELS)),)
    out = label_channels(events(spark, sf).select("event_id", "event_type", "value"), every,
                         "event_type", "value", repairs=REPAIRS)
    return out.select("event_id", "event_type", r6("converted").alias("converted"))


def null_safe_exclude(spark, sf):
    marked = events(spark, sf).withColumn(
        "error", F.when(F.col("value") > 200, 1).when(F.col("value") >= 5, 0))
    kept = keep_valid(marked, error="error", text="props", value="value", code="event_type",
                      codes=["click", "view", "purchase"])
    return kept.select("event_id", "event_type", "value", "error")


def event_flags(spark, sf):
    flags = {k: (Match(v),) for k, v in cfg.FLAG_CODES.items()}
    return status_flags(events(spark, sf), flags, "user_id", "ts", "event_type", "props")


def flag_union(spark, sf):
    """Flags by code and text, with a second source in a distinct union."""
    flags = {"on_flag": (Match(("click",)), Match(("view",), not_texts=('{"k": 9}',))),
             "alt_flag": (Match(("signup",)),),
             "end_flag": (Match(("purchase", "error")),),
             "special_flag": (Match(("error",), texts=('{"k": 1}', '{"k": 2}', '{"k": 3}')),)}
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id")
    extra = fixed_flags(orders, "user_id", "o_orderdate", "o_orderstatus", ("F", "P"),
                        {"on_flag": 0, "alt_flag": 0, "end_flag": 1}, {"special_flag": ["P"]},
                        ts_as="ts")
    charted = keep_valid(events(spark, sf), text="props")
    return status_flags(charted, flags, "user_id", "ts", "event_type", "props", extra=extra)


# --- episodes and cohort -------------------------------------------------------------------

def event_episodes(spark, sf, flags: DataFrame | None = None):
    flags = event_flags(spark, sf) if flags is None else flags
    return episodes(flags, "user_id", "ts", "on_flag", "alt_flag", "end_flag", cfg.GAP_HOURS)


def episodes_query(spark, sf):
    return event_episodes(spark, sf).withColumn("duration_hours", r6("duration_hours"))


def episode_marks_query(spark, sf):
    return episode_marks(event_flags(spark, sf), "user_id", "ts", "on_flag", "alt_flag",
                         "end_flag", cfg.GAP_HOURS).select("user_id", "ts", "opens", "episode_no")


def first_values(spark, sf):
    rules = (LabelRule("height", ("click", "signup")), LabelRule("weight", ("view", "error")))
    conversions = (Conversion(("click",), factor=2.54), Conversion(("error",), factor=0.45359237))
    return with_bmi(first_value_pivot(events(spark, sf), rules, USER, "ts", "event_type", "value",
                                      conversions))


def first_value_query(spark, sf):
    return first_values(spark, sf).withColumn("bmi", r6("bmi"))


def _nearest(spark, sf, flags, found):
    return nearest_end_events(flags, found, "user_id", "ts", "special_flag",
                              event_col="event_ts")


def nearest_end(spark, sf):
    flags = settle(event_flags(spark, sf))
    found = settle(event_episodes(spark, sf, flags))
    return _nearest(spark, sf, flags, found).withColumn("duration_hours", r6("duration_hours"))


def _asof(spark, sf, direction):
    """To every purchase the click or view of its user that is nearest in time."""
    rows = events(spark, sf)
    left = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.filter("event_type IN ('click', 'view')").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("near_id"), F.col("value").alias("near_value"))
    return asof_join(left, right, USER, "ts", "at", ["near_id", "near_value"], direction, 6 * 3600)


def asof_nearest(spark, sf):
    return _asof(spark, sf, "nearest")


def asof_backward(spark, sf):
    return _asof(spark, sf, "backward")


def best_per_key(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "l_quantity", "l_shipdate", "o_orderdate")
    return best_event_per_entity(pairs, "o_custkey", "l_quantity", "l_shipdate", "o_orderdate")


def repeated(spark, sf):
    return repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_shipdate"])


def _cohort(spark, sf, min_hours=cfg.MIN_HOURS):
    flags = settle(event_flags(spark, sf))
    found = settle(event_episodes(spark, sf, flags))
    pairs = _nearest(spark, sf, flags, found).drop("se_diff")
    measured = join_dimension(pairs, first_values(spark, sf), "user_id",
                              ["weight", "height", "bmi"])
    people = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    named = join_dimension(measured, people, "user_id", ["c_name", "c_nationkey"])
    best = best_event_per_entity(named, "user_id", "duration_hours", "event_ts", "endtime")
    return best.filter(F.col("duration_hours") >= min_hours)


def cohort(spark, sf):
    return _rounded(_cohort(spark, sf), ["duration_hours", "bmi"])


def summary(spark, sf):
    return _cohort(spark, sf, 0.0).select(
        "user_id", "c_name", "weight", "height", F.round("bmi", 2).alias("bmi"), "starttime",
        "endtime", F.round(F.round("duration_hours", 9), 2).alias("duration_hours"))


def ids(spark, sf):
    return (table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
            .orderBy("id"))


# --- extraction ----------------------------------------------------------------------------

def interval_extract(spark, sf):
    """Events inside the longest episode of their user."""
    found = event_episodes(spark, sf)
    longest = best_event_per_entity(found.drop("ventnum"), "user_id", "duration_hours",
                                    "starttime", "starttime")
    return extract_interval(longest, events(spark, sf).select("event_id", "user_id", *LONG), USER,
                            "ts", "starttime", "endtime")


def interval_union(spark, sf):
    """Lines of an order, and orders of its customer, inside the order's window."""
    orders = table(spark, sf, "orders")
    windows = orders.select(
        F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").alias("start"),
        F.timestamp_add("DAY", F.lit(cfg.WINDOW_DAYS), F.col("o_orderdate")).alias("stop"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay"), F.col("l_shipdate").alias("at"),
        F.lit("quantity").alias("channel"), F.col("l_quantity").alias("value"))
    own = extract_interval(windows.select("stay", "start", "stop"), lines, ["stay"], "at", "start",
                           "stop")
    bought = orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("at"),
                           F.lit("price").alias("channel"), F.col("o_totalprice").alias("value"))
    others = extract_interval(windows, bought, ["subject"], "at", "start", "stop", keep=["stay"])
    return own.select("stay", "at", "channel", "value").unionByName(
        others.select("stay", "at", "channel", "value"))


# --- the intensive-care preset over events read as charted items ------------------------------

def _coded(spark, sf, codes) -> DataFrame:
    """Events as charted items: code and text are dealt out in turn."""
    turn = F.col("event_id")
    item = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in codes]),
                        (turn % len(codes) + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(t) for t in cfg.CHART_TEXTS]),
                        (F.call_function("div", turn, F.lit(7)) % len(cfg.CHART_TEXTS) + 1)
                        .cast("int"))
    return events(spark, sf).select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
        F.col("user_id").alias("icustay_id"), F.col("ts").alias("charttime"),
        item.alias("itemid"), text.alias("value"), F.col("value").alias("valuenum"),
        F.when(F.col("value") > 200, 1).when(F.col("value") >= 5, 0).alias("error"))


def icu_chart(spark, sf):
    """Labelled chart and lab values inside the longest episode of each user."""
    longest = best_event_per_entity(event_episodes(spark, sf).drop("ventnum"), "user_id",
                                    "duration_hours", "starttime", "starttime")
    people = longest.select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
        F.col("user_id").alias("icustay_id"), F.col("starttime").alias("vent_start"),
        F.col("endtime").alias("vent_end"))
    labs = events(spark, sf).select(
        F.col("user_id").alias("subject_id"), F.col("ts").alias("charttime"),
        F.when(F.col("event_type") == "signup", 50821).otherwise(0).cast("bigint")
        .alias("itemid"), F.col("value").alias("valuenum"))
    out = chart_data(people, _coded(spark, sf, cfg.CHART_CODES), labs)
    return out.withColumn("valuenum", r6("valuenum"))


def icu_status(spark, sf):
    done = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("icustay_id"), F.col("o_orderdate").alias("starttime"),
        F.when(F.col("o_orderstatus") == "F", 227194).when(F.col("o_orderstatus") == "P", 225468)
        .otherwise(0).cast("bigint").alias("itemid"))
    return ventilation_status(_coded(spark, sf, cfg.STATUS_CODES), done)


def icu_body(spark, sf):
    return body_measures(_coded(spark, sf, cfg.BODY_CODES)).withColumn("bmi", r6("bmi"))


# --- series --------------------------------------------------------------------------------

def collapse_dupes(spark, sf):
    out = sr.collapse(table(spark, sf, "lineitem"), ["l_orderkey", "l_shipdate"], "l_quantity",
                      ["l_returnflag", "l_linenumber"])
    return _rounded(out, ["l_quantity"])


def densify(spark, sf):
    return sr.densify(long_events(spark, sf), USER, *LONG, cfg.CHANNELS)


def _imputed(spark, sf):
    return sr.impute(long_events(spark, sf), USER, *LONG, cfg.CHANNELS)


def interpolate(spark, sf):
    return _rounded(_imputed(spark, sf), ["value"])


def fill(spark, sf):
    wide = sr.grid(long_events(spark, sf), USER, *LONG, cfg.CHANNELS)
    full = sr.interpolate(wide, USER, "ts", [], cfg.CHANNELS)
    return sr.melt(full, ["user_id", "ts"], cfg.CHANNELS, "event_type", "value")


def channel_sum(spark, sf):
    out = sr.derive_sum(settle(_imputed(spark, sf)), USER, *LONG, ["click", "error", "view"], "total")
    return _rounded(out, ["value"])


def channel_ratio(spark, sf):
    out = sr.derive_ratio_product(settle(_imputed(spark, sf)), USER, *LONG, "click", "view", 1000.0,
                                  ("ratio", "product"))
    return _rounded(out, ["value"])


def channel_series(spark, sf):
    return sr.channel_series(events(spark, sf), "user_id", *LONG, wanted="click")


def series_order(spark, sf):
    """The series with the place of each point in its user's time order."""
    return sr.in_time_order(channel_series(spark, sf), "user_id", "ts")


def markers(spark, sf):
    return sr.series_markers(events(spark, sf), "user_id", "ts")


def channels(spark, sf):
    lists = stay_channels(events(spark, sf), "user_id", "event_type")
    return lists.select("user_id", F.concat_ws(",", "channels").alias("channels"))


# --- segments and features -----------------------------------------------------------------

def _limits(spark, sf):
    spans = sr.series_markers(events(spark, sf), "user_id", "ts")
    return segment_limits(spans, USER, "first_ts", "last_ts", cfg.SEG_HOURS)


def segments(spark, sf):
    return _limits(spark, sf)


def zoh(spark, sf):
    return sr.step_points(_limits(spark, sf), "seg_start_time", "seg_end_time")


def snap(spark, sf):
    return nearest_snap(long_events(spark, sf), USER, *LONG, cfg.SEG_HOURS)


def raw_features(spark, sf):
    """Each channel on its own times, so limits move per channel."""
    out = segment_features(long_events(spark, sf), USER, *LONG, cfg.CHANNELS, cfg.SEG_HOURS,
                           cfg.STATS)
    return _rounded(out, ft.feature_names(cfg.CHANNELS, cfg.STATS))


def repeated_times(spark, sf):
    """Segments over rows that repeat a time: an order's lines by their ship date."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", F.col("l_shipdate").cast("timestamp_ntz").alias("at"),
        F.col("l_quantity").cast("double").alias("l_quantity"))
    out = segment_features(lines, ["l_orderkey"], "l_returnflag", "at", "l_quantity",
                           cfg.RETURN_FLAGS, cfg.LINE_SEG_HOURS, ["mean", "median", "mode"])
    return _rounded(out, ft.feature_names(cfg.RETURN_FLAGS, ["mean", "median", "mode"]))


def derived_channels():
    scaled = F.col("view") / F.lit(1000.0)
    return [("click", F.col("error") + F.col("signup"), 1),
            ("ratio", F.try_divide(F.col("purchase"), scaled), 0),
            ("product", F.col("purchase") * scaled, 0)]


def _features(spark, sf, max_segments=None):
    return tb.feature_table(long_events(spark, sf), USER, *LONG, cfg.CHANNELS, derived_channels(),
                            cfg.SEG_HOURS, cfg.STATS, max_segments,
                            mode_decimals=cfg.MODE_DECIMALS)


def _names():
    return ft.feature_names(cfg.FEATURE_CHANNELS, cfg.STATS)


def filled_features(spark, sf):
    return _rounded(_features(spark, sf), _names())


def spread_stats(spark, sf):
    """Median and mode of a few groups that each hold a large part of all rows."""
    rows = long_events(spark, sf)
    found = spread_median(rows, ["event_type"], "value").join(
        spread_mode(rows, ["event_type"], "value"), "event_type")
    return _rounded(found, ["median", "mode"])


def _mean_features(spark, sf):
    return segment_features(long_events(spark, sf), USER, *LONG, cfg.CHANNELS, cfg.SEG_HOURS,
                            ["mean", "std"])


MEAN_NAMES = ft.feature_names(cfg.CHANNELS, ["mean", "std"])
FEATURE_KEYS = ["label", "user_id", "seg_start_time", "seg_end_time"]


def label_means(spark, sf):
    return _rounded(ft.label_means(_mean_features(spark, sf), MEAN_NAMES), MEAN_NAMES)


def label_counts(spark, sf):
    return ft.label_counts(_mean_features(spark, sf), MEAN_NAMES)


def population_mean(spark, sf):
    return _rounded(ft.population_mean(_mean_features(spark, sf), MEAN_NAMES), ["mean"])


def sparse_select(spark, sf):
    near = ft.nearest_segments(_mean_features(spark, sf), cfg.TOTAL_HOURS, cfg.SEG_HOURS)
    return ft.share_dense(near, MEAN_NAMES)


def mean_fill(spark, sf):
    features = settle(_mean_features(spark, sf))
    near = ft.nearest_segments(features, cfg.TOTAL_HOURS, cfg.SEG_HOURS)
    means = ft.population_mean(features, MEAN_NAMES)
    return _rounded(ft.align_and_fill(near, FEATURE_KEYS, MEAN_NAMES, means), MEAN_NAMES)


def label_fill(spark, sf):
    features = settle(_mean_features(spark, sf))
    return _rounded(ft.fill_by_label(features, FEATURE_KEYS, MEAN_NAMES), MEAN_NAMES)


def _training(spark, sf):
    features = settle(_features(spark, sf))
    return tb.training_table(features, _names(), cfg.TOTAL_HOURS, cfg.SEG_HOURS, FEATURE_KEYS)


def training_table(spark, sf):
    """Training table in long form, so that the columns do not depend on the data."""
    filled, _, kept = _training(spark, sf)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), r6(n).alias("value")) for n in kept])
    return filled.select(*FEATURE_KEYS, F.inline(pairs))


def scoring_table(spark, sf):
    _, means, kept = _training(spark, sf)
    scored = tb.scoring_table(long_events(spark, sf), means, kept, USER, *LONG, cfg.CHANNELS,
                              derived_channels(), cfg.SEG_HOURS, cfg.TOTAL_HOURS / 2, cfg.STATS,
                              mode_decimals=cfg.MODE_DECIMALS)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), r6(n).alias("value")) for n in kept])
    return scored.select(*FEATURE_KEYS, F.inline(pairs))


# --- models --------------------------------------------------------------------------------

def split_key(column: str) -> Column:
    mixed = F.col(column) * F.lit(cfg.SPLIT_MULTIPLIER) % F.lit(cfg.SPLIT_PRIME)
    return mixed * F.lit(1 << 31).cast("bigint")


def stratified_split(spark, sf):
    return md.stratified_split(table(spark, sf, "labels"), "quality", split_key("doc_id"))


def eval_report(spark, sf):
    out = md.class_report(table(spark, sf, "labels"), "quality", "toxic")
    return _rounded(out, ["precision", "recall", "f1"])


def eval_summary(spark, sf):
    out = md.summary_report(table(spark, sf, "labels"), "quality", "toxic")
    return _rounded(out, ["accuracy", "macro_precision", "macro_recall", "weighted_precision"])


def risk_query(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("y_pred"))
    return _rounded(risk(lines, ["l_orderkey"]), ["ser_risk"])


def _mixed_key() -> Column:
    mixed = (F.col("user_id") * 1000 + F.col("label")) * F.lit(cfg.SPLIT_MULTIPLIER)
    return mixed % F.lit(cfg.SPLIT_PRIME) * F.lit(1 << 31).cast("bigint")


def _search_folder(spark, sf, name, **params) -> str:
    """Where a search over these input files keeps its scores; a lost run goes on there."""
    return st.cache_path(spark, f"{shared_dir(spark)}/searches", name,
                         {"stats": cfg.STATS, "hours": [cfg.SEG_HOURS, cfg.TOTAL_HOURS], **params},
                         [f"{sf}/events.parquet"])


def _split_training(spark, sf):
    """Training and test part with folds, and the feature names; built once for given files."""
    def build():
        filled, _, _ = _training(spark, sf)
        keyed = settle(md.stratified_split(settle(filled), "label", _mixed_key(), ties=["user_id"]))
        parts = sc.fold_of(keyed.filter("is_test = 0"), "label", _mixed_key(), cfg.FOLDS, ties=["user_id"])
        return parts.unionByName(keyed.filter("is_test = 1").withColumn("fold", F.lit(-1)))
    rows = st.cached(spark, f"{shared_dir(spark)}/searches", "training",
                     {"stats": cfg.STATS, "hours": [cfg.SEG_HOURS, cfg.TOTAL_HOURS], "folds": cfg.FOLDS},
                     build, [f"{sf}/events.parquet"])
    kept = [n for n in _names() if n in rows.columns]
    return rows.filter("is_test = 0"), rows.filter("is_test = 1"), kept


def _candidates(scores, names):
    """What any search must give: its candidates, sound scores of each fold and one best."""
    top = Window.partitionBy(F.lit(1))  # as many rows as candidates
    sound = (F.col("low") >= 0) & (F.col("low") <= F.col("mean") + 1e-12) & (F.col("mean") <= F.col("high") + 1e-12)
    return sc.summary(scores).select(
        "candidate", *[F.get_json_object("params", f"$.{n}").cast(kind).alias(c) for c, (n, kind) in names.items()],
        "folds", (sound & (F.col("high") <= 1)).alias("in_range"),
        F.col("two_std").between(0, F.col("high") - F.col("low") + 1e-12).alias("has_spread"),
        F.sum("best").over(top).alias("n_best"),
        ((F.col("best") == 0) | (F.col("mean") == F.max("mean").over(top))).alias("best_is_top"))


def _forest_scores(spark, sf):
    train, _, kept = _split_training(spark, sf)
    folder = _search_folder(spark, sf, "forest")
    return sc.forest_search(train, kept, "label", "fold", folder), folder


def rf_train(spark, sf):
    """The whole grid over random forests: candidates and checks of their fold scores."""
    scores, _ = _forest_scores(spark, sf)
    return _candidates(scores, {"max_depth": ("depth", "int"), "num_trees": ("trees", "int")})


def _boosted(grid, names):
    def query(spark, sf):
        train, _, kept = _split_training(spark, sf)
        score, base, values = sc.BOOSTED[grid]
        scores = sc.boosted_search(train, kept, "label", _mixed_key(), "fold",
                                   _search_folder(spark, sf, grid), base, values, score)
        return _candidates(scores, names)
    query.__doc__ = f"The whole grid {grid} over boosted trees: candidates and checks of their fold scores."
    return query


gbt_train = _boosted("boost_rounds", {"max_iter": ("rounds", "int")})
boost_shape = _boosted("boost_shape", {"max_depth": ("depth", "int"), "min_split": ("min_split", "int"),
                                       "min_leaf": ("min_leaf", "int")})
boost_sample = _boosted("boost_sample", {"subsample": ("subsample", "double")})
boost_rate = _boosted("boost_rate", {"rate": ("rate", "double"), "max_iter": ("rounds", "int")})


def _best_forest(spark, sf):
    """Best forest of the search, refitted on all training rows, with the test part and the names."""
    train, test, kept = _split_training(spark, sf)
    scores, folder = _forest_scores(spark, sf)
    best = json.loads(sc.summary(scores).filter("best = 1").first()["params"])
    return PipelineModel([sc.refit_forest(train, kept, "label", folder, best)]), test, kept


def score(spark, sf):
    """Score the test part; are the labels known, and is the risk that of the predictions?"""
    model, test, _ = _best_forest(spark, sf)
    scored = settle(tb.score(model, test, USER))
    own = Window.partitionBy("user_id")
    low, top = F.min("y_pred").over(own), F.max("y_pred").over(own)
    again = F.when(low < top, (F.log(top) - F.log("y_pred")) / (F.log(top) - F.log(low)))
    return scored.select(
        "user_id", "seg_start_time", "seg_end_time", "y_true",
        F.col("y_pred").between(1, cfg.TOTAL_HOURS // cfg.SEG_HOURS).alias("known_label"),
        r6("ser_risk").eqNullSafe(r6(again)).alias("own_risk"))


def score_report(spark, sf):
    """Supports of the test part by class, and whether the report is that of the confusion."""
    model, test, _ = _best_forest(spark, sf)
    predicted = settle(md.predict(model, test))
    pairs = md.confusion(predicted, "label", "y_pred")
    true, named = (pairs.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(n))
                   for c, n in (("y_true", "rows"), ("y_pred", "named")))
    hits = pairs.filter("y_true = y_pred").select(F.col("y_true").alias("class"), F.col("n").alias("hits"))
    report = (md.class_report(predicted, "label", "y_pred").join(true, "class", "left")
              .join(named, "class", "left").join(hits, "class", "left").na.fill(0, ["rows", "named", "hits"]))
    total = Window.partitionBy(F.lit(1))  # as many rows as classes
    return report.select(
        "class", "support", F.sum("named").over(total).alias("predicted"),
        (F.abs(F.col("precision") * F.col("named") - F.col("hits")) < 1e-6).alias("precision_fits"),
        (F.abs(F.col("recall") * F.col("rows") - F.col("hits")) < 1e-6).alias("recall_fits"),
        (F.col("support") == F.col("rows")).alias("support_fits"))


def top_features(spark, sf):
    """Ranks of the most important features: known names, shares that never grow."""
    model, _, kept = _best_forest(spark, sf)
    best = md.importance(model, kept, spark, 20)
    order = Window.orderBy(F.desc("importance"), "feature")  # 20 rows
    return best.select(
        F.row_number().over(order).alias("rank"), F.col("feature").isin(kept).alias("known"),
        F.col("importance").between(0, 1).alias("in_range"))


# --- sources -------------------------------------------------------------------------------

def _signals(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in ("ABPSys", "NBP SYS", "RESP", "%SpO2",
                                                      "HR")]),
                         F.col("label") % 5 + 1)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("record"), names.alias("channel"),
        F.lit("2024-01-01").cast("date").alias("base_date"), F.lit("00:00:00").alias("base_time"),
        F.lit(cfg.SIGNAL_FS).alias("fs"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


def signal_rows(spark, sf):
    out = sg.timed_samples(_signals(spark, sf), ["record"], sg.record_start("base_date",
                                                                            "base_time"),
                           "fs", "samples", "channel")
    return _rounded(out, ["value"])


def signal_wide(spark, sf):
    wide = sg.expand_signals(
        _signals(spark, sf), ["record"], sg.record_start("base_date", "base_time"), "fs",
        "samples", "channel", ("ABPSys", "NBP SYS", "RESP", "%SpO2", "HR"),
        {"SBP": ("ABPSys", "NBP SYS"), "RR": ("RESP",), "SpO2": ("SpO2", "%SpO2")})
    return _rounded(wide, ["HR", "SBP", "RR", "SpO2"])


def record_lookup(spark, sf):
    found = sg.parse_records(table(spark, sf, "pages"), cfg.URL_PATTERN, "url", "host", "number")
    return found.select("page_id", "host",
                        st.padded_id("p", F.col("number").cast("bigint")).alias("record"))


def param_sql(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("tidemark_events")
    return st.query_with(
        spark,
        "SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM IDENTIFIER(:t) "
        "WHERE ts BETWEEN :start AND :stop GROUP BY user_id",
        {"t": "tidemark_events", "start": "2024-01-05 00:00:00", "stop": "2024-01-20 00:00:00"})


def ensure_table(spark, sf):
    folder = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    name = "tidemark_flags"
    st.ensure_table(spark, name, lambda: event_flags(spark, sf), rebuild=True, path=folder)
    return st.ensure_table(spark, name, lambda: event_flags(spark, sf))


def table_schema(spark, sf):
    """Columns of a stored table, without rows."""
    name = f"tidemark_schema_{uuid.uuid4().hex}"
    st.ensure_table(spark, name, lambda: long_events(spark, sf), path=f"{shared_dir(spark)}/tables/{name}")
    return st.empty_like(spark, name)


def read_inputs(spark, sf):
    """Charted and lab inputs stored under their declared schemas and read as inputs."""
    folder = f"{shared_dir(spark)}/inputs/{uuid.uuid4().hex}"
    rows = events(spark, sf).select(
        F.col("user_id").alias("subject_id"), F.col("event_id").alias("hadm_id"), F.col("event_id").alias("icustay_id"),
        F.col("ts").cast("timestamp_ntz").alias("charttime"), F.length("event_type").cast("bigint").alias("itemid"),
        F.col("event_type").alias("value"), F.col("value").alias("valuenum"), F.lit(0).alias("error"))
    rows.write.parquet(f"{folder}/chartevents")
    rows.filter("valuenum > 10").select("subject_id", "charttime", "itemid", "valuenum").write.parquet(f"{folder}/labevents")
    charted = st.read_input(spark, "chartevents", f"{folder}/chartevents")
    labs = st.read_input(spark, "labevents", f"{folder}/labevents")
    return charted.select("subject_id", "charttime", "itemid", "valuenum", F.lit("chart").alias("source")).unionByName(
        labs.withColumn("source", F.lit("lab")))


def stored_features(spark, sf):
    """Features written by training and read by another run."""
    path = f"{shared_dir(spark)}/features/{uuid.uuid4().hex}"
    st.save_table(_mean_features(spark, sf), path)
    return _rounded(st.load_table(spark, path), MEAN_NAMES)


def stored_means(spark, sf):
    """Means written by training; scoring aligns and fills its segments by them."""
    path = f"{shared_dir(spark)}/means/{uuid.uuid4().hex}"
    features = settle(_mean_features(spark, sf))
    st.save_table(ft.population_mean(features, MEAN_NAMES), path)
    near = ft.nearest_segments(features, cfg.TOTAL_HOURS / 2, cfg.SEG_HOURS)
    return _rounded(ft.align_and_fill(near, FEATURE_KEYS, MEAN_NAMES, st.load_table(spark, path)), MEAN_NAMES)


def renamed_channels(spark, sf):
    """Wide channels under new names, several sources of one name in order of priority."""
    wide = events(spark, sf).groupBy("user_id").pivot("event_type", cfg.CHANNELS).agg(F.max("value"))
    return rename_channels(wide, {"pulse": ("click", "view"), "left": ("signup",), "none": ("absent",)})


def cached(spark, sf):
    folder = f"{shared_dir(spark)}/cache/{uuid.uuid4().hex}"
    params = {"gap": cfg.GAP_HOURS, "sf": sf}
    files = [f"{sf}/events.parquet"]
    st.cached(spark, folder, "markers", params, lambda: markers(spark, sf), files)
    return st.cached(spark, folder, "markers", params, lambda: markers(spark, sf), files)


def one_user(spark, sf):
    """Rows of one entity, by a predicate that reaches the scan."""
    return entity_rows(long_events(spark, sf), "user_id", cfg.ONE_USER)


def bucket_store(spark, sf):
    path = f"{shared_dir(spark)}/buckets/{uuid.uuid4().hex}"
    st.write_by_bucket(long_events(spark, sf), path, "user_id", 16)
    return spark.read.parquet(path).select("user_id", *LONG)


def clustered_store(spark, sf):
    """Positions in time order, swept over a table that is clustered for it."""
    name = f"tidemark_clustered_{uuid.uuid4().hex}"
    rows = st.write_clustered(events(spark, sf).select("event_id", "user_id", "ts"), name,
                              f"{shared_dir(spark)}/tables/{name}", USER, "ts", buckets=8)
    return sweep(rows, USER, ["ts", "event_id"], position="position").select("event_id", "user_id", "position")


def item_dimension(spark, sf):
    """Parts written as CSV in the item layout and read back with its schema."""
    path = f"{shared_dir(spark)}/items/{uuid.uuid4().hex}"
    (table(spark, sf, "part").select(
        F.col("p_partkey").alias("itemid"),
        F.concat_ws(", ", "p_name", "p_type").alias("label"), F.col("p_brand").alias("LEVEL1"),
        F.col("p_type").alias("LEVEL2"), F.col("p_retailprice").alias("mean"),
        F.col("p_size").cast("double").alias("stdev"),
        F.lit(None).cast("double").alias("missing percent"))
     .write.csv(path, header=True, escape='"'))
    return st.read_items(spark, path)


def hours_between(spark, sf):
    """Completed hours from each user's first event."""
    joined = events(spark, sf).join(markers(spark, sf), "user_id")
    return joined.select("event_id", whole_hours(F.col("first_ts"), F.col("ts")).alias("hours"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rule_label": rule_label,
    "repair_nested": repair_nested,
    "null_safe_exclude": null_safe_exclude,
    "status_flags": event_flags,
    "flag_union": flag_union,
    "episodes": episodes_query,
    "episode_marks": episode_marks_query,
    "first_value_pivot": first_value_query,
    "nearest_end": nearest_end,
    "asof_nearest": asof_nearest,
    "asof_backward": asof_backward,
    "best_per_key": best_per_key,
    "repeated_keys": repeated,
    "cohort": cohort,
    "summary": summary,
    "ids": ids,
    "interval_extract": interval_extract,
    "interval_union": interval_union,
    "icu_chart": icu_chart,
    "icu_status": icu_status,
    "icu_body": icu_body,
    "collapse_dupes": collapse_dupes,
    "densify": densify,
    "interpolate": interpolate,
    "fill": fill,
    "channel_sum": channel_sum,
    "channel_ratio": channel_ratio,
    "channel_series": channel_series,
    "series_order": series_order,
    "markers": markers,
    "channels": channels,
    "segments": segments,
    "zoh": zoh,
    "nearest_snap": snap,
    "segment_features": raw_features,
    "segment_repeats": repeated_times,
    "filled_features": filled_features,
    "spread_stats": spread_stats,
    "label_means": label_means,
    "label_counts": label_counts,
    "population_mean": population_mean,
    "sparse_select": sparse_select,
    "mean_fill": mean_fill,
    "label_fill": label_fill,
    "training_table": training_table,
    "scoring_table": scoring_table,
    "stratified_split": stratified_split,
    "eval_report": eval_report,
    "eval_summary": eval_summary,
    "risk": risk_query,
    "rf_train": rf_train,
    "score": score,
    "score_report": score_report,
    "top_features": top_features,
    "signal_rows": signal_rows,
    "signal_wide": signal_wide,
    "record_lookup": record_lookup,
    "param_sql": param_sql,
    "ensure_table": ensure_table,
    "table_schema": table_schema,
    "read_inputs": read_inputs,
    "stored_features": stored_features,
    "stored_means": stored_means,
    "renamed_channels": renamed_channels,
    "cached": cached,
    "one_user": one_user,
    "bucket_store": bucket_store,
    "clustered_store": clustered_store,
    "item_dimension": item_dimension,
    "hours_between": hours_between,
}

# Grids that take minutes each; kept apart so that a run can have them last.
SEARCHES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gbt_train": gbt_train,
    "boost_sample": boost_sample,
    "boost_rate": boost_rate,
    "boost_shape": boost_shape,
}
