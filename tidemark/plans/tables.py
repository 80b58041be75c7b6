"""Training and scoring tables from long measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import risk
from ..operators import features as ft
from ..operators.model import predict
from ..operators.segments import segment_features
from ..operators.series import grid, interpolate
from ..operators.sweep import CHUNK
from ..presets import icu

KEYS = ("label", "icustay_id", "seg_start_time", "seg_end_time")


def icu_derived() -> list[tuple[str, Column, int]]:
    """Derived channels over the wide grid: (name, value, series number).

    The summed coma score has its own series number: a stay may also chart the
    total directly, and both then count.
    """
    total = F.col("GCSmotor") + F.col("GCSeye") + F.col("GCSverbal")
    out = [("GCStot", total, 1)]
    for kind in ("obs", "spot"):
        litres = F.col(f"VT{kind}") / F.lit(1000.0)
        out.append((f"RSBI{kind}", F.try_divide(F.col("RR"), litres), 0))
        out.append((f"VE{kind}", F.col("RR") * litres, 0))
    return out


def filled_series(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
                  channels: Sequence[str], derived: Sequence[tuple[str, Column, int]] = (),
                  chunk_hours: float = 24.0) -> DataFrame:
    """Imputed channels and derived ones, long, with the entity's first and last time.

    Derived channels are arithmetic on the wide grid, before it is unpivoted, so
    they cost no shuffle.
    """
    wide = interpolate(grid(long, entity, channel, ts, value, channels, (), chunk_hours),
                       entity, ts, list(channels))
    points = [F.struct(F.lit(c).alias(channel), F.lit(0).alias("_series"), F.col(c).alias(value))
              for c in channels]
    points += [F.struct(F.lit(n).alias(channel), F.lit(s).alias("_series"), v.alias(value))
               for n, v, s in derived]
    return (wide.select(*entity, CHUNK, ts, "_first_ts", "_last_ts",
                        F.explode(F.array(*points)).alias("_p"))
            .filter(F.col(f"_p.{value}").isNotNull())
            .select(*entity, ts, "_first_ts", "_last_ts", "_p.*"))


def feature_table(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
                  channels: Sequence[str], derived: Sequence[tuple[str, Column, int]] = (),
                  seg_hours: float = icu.SEG_HOURS, stats: Sequence[str] = icu.STATS,
                  max_segments: int | None = None, chunk_hours: float = 24.0,
                  mode_decimals: int | None = None) -> DataFrame:
    """Impute, derive, segment and summarise: one row per (entity, segment).

    Interpolated values may differ in their last bits; ``mode_decimals`` rounds them
    before the mode.
    """
    names = list(dict.fromkeys([*channels, *[n for n, _, _ in derived]]))
    filled = filled_series(long, entity, channel, ts, value, channels, derived, chunk_hours)
    return segment_features(filled, entity, channel, ts, value, names, seg_hours, stats,
                            max_segments, series="_series", mode_decimals=mode_decimals)


def training_table(features: DataFrame, names: Sequence[str], total_hours: float,
                   seg_hours: float, keys: Sequence[str] = KEYS, min_share: float = 2 / 3,
                   fill: str = "population") -> tuple[DataFrame, DataFrame, list[str]]:
    """Nearest segments with dense features only, gaps filled by means.

    Returns the table, the (feature, mean) table of the features kept, and their
    names.  Means are taken before the segments are cut off.  Pass stored features:
    they are read three times.
    """
    near = ft.nearest_segments(features, total_hours, seg_hours)
    kept = ft.dense_features(near, names, min_share)
    means = ft.population_mean(features, kept)
    if fill == "population":
        return ft.align_and_fill(near, keys, kept, means), means, kept
    own = (ft.nearest_segments(ft.label_means(features, kept), total_hours, seg_hours)
           .withColumnsRenamed({n: f"_m_{n}" for n in kept}))
    # One row per label, and no more labels than segments in total_hours.
    table = near.join(F.broadcast(own), "label").select(
        *keys, *[F.coalesce(n, f"_m_{n}").alias(n) for n in kept])
    return table, means, kept


def scoring_table(long: DataFrame, means: DataFrame | None, names: Sequence[str],
                  entity: Sequence[str], channel: str, ts: str, value: str,
                  channels: Sequence[str], derived: Sequence[tuple[str, Column, int]] = (),
                  seg_hours: float = icu.SEG_HOURS, total_hours: float = icu.SCORING_HOURS,
                  stats: Sequence[str] = icu.STATS, chunk_hours: float = 24.0,
                  mode_decimals: int | None = None) -> DataFrame | None:
    """Features of the last ``total_hours``, aligned to the trained names.

    None when there are no stored means.  Only the segments kept are computed.
    """
    if means is None:
        return None
    table = feature_table(long, entity, channel, ts, value, channels, derived, seg_hours, stats,
                          int(total_hours // seg_hours), chunk_hours, mode_decimals)
    return ft.align_and_fill(table, ["label", *entity, "seg_start_time", "seg_end_time"], names,
                             means)


def score(model, table: DataFrame | None, entity: Sequence[str]) -> DataFrame | None:
    """Predicted label and risk per segment, for all entities at once."""
    if model is None or table is None:
        return None
    predicted = predict(model, table)
    return risk(predicted, entity).select(
        *entity, "y_pred", "ser_risk", F.col("label").alias("y_true"), "seg_start_time",
        "seg_end_time")

