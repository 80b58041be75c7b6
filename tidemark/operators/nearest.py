"""Match special end events to episode ends, and reduce to one event per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_seconds, int_div, micros_between, whole_hours
from .sweep import sweep, with_chunk


def _distance_floor(events: DataFrame, ends: DataFrame, entity: str, ts: str,
                    chunk_hours: float) -> DataFrame:
    """Smallest whole-hour distance between any event and any end, per entity.

    Only neighbours in time can be closest, so events and ends are merged in one
    ordered sequence and each row looks back to the latest row of the other kind.
    """
    merged = (events.select(entity, F.col(ts).alias("_t"), F.lit(0).alias("_is_end"))
              .unionByName(ends.select(entity, F.col(ts).alias("_t"), F.lit(1).alias("_is_end")))
              .distinct())
    looked = sweep(
        with_chunk(merged, "_t", chunk_hours), [entity], ["_t", "_is_end"],
        before={"_event": F.when(F.col("_is_end") == 0, F.col("_t")),
                "_end": F.when(F.col("_is_end") == 1, F.col("_t"))})
    other = F.when(F.col("_is_end") == 1, F.col("_event")).otherwise(F.col("_end"))
    return (looked.withColumn("_d", F.abs(whole_hours(other, F.col("_t"))))
            .groupBy(entity).agg(F.min("_d").alias("_floor"))
            .filter(F.col("_floor").isNotNull()))


def nearest_end_events(flags: DataFrame, episodes: DataFrame, entity: str, ts: str,
                       special: str, episode_cols: Sequence[str] = ("starttime", "endtime",
                                                                    "duration_hours"),
                       event_col: str = "se_charttime", chunk_hours: float = 24.0) -> DataFrame:
    """Pairs (special event, episode) at the entity's smallest whole-hour distance.

    The distance runs from the event to the episode's end; ties are all kept.
    Pairs of an entity are never enumerated: once its smallest distance is known,
    candidates meet only in the same or a neighbouring time cell of that size.
    """
    start, stop, hours = episode_cols
    events = (flags.filter((F.col(special) == 1) & F.col(entity).isNotNull())
              .select(entity, F.col(ts).alias(event_col)))
    floor = _distance_floor(events.select(entity, F.col(event_col).alias("_at")),
                            episodes.select(entity, F.col(stop).alias("_at")),
                            entity, "_at", chunk_hours)
    cell = int_div(epoch_seconds(F.col("_at")), (F.col("_floor") + 1) * 3600)
    left = (events.withColumn("_at", F.col(event_col)).join(floor, entity)
            .withColumn("_home", cell)
            .withColumn("_cell", F.explode(F.array(F.col("_home") - 1, F.col("_home"),
                                                   F.col("_home") + 1)))
            .drop("_at", "_home"))
    right = (episodes.select(entity, start, stop, hours).withColumn("_at", F.col(stop))
             .join(floor, entity).withColumn("_cell", cell).drop("_at", "_floor"))
    pairs = left.join(right, [entity, "_cell"])
    return (pairs.filter(F.abs(whole_hours(F.col(stop), F.col(event_col))) == F.col("_floor"))
            .select(entity, start, stop, event_col, hours, F.col("_floor").alias("se_diff")))


def best_event_per_entity(pairs: DataFrame, entity: str, duration: str, event: str,
                          stop: str) -> DataFrame:
    """One row per entity: longest duration, then the event soonest after the end.

    Events before the end rank last.  Remaining ties fall to the earlier event,
    then the earlier end.  A minimum over a ranking struct, so it combines before
    the shuffle and no entity is gathered.
    """
    late = micros_between(F.col(stop), F.col(event))
    late = F.when(late >= 0, late)
    rank = F.struct((-F.col(duration)).alias("d"), late.isNull().alias("none"),
                    F.coalesce(late, F.lit(0)).alias("late"), F.col(event).alias("e"),
                    F.col(stop).alias("s"))
    rest = [c for c in pairs.columns if c != entity]
    best = pairs.groupBy(entity).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(entity, "_best.*")


def repeated_keys(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Keys that occur in more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


