"""Interval extraction: the events of every entity inside its own time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_seconds, seconds_between


# Cell lengths of the interval index, in seconds: an hour, then four times the last; the
# longest spans more than all years that a timestamp can have.
CELLS = [3600 * 4 ** i for i in range(14)]


def _cell(at: Column, level: Column) -> Column:
    """Number of the cell of a level that holds a time."""
    length = F.element_at(F.lit(CELLS).cast("array<bigint>"), level + 1)
    return F.floor(epoch_seconds(at.cast("timestamp_ntz")) / length).cast("bigint")


def _level(start: Column, end: Column) -> Column:
    """The shortest cells that are as long as the window."""
    length = seconds_between(start, end)
    fits = F.lit(len(CELLS) - 1)
    for i in reversed(range(len(CELLS) - 1)):
        fits = F.when(length <= CELLS[i], i).otherwise(fits)
    return fits


def extract_interval(cohort: DataFrame, events: DataFrame, keys: Sequence[str], ts: str,
                     start: str, end: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Events with ``start <= ts <= end`` for the matching cohort row.

    Every window lies in cells of the level that fits its length, two at most.  A row probes
    one cell of each level that its own key has windows of, so both sides meet on the keys,
    the level and the cell: a key with many windows and many rows costs no pair of a window
    and a row that lie far apart, and a long or endless window changes nothing for the
    others.  Rows of keys without a window drop out first.  No job runs while the plan is
    built, and no broadcast is forced.  Windows without a limit, and those that end before
    they start, hold no row.
    """
    windows = (cohort.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to"),
                             *[c for c in (keep or []) if c not in keys])
               .filter(F.col("_from") <= F.col("_to")).withColumn("_level", _level(F.col("_from"), F.col("_to"))))
    used = windows.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    spread = windows.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_from"), F.col("_level")),
                                                              _cell(F.col("_to"), F.col("_level")))))
    probes = (events.join(used, list(keys)).withColumn("_level", F.explode("_levels")).drop("_levels")
              .withColumn("_cell", _cell(F.col(ts), F.col("_level"))))
    inside = F.col(ts).between(F.col("_from"), F.col("_to"))
    return probes.join(spread, [*keys, "_level", "_cell"]).filter(inside).drop("_from", "_to", "_level", "_cell")


def join_dimension(df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Left join that keeps every row of ``df`` and adds some dimension columns."""
    return df.join(dim.select(key, *cols), key, "left")


def entity_rows(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one entity; the predicate is pushed to the scan."""
    return df.filter(F.col(key) == F.lit(value))
