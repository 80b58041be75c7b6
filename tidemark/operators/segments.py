"""Backward segments with snapped, shared boundaries, and their statistics.

Segment ``j`` of an entity covers ``[last - j*L, last - (j-1)*L]``; each limit is
moved to the channel's nearest time (the earlier on a tie) and the segment holds
all rows between its moved limits, both included.

Rows are not compared with boundaries.  Cut the time before ``last`` into cells
of length L: every row of a non-empty cell c lies inside segment c, whatever the
snapping does, and the only rows a segment can share with others are those at the
first and last time of a cell.  So a row's label is arithmetic, the moved limits
follow from the first and last time of each cell, and only rows at a limit are
looked up, by their time: all of them, however many share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import stat
from ..functions.times import HOUR_MICROS, int_div, micros_between, shift_micros
from .order_stats import spread_median, spread_mode
from .sweep import sweep, with_chunk


def with_span(long: DataFrame, entity: Sequence[str], ts: str,
              chunk_hours: float = 24.0) -> DataFrame:
    """Add the entity's first and last time to every row."""
    return sweep(with_chunk(long, ts, chunk_hours), entity, [ts],
                 facts={"_first_ts": ("min", F.col(ts)), "_last_ts": ("max", F.col(ts))})


def segment_limits(spans: DataFrame, entity: Sequence[str], first: str, last: str,
                   seg_hours: float, max_segments: int | None = None) -> DataFrame:
    """Unmoved segments per entity: label, seg_start_time, seg_end_time.

    Label 1 ends at the last time; segments go back while their end lies after
    the first time, so a single-time entity has none.
    """
    length = int(seg_hours * HOUR_MICROS)
    count = _segment_count(F.col(first), F.col(last), length)
    if max_segments is not None:
        count = F.least(count, F.lit(max_segments).cast("bigint"))
    numbered = (spans.withColumn("_k", count).filter(F.col("_k") > 0)
                .withColumn("label", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k")))))
    return numbered.select(
        *entity, F.col("label").cast("int").alias("label"),
        _limit(F.col(last), F.col("label"), length).alias("seg_start_time"),
        _limit(F.col(last), F.col("label") - 1, length).alias("seg_end_time"))


def _segment_count(first: Column, last: Column, length: int) -> Column:
    return int_div(micros_between(first, last) + (length - 1), length)


def _limit(last: Column, j: Column, length: int) -> Column:
    return shift_micros(last, -j.cast("bigint") * F.lit(length).cast("bigint"))


def _nearer(limit: Column, earlier: Column, later: Column) -> Column:
    """The closer candidate; a tie goes to the earlier one."""
    closer = micros_between(earlier, limit) <= micros_between(limit, later)
    return (F.when(later.isNull(), earlier).when(earlier.isNull(), later)
            .when(closer, earlier).otherwise(later))


def snapped_cells(spanned: DataFrame, entity: Sequence[str], channel: str, ts: str,
                  seg_hours: float, series: str | None = None,
                  max_segments: int | None = None) -> DataFrame:
    """Per (entity, channel, label): unmoved and moved limits.

    Only non-empty cells are shuffled.  Each one sees its two non-empty
    neighbours and emits its own label and those of the empty cells behind it
    (the latest cell also those before it), for which the neighbours are the
    only candidates.
    """
    length = int(seg_hours * HOUR_MICROS)
    keys = [*entity, channel, *([series] if series else [])]
    cells = (spanned.withColumn("_c", _cell(ts, length))
             .groupBy(*keys, "_first_ts", "_last_ts", "_c")
             .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    along = Window.partitionBy(*keys).orderBy("_c")
    seen = cells.select(
        *keys, "_first_ts", "_last_ts", "_c", "_lo", "_hi",
        F.lag("_lo").over(along).alias("_lo_nearer"), F.lead("_hi").over(along).alias("_hi_farther"),
        F.lag("_c").over(along).alias("_c_nearer"), F.lead("_c").over(along).alias("_c_farther"))
    top = _segment_count(F.col("_first_ts"), F.col("_last_ts"), length)
    if max_segments is not None:
        top = F.least(top, F.lit(max_segments).cast("bigint"))
    one = F.lit(1).cast("bigint")
    from_ = F.when(F.col("_c_nearer").isNull(), one).otherwise(F.col("_c"))
    to = F.least(top, F.coalesce(F.col("_c_farther") - 1, top))
    labelled = (seen.withColumn("_from", from_).withColumn("_to", to)
                .filter(F.col("_from") <= F.col("_to"))
                .withColumn("label", F.explode(F.sequence("_from", "_to"))))
    j, c = F.col("label"), F.col("_c")
    none = F.lit(None).cast(seen.schema["_lo"].dataType)
    candidates = {
        "start": (F.when(j < c, F.col("_hi")).otherwise(F.col("_hi_farther")),
                  F.when(j < c, none).otherwise(F.col("_lo"))),
        "end": (F.when(j > c, F.col("_hi_farther")).otherwise(F.col("_hi")),
                F.when(j > c, F.col("_lo")).when(j < c, none).otherwise(F.col("_lo_nearer"))),
    }
    limits = labelled.select(
        *keys, j.cast("int").alias("label"),
        _limit(F.col("_last_ts"), j, length).alias("seg_start_time"),
        _limit(F.col("_last_ts"), j - 1, length).alias("seg_end_time"),
        *[x.alias(f"_{side}_{when}") for side, pair in candidates.items()
          for when, x in zip(("earlier", "later"), pair)])
    moved = [_nearer(F.col(f"seg_{side}_time"), F.col(f"_{side}_earlier"),
                     F.col(f"_{side}_later")).alias(f"{side}_ts") for side in candidates]
    return limits.select(*keys, "label", "seg_start_time", "seg_end_time", *moved)


def _cell(ts: str, length: int) -> Column:
    return int_div(micros_between(F.col(ts), F.col("_last_ts")), length) + 1


def nearest_snap(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
                 seg_hours: float, chunk_hours: float = 24.0) -> DataFrame:
    """Segment limits and the nearest existing times they move to."""
    spanned = with_span(long, entity, ts, chunk_hours)
    return snapped_cells(spanned, entity, channel, ts, seg_hours).select(
        *entity, channel, "label", "seg_start_time", "seg_end_time", "start_ts", "end_ts")


def segment_members(spanned: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
                    seg_hours: float, max_segments: int | None = None,
                    series: str | None = None) -> DataFrame:
    """One row per (row, segment that covers it), with unmoved segment limits.

    Rows that share a boundary time belong to the same segments, all of them.
    """
    length = int(seg_hours * HOUR_MICROS)
    keys = [*entity, channel, *([series] if series else [])]
    top = _segment_count(F.col("_first_ts"), F.col("_last_ts"), length)
    if max_segments is not None:
        top = F.least(top, F.lit(max_segments).cast("bigint"))
    out = [*keys, "label", "seg_start_time", "seg_end_time", ts, value]
    label = F.col("label")
    own = (spanned.withColumn("label", _cell(ts, length)).filter(label <= top)
           .withColumn("seg_start_time", _limit(F.col("_last_ts"), label, length))
           .withColumn("seg_end_time", _limit(F.col("_last_ts"), label - 1, length))
           .withColumn("label", label.cast("int")).select(*out))
    limits = snapped_cells(spanned, entity, channel, ts, seg_hours, series, max_segments)
    low_outside = F.col("start_ts") <= F.col("seg_start_time")
    high_outside = ((F.col("end_ts") > F.col("seg_end_time"))
                    | (F.col("end_ts") <= F.col("seg_start_time")))
    low_above = F.col("start_ts") > F.col("seg_end_time")
    shared = F.array(
        F.struct((low_outside | low_above).alias("out"), F.col("start_ts").alias("t")),
        F.struct((high_outside & (F.col("end_ts") != F.col("start_ts"))).alias("out"),
                 F.col("end_ts").alias("t")))
    points = limits.withColumn("_p", F.explode(shared)).filter("_p.out").select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_p.t").alias("_p_t"), "label",
        "seg_start_time", "seg_end_time")
    same = F.col(ts) == F.col("_p_t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    # Never by broadcast: before the run Spark takes rows that were exploded for as few as their source.
    borrowed = spanned.select(*keys, ts, value).hint("merge").join(points, same).select(*out)
    return own.unionByName(borrowed)


def segment_stats(members: DataFrame, entity: Sequence[str], channel: str, value: str,
                  stats: Sequence[str], spread: bool = False,
                  mode_decimals: int | None = None, spread_over: int | None = None) -> DataFrame:
    """Long statistics: one row per (entity, label, channel).

    The built-in median and mode keep a segment's distinct values in memory, which
    suits charted data.  Where one segment can exceed a task, ``spread`` computes
    both, equally exact, without gathering a group.  With ``spread_over``, segments are
    counted once and only those of more rows than that are spread, in the same plan.
    ``mode_decimals`` rounds values before the mode, for interpolated ones that differ in
    their last bits.
    """
    keys = [*entity, "label", "seg_start_time", "seg_end_time", channel]
    if spread_over is not None and not spread:
        large = (members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > spread_over)
                 .select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        parts = [segment_stats(members.join(large, same, how), entity, channel, value, stats, how == "left_semi", mode_decimals)
                 for how in ("left_anti", "left_semi")]
        return parts[0].unionByName(parts[1])
    apart = {"median": spread_median, "mode": spread_mode} if spread else {}
    of = {s: F.round(value, mode_decimals) if s == "mode" and mode_decimals is not None
          else F.col(value) for s in stats}
    out = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[stat(s, of[s]).alias(s) for s in stats if s not in apart])
    for s in stats:
        if s in apart:
            rows = members.withColumn(value, of[s])
            out = out.join(apart[s](rows, keys, value, s), keys, "left")
    return out.select(*keys, *stats)


def widen_stats(stats_long: DataFrame, entity: Sequence[str], channel: str,
                channels: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row per segment, columns ``{channel}_{stat}`` for the given lists.

    One aggregate per channel carries all its statistics.
    """
    keys = [*entity, "label", "seg_start_time", "seg_end_time"]
    both = F.struct(*stats)
    wide = stats_long.groupBy(*keys).agg(
        *[F.max(F.when(F.col(channel) == c, both)).alias(f"_{i}") for i, c in enumerate(channels)])
    return wide.select(*keys, *[F.col(f"_{i}.{s}").alias(f"{c}_{s}")
                                for i, c in enumerate(channels) for s in stats])


def segment_features(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
                     channels: Sequence[str], seg_hours: float = 3.0,
                     stats: Sequence[str] = ("mean",), max_segments: int | None = None,
                     series: str | None = None, chunk_hours: float = 24.0,
                     spread: bool = False, mode_decimals: int | None = None,
                     spread_over: int | None = None) -> DataFrame:
    """Wide feature table, one row per (entity, segment).

    ``long`` may already carry ``_first_ts`` and ``_last_ts``; otherwise they are
    found first.  The segments of every entity end at its own last time.
    """
    known = long.filter(F.col(channel).isin(list(channels)))
    if "_last_ts" not in long.columns:
        known = with_span(known, entity, ts, chunk_hours)
    # Read three times, as members, for the limits and at the limits: Spark shuffles it once.
    known = known.select(*entity, channel, *([series] if series else []), ts, value, "_first_ts", "_last_ts")
    members = segment_members(known, entity, channel, ts, value, seg_hours, max_segments, series)
    per_channel = segment_stats(members, entity, channel, value, stats, spread, mode_decimals, spread_over)
    return widen_stats(per_channel, entity, channel, channels, stats)
