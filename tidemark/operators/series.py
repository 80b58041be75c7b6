"""Regular grids from irregular series: collapse, densify, interpolate, derive.

The grid is kept wide (one row per entity and time, one column per channel), so
all channels share one shuffle, one sort and one set of positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sweep import CHUNK, POS, anchors, sweep, with_chunk

_WORD = 62  # channels per presence word; a bigint holds 63 usable bits


def collapse(long: DataFrame, keys: Sequence[str], value: str,
             others: Sequence[str] = ()) -> DataFrame:
    """One row per key: mean of the value, largest of the other columns."""
    return long.groupBy(*keys).agg(F.avg(value).alias(value),
                                   *[F.max(c).alias(c) for c in others])


def _seen_words(channel: str, channels: Sequence[str]) -> dict[str, Column]:
    words = {}
    for w in range(0, len(channels), _WORD):
        bit = F.lit(0).cast("bigint")
        for i, c in enumerate(channels[w:w + _WORD]):
            bit = F.when(F.col(channel) == c, F.lit(1 << i).cast("bigint")).otherwise(bit)
        words[f"_seen{w // _WORD}"] = bit
    return words


def _present(channels: Sequence[str], c: str) -> Column:
    i = list(channels).index(c)
    return F.col(f"_seen{i // _WORD}").bitwiseAND(F.lit(1 << (i % _WORD)).cast("bigint")) != 0


def grid(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
         channels: Sequence[str], others: Sequence[str] = (),
         chunk_hours: float = 24.0) -> DataFrame:
    """Wide grid: every distinct time of an entity, one column per channel.

    Rows without entity or channel are dropped.  Repeated times are averaged in
    a first, map-side combined aggregation over narrow rows; the pivot then runs
    inside the (entity, chunk) partitions that the interpolation needs anyway.
    """
    known = long.filter(F.col(channel).isin(list(channels))).na.drop(subset=list(entity))
    narrow = collapse(known, [*entity, channel, ts], value, others)
    placed = with_chunk(narrow, ts, chunk_hours).repartition(*[F.col(k) for k in entity],
                                                             F.col(CHUNK))
    cells = []
    for c in channels:
        hit = F.col(channel) == c
        cells.append(F.max(F.when(hit, F.col(value))).alias(c))
        cells += [F.max(F.when(hit, F.col(o))).alias(f"{c}__{o}") for o in others]
    cells += [F.bit_or(bit).alias(w) for w, bit in _seen_words(channel, channels).items()]
    return placed.groupBy(*entity, CHUNK, ts).agg(*cells)


def _line(c: str) -> Column:
    """Value on the straight line, by grid position, between the two anchors."""
    p, n = F.col(f"{c}__prev"), F.col(f"{c}__next")
    slope = (n["v"] - p["v"]) / F.nullif(n["pos"] - p["pos"], F.lit(0))
    between = slope * (F.col(POS) - p["pos"]) + p["v"]
    return F.coalesce(F.when(p["pos"] == F.col(POS), p["v"]), between, p["v"], n["v"])


def _nearest_before(c: str) -> Column:
    return F.coalesce(F.col(f"{c}__prev")["v"], F.col(f"{c}__next")["v"])


def interpolate(wide: DataFrame, entity: Sequence[str], ts: str, lines: Sequence[str],
                fills: Sequence[str] = ()) -> DataFrame:
    """Complete a grid that carries its chunk column.

    ``lines`` are interpolated linearly over row positions (the time axis plays
    no part) and held flat beyond the first and last known value; ``fills`` take
    the previous known value, or the next one at the start.  Every row also gets
    the entity's first and last time, as ``_first_ts`` and ``_last_ts``.
    """
    facts = {"_first_ts": ("min", F.col(ts)), "_last_ts": ("max", F.col(ts))}
    seen = [c for c in wide.columns if c.startswith("_seen")]
    facts.update({f"_any{w}": ("bit_or", F.col(w)) for w in seen})
    swept = anchors(wide, entity, ts, [*lines, *fills], facts)
    return swept.select(
        *entity, CHUNK, ts, "_first_ts", "_last_ts",
        *[F.col(f"_any{w}").alias(w) for w in seen],
        *[_line(c).alias(c) for c in lines], *[_nearest_before(c).alias(c) for c in fills])


def melt(wide: DataFrame, keys: Sequence[str], channels: Sequence[str], channel: str, value: str,
         others: Sequence[str] = (), present_only: bool = True,
         known_only: bool = False) -> DataFrame:
    """Back to long form; channels an entity never had are left out."""
    def one(c: str) -> Column:
        return F.struct(
            F.lit(c).alias(channel), F.col(c).alias(value),
            *[F.col(f"{c}__{o}").alias(o) for o in others],
            (F.col(c).isNotNull() if known_only
             else _present(channels, c) if present_only else F.lit(True)).alias("_keep"))
    opened = wide.select(*keys, F.explode(F.array(*[one(c) for c in channels])).alias("_m"))
    return (opened.filter("_m._keep")
            .select(*keys, f"_m.{channel}", f"_m.{value}", *[f"_m.{o}" for o in others]))


def densify(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
            channels: Sequence[str], chunk_hours: float = 24.0) -> DataFrame:
    """(channels the entity has) x (its distinct times); unknown values are NULL."""
    wide = grid(long, entity, channel, ts, value, channels, (), chunk_hours)
    swept = anchors(wide, entity, ts, [], {
        f"_any{w}": ("bit_or", F.col(w)) for w in wide.columns if w.startswith("_seen")})
    seen = [w for w in wide.columns if w.startswith("_seen")]
    whole = swept.select(*entity, ts, *channels, *[F.col(f"_any{w}").alias(w) for w in seen])
    return melt(whole, [*entity, ts], channels, channel, value)


def impute(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
           channels: Sequence[str], others: Sequence[str] = (),
           chunk_hours: float = 24.0) -> DataFrame:
    """Average repeated times, put each entity's channels on its shared time grid,
    interpolate the value by position and fill the other columns."""
    wide = grid(long, entity, channel, ts, value, channels, others, chunk_hours)
    full = interpolate(wide, entity, ts, list(channels),
                       [f"{c}__{o}" for c in channels for o in others])
    return melt(full, [*entity, ts], channels, channel, value, others)


def derive_sum(long: DataFrame, entity: Sequence[str], channel: str, ts: str, value: str,
               parts: Sequence[str], name: str, unit_col: str | None = None,
               unit: str | None = None, dedupe: bool = False) -> DataFrame:
    """Append channel ``name`` = sum of the parts at times that have them all.

    An existing channel of that name keeps its rows, so a time may then hold two;
    ``dedupe`` averages them.
    """
    keys = [*entity, ts]
    part = [F.max(F.when(F.col(channel) == p, F.col(value))).alias(f"_p{i}")
            for i, p in enumerate(parts)]
    total = sum((F.col(f"_p{i}") for i in range(1, len(parts))), F.col("_p0"))
    made = (long.filter(F.col(channel).isin(list(parts))).groupBy(*keys).agg(*part)
            .select(*keys, F.lit(name).alias(channel), total.alias(value),
                    *([F.lit(unit).cast("string").alias(unit_col)] if unit_col else []))
            .filter(F.col(value).isNotNull()))
    out = long.unionByName(made, allowMissingColumns=True)
    if dedupe:
        rest = [c for c in long.columns if c not in (*keys, channel, value)]
        out = collapse(out, [*keys, channel], value, rest).select(*long.columns)
    return out


def derive_ratio_product(long: DataFrame, entity: Sequence[str], channel: str, ts: str,
                         value: str, base: str, other: str, scale: float,
                         names: tuple[str, str], unit_col: str | None = None,
                         units: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Append ``base / (other / scale)`` and ``base * (other / scale)``.

    Made at every time of ``base``, NULL where ``other`` is missing, and only for
    entities that have ``other`` at all.
    """
    keys = [*entity, ts]
    pair = long.filter(F.col(channel).isin(base, other))
    at = pair.groupBy(*keys).agg(
        F.max(F.when(F.col(channel) == base, F.col(value))).alias("_b"),
        F.max(F.when(F.col(channel) == other, F.col(value))).alias("_o"),
        F.max(F.when(F.col(channel) == base, 1)).alias("_has"))
    owners = long.filter(F.col(channel) == other).select(*entity).distinct()
    at = at.filter("_has = 1").join(owners, list(entity), "left_semi")
    scaled = F.col("_o") / F.lit(float(scale))
    # Both results leave one pass over the pairs, as two rows per time.
    both = F.array(*[
        F.struct(F.lit(name).alias(channel), v.alias(value),
                 *([F.lit(unit).cast("string").alias(unit_col)] if unit_col else []))
        for name, unit, v in zip(names, units, (F.try_divide(F.col("_b"), scaled),
                                                F.col("_b") * scaled))])
    made = at.select(*keys, F.inline(both))
    return long.unionByName(made, allowMissingColumns=True)


def channel_series(long: DataFrame, entity: str, channel: str, ts: str, value: str,
                   wanted: str, unit: str | None = None) -> DataFrame:
    """One channel as a plain series: mean per time, with its unit."""
    rows = long.filter(F.col(channel) == wanted)
    return rows.groupBy(entity, ts).agg(
        F.avg(value).alias(value), *([F.max(unit).alias(unit)] if unit else []))


def in_time_order(series: DataFrame, entity: str, ts: str, position: str = "position",
                  chunk_hours: float = 24.0) -> DataFrame:
    """The series with each point's place in its entity's time order, from 1.

    A place survives storing and joining, which an order of rows doesn't.  Times must be
    unique within an entity; points without entity or time drop out.
    """
    placed = with_chunk(series, ts, chunk_hours)
    return sweep(placed, [entity], [ts], position=position).drop(CHUNK)


def series_markers(df: DataFrame, entity: str, ts: str, first: str = "first_ts",
                   last: str = "last_ts") -> DataFrame:
    """First and last time of each entity."""
    return df.groupBy(entity).agg(F.min(ts).alias(first), F.max(ts).alias(last))


def step_points(pred: DataFrame, start: str, end: str, time: str = "time",
                lag_seconds: int = 1) -> DataFrame:
    """Two points per segment, just after its start and at its end, same values."""
    rest = [c for c in pred.columns if c not in (start, end)]
    points = F.array(F.timestamp_add("SECOND", F.lit(lag_seconds), F.col(start)), F.col(end))
    return pred.select(*rest, F.explode(points).alias(time))
