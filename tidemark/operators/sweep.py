"""Ordered per-entity computations that never gather an entity in one task.

A plain ``Window.partitionBy(entity).orderBy(ts)`` sends every row of an entity
to one task, so one very long entity stalls the job.  Here each entity is cut
into time slices ("chunks").  Rows are shuffled by (entity, chunk) and windowed
there; one summary row per chunk is swept along the entity; and the carried
values come back by an equi-join on (entity, chunk), which finds the row side
already partitioned and sorted.  The per-entity step sees one row per chunk, so
its size follows the time covered, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import time_chunk

CHUNK = "_chunk"
POS = "_pos"

_FACTS = {"min": F.min, "max": F.max, "sum": F.sum, "bit_or": F.bit_or}


def with_chunk(df: DataFrame, ts: str, hours: float) -> DataFrame:
    return df.withColumn(CHUNK, time_chunk(F.col(ts), hours))


def suggest_chunk_hours(df: DataFrame, entity: Sequence[str], ts: str,
                        target_rows: int = 2_000_000, probe_hours: float = 1.0) -> float:
    """Slice width at which the busiest (entity, slice) holds about ``target_rows``.

    One aggregation with map-side combining; a single number reaches the driver.
    """
    busiest = (with_chunk(df, ts, probe_hours).groupBy(*entity, CHUNK).count()
               .agg(F.max("count").alias("n")).first()["n"])
    if not busiest:
        return 24.0
    return max(probe_hours * target_rows / busiest, 1.0 / 3600.0)


def keyed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known.

    The join back drops the others anyway.  Saying so at the source gives both
    of its sides the same input, so that Spark shuffles it once.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.filter(known)


def join_back(rows: DataFrame, carried: DataFrame, keys: Sequence[str],
              null_safe: bool = False) -> DataFrame:
    """Attach per-chunk values to the rows of the chunk."""
    if not null_safe:
        return rows.join(carried, list(keys))
    renamed = carried.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def sweep(df: DataFrame, entity: Sequence[str], order: Sequence[str],
          before: Mapping[str, Column] | None = None,
          totals: Mapping[str, Column] | None = None,
          facts: Mapping[str, tuple[str, Column]] | None = None,
          position: str | None = None,
          null_safe: bool = False) -> DataFrame:
    """Add ordered facts to rows that already carry a ``_chunk`` column.

    ``before``    latest non-NULL value of the expression strictly earlier
    ``totals``    running total; rows tied on the first order column share it
    ``facts``     whole-entity aggregate (min, max, sum, bit_or) on every row
    ``position``  1-based row number within the entity

    Chunks must be increasing with the first order column and hold all rows tied
    on it.  Rows with a NULL entity are kept only when ``null_safe``.
    """
    before, totals, facts = before or {}, totals or {}, facts or {}
    keys = [*entity, CHUNK]
    here = Window.partitionBy(*keys).orderBy(*order)
    earlier_here = here.rowsBetween(Window.unboundedPreceding, -1)
    tied_here = (Window.partitionBy(*keys).orderBy(order[0])
                 .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    along = Window.partitionBy(*entity).orderBy(CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*entity)

    local, chunk_aggs, carried, final = [], [], [], []
    for name, value in before.items():
        local.append(F.last(value, ignorenulls=True).over(earlier_here).alias(f"_l_{name}"))
        ranked = F.struct(*order, value.alias("_v"))
        chunk_aggs.append(F.max(F.when(value.isNotNull(), ranked))["_v"].alias(f"_s_{name}"))
        carried.append(F.last(f"_s_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        final.append(F.coalesce(f"_l_{name}", f"_c_{name}").alias(name))
    for name, value in totals.items():
        local.append(F.sum(value).over(tied_here).alias(f"_l_{name}"))
        chunk_aggs.append(F.sum(value).alias(f"_s_{name}"))
        carried.append(F.sum(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
        final.append((F.col(f"_l_{name}") + F.coalesce(f"_c_{name}", F.lit(0))).alias(name))
    if position:
        local.append(F.row_number().over(here).alias(f"_l_{position}"))
        chunk_aggs.append(F.count(F.lit(1)).alias(f"_s_{position}"))
        carried.append(F.sum(f"_s_{position}").over(earlier).alias(f"_c_{position}"))
        final.append((F.col(f"_l_{position}") + F.coalesce(f"_c_{position}", F.lit(0)))
                     .cast("bigint").alias(position))
    for name, (how, value) in facts.items():
        chunk_aggs.append(_FACTS[how](value).alias(f"_s_{name}"))
        carried.append(_FACTS[how](f"_s_{name}").over(whole).alias(name))
        final.append(F.col(name))

    base = df if null_safe else keyed_rows(df, keys)
    rows = base.select("*", *local)
    summary = base.groupBy(*keys).agg(*chunk_aggs).select(*keys, *carried)
    return join_back(rows, summary, keys, null_safe).select(*df.columns, *final)


def anchors(df: DataFrame, entity: Sequence[str], ts: str, columns: Sequence[str],
            facts: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Nearest known value at or before, and at or after, every row.

    For each column ``c`` adds the structs ``c__prev`` and ``c__next`` with the
    row position and value of the nearest non-NULL entry, and ``_pos``, the
    row's own position in its entity.  ``ts`` must be unique per entity.
    """
    facts = facts or {}
    keys = [*entity, CHUNK]
    up = Window.partitionBy(*keys).orderBy(ts)
    # The look-ahead runs over the reversed order: a shrinking frame would
    # re-read the rest of the chunk for every row.
    down = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*entity).orderBy(CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = (Window.partitionBy(*entity).orderBy(F.col(CHUNK).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*entity)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.struct(F.col(POS).alias("pos"), F.col(c).alias("v")))

    def moved(s: Column) -> Column:
        return F.when(s.isNotNull(),
                      F.struct((s["pos"] + F.col("_offset")).alias("pos"), s["v"].alias("v")))

    placed = keyed_rows(df, keys).withColumn(POS, F.row_number().over(up).cast("bigint"))
    summary = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(known(c)).alias(f"{c}__last") for c in columns],
        *[F.min(known(c)).alias(f"{c}__first") for c in columns],
        *[_FACTS[how](value).alias(name) for name, (how, value) in facts.items()])
    summary = summary.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carried = summary.select(
        *keys, "_offset",
        *[F.last(moved(F.col(f"{c}__last")), ignorenulls=True).over(earlier)
          .alias(f"{c}__cp") for c in columns],
        *[F.last(moved(F.col(f"{c}__first")), ignorenulls=True).over(later)
          .alias(f"{c}__cn") for c in columns],
        *[_FACTS[how](name).over(whole).alias(name) for name, (how, _) in facts.items()])
    rows = placed.select(
        "*",
        *[F.last(known(c), ignorenulls=True).over(up.rowsBetween(*so_far))
          .alias(f"{c}__lp") for c in columns],
        *[F.last(known(c), ignorenulls=True).over(down.rowsBetween(*so_far))
          .alias(f"{c}__ln") for c in columns])
    joined = rows.join(carried, keys)
    return joined.select(
        *df.columns, (F.col(POS) + F.col("_offset")).alias(POS),
        *[F.coalesce(moved(F.col(f"{c}__lp")), f"{c}__cp").alias(f"{c}__prev") for c in columns],
        *[F.coalesce(moved(F.col(f"{c}__ln")), f"{c}__cn").alias(f"{c}__next") for c in columns],
        *facts.keys())
