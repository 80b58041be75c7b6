"""As-of join: to every row the row of another table that is nearest in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros_between
from .sweep import CHUNK, sweep

DIRECTIONS = ("backward", "forward", "nearest")


def _micros(ts: Column) -> Column:
    return micros_between(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
              columns: Sequence[str], direction: str = "nearest", within_seconds: float | None = None,
              ties: Sequence[str] = (), chunk_hours: float = 24.0, found: str = "found_ts") -> DataFrame:
    """All rows of ``left`` with ``columns`` and the time (``found``) of their match in ``right``.

    ``backward`` takes the latest row at or before, ``forward`` the earliest at or after,
    ``nearest`` the closer of the two, the earlier one at equal distance.  A match further
    off than ``within_seconds`` doesn't count.  Of right rows at one time the first by
    ``ties``, then by ``columns``, is taken.  Rows without a match keep NULLs; a NULL key or
    time matches nothing.

    Both tables become one sequence by time, swept in chunks of an entity's time, once
    forwards and once backwards as needed: neither pairs nor whole entities are gathered.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    width = int(chunk_hours * 3_600_000_000)
    names = [*ties, *[c for c in columns if c not in ties]]
    point = F.struct(_micros(F.col(right_ts)).alias("at"), F.col(right_ts).alias("ts"), F.struct(*names).alias("own"))
    given = right.filter(F.col(right_ts).isNotNull())
    for k in keys:
        given = given.filter(F.col(k).isNotNull())
    # One right row for each key and time, so that both sweeps find the same one.
    points = (given.groupBy(*keys, _micros(F.col(right_ts)).alias("_t")).agg(F.min(point).alias("_r"))
              .withColumn("_side", F.lit(0)))
    rows = left.select(*keys, _micros(F.col(left_ts)).alias("_t"), F.struct("*").alias("_l"), F.lit(1).alias("_side"))
    merged = rows.unionByName(points, allowMissingColumns=True)
    for name, wanted, sign in (("_back", "forward", 1), ("_ahead", "backward", -1)):
        if direction == wanted:
            merged = merged.withColumn(name, F.lit(None).cast(points.schema["_r"].dataType))
            continue
        placed = merged.withColumn("_o", F.col("_t") * sign).withColumn(
            CHUNK, F.floor(F.col("_o") / F.lit(width)).cast("bigint"))
        merged = sweep(placed, list(keys), ["_o", "_side"], before={name: F.when(F.col("_side") == 0, F.col("_r"))},
                       null_safe=True).drop("_o", CHUNK)
    back, ahead = F.col("_back"), F.col("_ahead")
    behind, before = F.col("_t") - back["at"], ahead["at"] - F.col("_t")
    best = F.when(ahead.isNull() | (behind <= before), back).otherwise(ahead)
    off = F.abs(F.col("_best.at") - F.col("_t"))
    ok = F.col("_best").isNotNull() & F.col("_t").isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    if within_seconds is not None:
        ok &= off <= F.lit(int(within_seconds * 1_000_000))
    matched = (merged.filter("_side = 1").withColumn("_best", best)
               .withColumn("_best", F.when(ok, F.col("_best"))))
    return matched.select("_l.*", F.col("_best.ts").alias(found), *[F.col(f"_best.own.{c}").alias(c) for c in columns])
