"""Exact median and mode of groups too large for one task.

The built-in aggregates keep one table of distinct values per group in memory.
Here values are counted first (a fine key, combined before the shuffle), the
mode is a maximum over those counts, and the median's rank is found by a running
count that is swept over cells of the value range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import int_div
from .sweep import CHUNK, sweep

CELLS_PER_OCTAVE = 4096
SMALLEST_OCTAVE = 1076.0


def value_cell(v: Column) -> Column:
    """Cell number that never decreases with the value; relative width 1/4096 octave.

    Even in the exponent down to the smallest doubles, so that values close to 0
    spread over cells as well.
    """
    size = F.floor((F.log2(F.abs(v)) + F.lit(SMALLEST_OCTAVE)) * F.lit(float(CELLS_PER_OCTAVE)))
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("bigint")


def _counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (rows.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))


def spread_median(rows: DataFrame, keys: Sequence[str], value: str,
                  out: str = "median") -> DataFrame:
    """Exact median per key: the middle value, or the mean of the two middle ones."""
    placed = _counts(rows, keys, value).withColumn(CHUNK, value_cell(F.col("_v")))
    ranked = sweep(placed, keys, ["_v"], totals={"_upto": F.col("_n")},
                   facts={"_all": ("sum", F.col("_n"))})
    first, upto = F.col("_upto") - F.col("_n"), F.col("_upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > first) & (rank <= upto), F.col("_v")))
    low, high = int_div(F.col("_all") + 1, 2), int_div(F.col("_all"), 2) + 1
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / F.lit(2.0)).alias(out))


def spread_mode(rows: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per key, the smallest on ties."""
    best = F.max(F.struct(F.col("_n"), (-F.col("_v")).alias("_minus")))
    return (_counts(rows, keys, value).groupBy(*keys)
            .agg((-best["_minus"]).alias(out)))
