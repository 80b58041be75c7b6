"""Registry of summary statistics: name -> Column of a value Column.

Moments are the sample-corrected forms.  A constant group has skewness and excess
kurtosis 0; too few values give NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _constant(v: Column) -> Column:
    # By the values: merged partial moments of equal values differ in their last bits.
    return F.min(v) == F.max(v)


def _skew(v: Column) -> Column:
    n = F.count(v).cast("double")
    corrected = F.try_divide(F.skewness(v) * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(_constant(v), F.lit(0.0)).otherwise(corrected))


def _kurtosis(v: Column) -> Column:
    n = F.count(v).cast("double")
    corrected = (F.try_divide(n - 1, (n - 2) * (n - 3))
                 * ((n + 1) * F.kurtosis(v) + 6))
    return F.when(n >= 4, F.when(_constant(v), F.lit(0.0)).otherwise(corrected))


def _mode(v: Column) -> Column:
    return F.mode(v, True)


STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "mode": _mode,
    "kurtosis": _kurtosis,
    "skew": _skew,
    "std": F.stddev_samp,
}


def stat(name: str, value: Column) -> Column:
    return STATS[name](value)
