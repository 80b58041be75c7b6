"""First recorded value per entity, one column per parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Conversion, LabelRule, case


def first_value_pivot(events: DataFrame, rules: Sequence[LabelRule], keys: Sequence[str],
                      ts: str, code: str, value: str,
                      conversions: Sequence[Conversion] = ()) -> DataFrame:
    """Earliest converted value per key and parameter, as columns.

    One aggregation: the earliest (time, value) pair per parameter is a minimum,
    so it combines before the shuffle and needs neither a window nor a distinct.
    Values at one time: the smallest is taken.  Missing and zero values are
    dropped first.
    """
    labels = list(dict.fromkeys(r.label for r in rules))
    raw = F.col(value)
    kept = events.filter(raw.isNotNull() & (raw != 0)
                         & F.col(code).isin([c for r in rules for c in r.codes]))
    shaped = kept.select(
        *keys, ts,
        case([(F.col(code).isin(*r.codes) & r.bounds.holds(raw), F.lit(r.label))
              for r in rules]).alias("_label"),
        case([(F.col(code).isin(*c.codes), c.of(raw)) for c in conversions], raw).alias("_v"))
    return shaped.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_label") == p, F.struct(ts, "_v")))["_v"].alias(p)
          for p in labels])


def with_bmi(df: DataFrame, height: str = "height", weight: str = "weight",
             bmi: str = "bmi") -> DataFrame:
    """Round height and weight; the index uses the unrounded inputs."""
    metres = F.col(height) / 100
    index = F.try_divide(F.col(weight), metres * metres)
    others = [c for c in df.columns if c not in (height, weight)]
    return df.select(*others, F.round(F.col(height).cast("double"), 2).alias(height),
                     F.round(F.col(weight).cast("double"), 2).alias(weight), index.alias(bmi))
