"""Rule tables: label, gate, convert and flag coded measurements.

Rules are plain data.  Their size is fixed by the caller's code, never by the
data, so a rule table is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """An interval, each side open or closed; ``None`` leaves a side free."""

    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = True

    def holds(self, value: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(value >= self.low if self.low_closed else value > self.low)
        if self.high is not None:
            tests.append(value <= self.high if self.high_closed else value < self.high)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class LabelRule:
    """Codes that become one channel while the raw value lies in the bounds."""

    label: str
    codes: tuple
    bounds: Bounds = Bounds()


@dataclass(frozen=True)
class Conversion:
    """``(value - offset) * factor / divisor`` for some codes."""

    codes: tuple
    factor: float = 1.0
    divisor: float = 1.0
    offset: float = 0.0

    def of(self, value: Column) -> Column:
        if self.offset:
            value = value - F.lit(float(self.offset))
        if self.factor != 1.0:
            value = value * F.lit(float(self.factor))
        return value / F.lit(float(self.divisor)) if self.divisor != 1.0 else value


@dataclass(frozen=True)
class Repair:
    """Value correction of some codes, piece by piece.

    ``pieces`` pairs bounds with a factor (``None`` blanks the value); values in
    no piece are kept when ``keep_rest``, else blanked.
    """

    codes: tuple
    pieces: tuple
    keep_rest: bool = False

    def of(self, value: Column) -> Column:
        blank = F.lit(None).cast("double")
        rest = value if self.keep_rest else blank
        for bounds, factor in reversed(self.pieces):
            hit = blank if factor is None else value * F.lit(float(factor))
            rest = F.when(bounds.holds(value), hit).otherwise(rest)
        return rest


@dataclass(frozen=True)
class Units:
    unit: str
    codes: tuple


@dataclass(frozen=True)
class Match:
    """Codes, and optionally the texts they must (or must not) carry."""

    codes: tuple
    texts: tuple | None = None
    not_texts: tuple = ()

    def test(self, code: Column, text: Column) -> Column:
        hit = code.isin(*self.codes)
        if self.texts is not None:
            hit = hit & text.isin(*self.texts)
        if self.not_texts:
            hit = hit & ~text.isin(*self.not_texts)
        return hit


def case(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """``CASE WHEN`` over (condition, result) pairs; first hit wins."""
    if not branches:
        return otherwise if otherwise is not None else F.lit(None)
    chain = F.when(*branches[0])
    for cond, result in branches[1:]:
        chain = chain.when(cond, result)
    return chain if otherwise is None else chain.otherwise(otherwise)


def rule_table(spark, rules: Sequence[LabelRule], units: Sequence[Units] = ()) -> DataFrame:
    """One row per code: label, bounds and unit.  A code in two rules is an error: a join
    would double its rows."""
    codes = [c for r in rules for c in r.codes]
    if len(codes) != len(set(codes)):
        raise ValueError(f"codes in several rules: {sorted({c for c in codes if codes.count(c) > 1})}")
    unit_of = {c: u.unit for u in units for c in u.codes}
    rows = []
    for r in rules:
        b = r.bounds
        low, high = (None if x is None else float(x) for x in (b.low, b.high))
        rows += [(c, r.label, low, b.low_closed, high, b.high_closed, unit_of.get(c))
                 for c in r.codes]
    code_type = "string" if isinstance(rows[0][0], str) else "bigint"
    return spark.createDataFrame(
        rows, f"code {code_type}, label string, low double, low_closed boolean, "
              "high double, high_closed boolean, unit string")


def label_channels(events: DataFrame, rules: Sequence[LabelRule], code: str, value: str,
                   units: Sequence[Units] = (), conversions: Sequence[Conversion] = (),
                   repairs: Sequence[Repair] = (), label_col: str = "label",
                   value_col: str = "converted", unit_col: str = "unit") -> DataFrame:
    """Keep coded rows and add channel label, converted value and unit.

    The gate looks at the raw value; conversion is separate, so a row outside
    its bounds stays, with a NULL label.
    """
    spark = events.sparkSession
    raw = F.col(value)
    table = rule_table(spark, rules, units).withColumnRenamed("code", "_code")
    codes = [c for r in rules for c in r.codes]
    # The explicit list reaches the scan; a join condition alone would not.
    kept = events.filter(F.col(code).isin(codes))
    joined = kept.join(F.broadcast(table), F.col(code) == F.col("_code"))
    low_ok = (F.col("low").isNull() | (raw > F.col("low"))
              | (F.col("low_closed") & (raw == F.col("low"))))
    high_ok = (F.col("high").isNull() | (raw < F.col("high"))
               | (F.col("high_closed") & (raw == F.col("high"))))
    changed = ([(F.col(code).isin(*c.codes), c.of(raw)) for c in conversions]
               + [(F.col(code).isin(*r.codes), r.of(raw)) for r in repairs])
    return joined.select(
        *[F.col(c) for c in events.columns],
        F.when(low_ok & high_ok, F.col("label")).alias(label_col),
        case(changed, raw).alias(value_col),
        F.col("unit").alias(unit_col))


def keep_valid(events: DataFrame, error: str | None = None, text: str | None = None,
               value: str | None = None, codes: Sequence | None = None,
               code: str | None = None) -> DataFrame:
    """Row filters: code list, not flagged as error (NULL is fine), non-empty text,
    known nonzero value."""
    out = events
    if codes is not None:
        out = out.filter(F.col(code).isin(list(codes)))
    if error is not None:
        out = out.filter(~F.col(error).eqNullSafe(1))
    if text is not None:
        out = out.filter(F.col(text) != "")
    if value is not None:
        out = out.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    return out


def status_flags(events: DataFrame, flags: Mapping[str, Sequence[Match]], entity: str, ts: str,
                 code: str, text: str, extra: DataFrame | None = None) -> DataFrame:
    """0/1 flags per (entity, time): the largest of each flag at that time.

    ``extra`` holds rows of the same shape from another source; the union drops
    duplicates across and within both sides.
    """
    tests = {name: reduce(lambda a, b: a | b,
                          [m.test(F.col(code), F.col(text)) for m in matches])
             for name, matches in flags.items()}
    rolled = events.groupBy(entity, ts).agg(
        *[F.max(F.when(t, 1).otherwise(0)).alias(name) for name, t in tests.items()])
    if extra is None:
        return rolled
    return rolled.unionByName(extra.select(entity, ts, *flags)).distinct()


def fixed_flags(events: DataFrame, entity: str, ts: str, code: str, codes: Sequence,
                constants: Mapping[str, int], by_code: Mapping[str, Sequence],
                ts_as: str | None = None) -> DataFrame:
    """Flag rows from a source whose presence alone sets a flag.

    ``constants`` are literal flags; ``by_code`` flags are 1 for the given codes.
    """
    return events.filter(F.col(code).isin(list(codes))).select(
        F.col(entity), F.col(ts).alias(ts_as or ts),
        *[F.lit(v).alias(k) for k, v in constants.items()],
        *[F.when(F.col(code).isin(list(v)), 1).otherwise(0).alias(k)
          for k, v in by_code.items()])


def rename_channels(df: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename wide channel columns; several sources of one name are coalesced.

    ``sources`` maps the new name to its old names in order of priority.
    """
    used = {old for olds in sources.values() for old in olds if old in df.columns}
    merged = [F.coalesce(*[F.col(f"`{o}`") for o in olds if o in df.columns]).alias(new)
              for new, olds in sources.items() if any(o in df.columns for o in olds)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], *merged)
