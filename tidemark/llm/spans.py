"""Positions of regular-expression matches by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def find_spans(text: Column, pattern: str | Column, kind: str,
               keep: Callable[[Column], Column] | None = None,
               group: int = 0) -> Column:
    """Leftmost matches as array<struct<kind, start, end, value>>, in code points.

    The texts between the matches come from ``split``; lengths of gaps and matches
    summed in turn place every match.  ``value`` is the given group; ``keep`` takes a
    span's ``value`` and drops it where false.  Sums run over chunks of matches first,
    so that a text with very many matches isn't copied once per match.
    ``pattern`` must not match the empty string; it may be a column, a pattern for each row.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    gap = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    parts = F.arrays_zip(gap.alias("gap"), found.alias("found"), value.alias("value"))
    last = ((F.size(found) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last),
                         lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))

    def placed(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("rows"))

        def step(acc: Column, p: Column) -> Column:
            s = acc["at"] + F.length(p["gap"])
            e = s + F.length(p["found"])
            row = F.struct(s.alias("s"), e.alias("e"), p["value"].alias("v"))
            return F.struct(e.alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))
        return F.aggregate(chunk, zero, step)

    done = F.transform(chunks, placed)
    sizes = F.transform(done, lambda d: d["at"])
    before = F.transform(done, lambda d, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0),
                                                        lambda a, n: a + n))
    rows = F.flatten(F.zip_with(done, before, lambda d, b: F.transform(
        d["rows"], lambda r: F.struct(F.lit(kind).alias("kind"), (r["s"] + b).alias("start"),
                                      (r["e"] + b).alias("end"), r["v"].alias("value")))))
    if keep is not None:
        rows = F.filter(rows, lambda r: keep(r["value"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(F.size(found) > 0, rows).otherwise(none)


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(
        others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def uncovered(spans: Column, others: Column) -> Column:
    """Spans that lie within none of the others."""
    return F.filter(spans, lambda s: ~F.exists(
        others, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
