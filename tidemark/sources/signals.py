"""Record listings and regularly sampled signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import combine_date_time, sampling_period, shift_seconds


def parse_records(lines: DataFrame, pattern: str, line: str = "value", subject: str = "subject",
                  record: str = "record") -> DataFrame:
    """Subject text and record name of every listing line that fits the pattern."""
    return (lines.withColumn(subject, F.regexp_extract(line, pattern, 1))
            .withColumn(record, F.regexp_extract(line, pattern, 2))
            .filter(F.col(record) != ""))


def find_records(spark: SparkSession, path: str, pattern: str, subject: Column | str) -> DataFrame:
    """Records of one subject in a stored listing, one path per line."""
    found = parse_records(spark.read.text(path), pattern)
    return found.filter(F.col("subject") == subject).select("record").distinct()


def timed_samples(signals: DataFrame, keys: Sequence[str], start: Column, fs: str, samples: str,
                  channel: str, time: str = "time", value: str = "value") -> DataFrame:
    """One row per sample: start plus its index times the sampling period.

    A generator over each record's own array: no shuffle.
    """
    opened = signals.select(*keys, channel, start.alias("_start"),
                            sampling_period(F.col(fs)).alias("_period"),
                            F.posexplode(samples).alias("_i", value))
    return opened.select(*keys, channel,
                         shift_seconds(F.col("_start"), F.col("_i") * F.col("_period")).alias(time),
                         value)


def expand_signals(signals: DataFrame, keys: Sequence[str], start: Column, fs: str, samples: str,
                   channel: str, channels: Sequence[str],
                   rename: Mapping[str, Sequence[str]] | None = None,
                   time: str = "time") -> DataFrame:
    """Timed rows with one column per channel, renamed and coalesced."""
    rows = timed_samples(signals.filter(F.col(channel).isin(list(channels))), keys, start, fs,
                         samples, channel, time, "_v")
    # Names of one channel may differ only in case, so sources never become columns.
    rename = rename or {}
    taken = {old for olds in rename.values() for old in olds}
    sources = {**{c: [c] for c in channels if c not in taken},
               **{new: [o for o in olds if o in channels] for new, olds in rename.items()}}
    return rows.groupBy(*keys, time).agg(
        *[F.coalesce(*[F.max(F.when(F.col(channel) == o, F.col("_v"))) for o in olds]).alias(new)
          for new, olds in sources.items() if olds])


def record_start(day: str, clock: str) -> Column:
    return combine_date_time(F.col(day), F.col(clock))
