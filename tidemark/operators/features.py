"""Feature tables: means, sparse-feature selection, alignment and filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

FEW_LABELS = 10_000
KEYS = ("label", "seg_start_time", "seg_end_time")


def label_means(features: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """Mean of every feature per segment label."""
    return features.groupBy(label).agg(*[F.avg(n).alias(n) for n in names])


def label_counts(features: DataFrame, names: Sequence[str], label: str = "label",
                 rows: str = "rows") -> DataFrame:
    """Known values of every feature per segment label, and the row count."""
    return features.groupBy(label).agg(F.count(F.lit(1)).alias(rows),
                                       *[F.count(n).alias(n) for n in names])


def population_mean(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long (feature, mean) over all segments."""
    wide = features.agg(*[F.avg(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean"))
                      for n in names])
    return wide.select(F.inline(pairs))


def nearest_segments(features: DataFrame, total_hours: float, seg_hours: float,
                     label: str = "label") -> DataFrame:
    """Segments that fit into the last ``total_hours``."""
    return features.filter(F.col(label) <= int(total_hours // seg_hours))


def dense_features(features: DataFrame, names: Sequence[str], min_share: float = 2 / 3,
                   label: str = "label") -> list[str]:
    """Names kept: a feature goes only if it is sparse in every label.

    One aggregated row of flags reaches the driver, however large the data.
    """
    counts = label_counts(features, names, label, "_rows")
    flags = counts.agg(*[F.max((F.col(n) >= F.col("_rows") * F.lit(min_share)).cast("int"))
                         .alias(n) for n in names]).first()
    return [n for n in names if flags[n]]


def share_dense(features: DataFrame, names: Sequence[str], min_share: float = 2 / 3,
                label: str = "label") -> DataFrame:
    """Long (feature, kept) form of the same decision, as a DataFrame."""
    counts = label_counts(features, names, label, "_rows")
    wide = counts.agg(*[F.max((F.col(n) >= F.col("_rows") * F.lit(min_share)).cast("int"))
                        .alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("kept"))
                      for n in names])
    return wide.select(F.inline(pairs))


def align_and_fill(features: DataFrame, keys: Sequence[str], names: Sequence[str],
                   means: DataFrame) -> DataFrame:
    """Keys and the listed features in order; missing values and columns take the mean.

    The means are one number per listed feature; they enter the plan as literals,
    so filling is a plain projection.  A feature stored more than once must have one
    mean, and a feature without a stored mean is an error.
    """
    stored = (means.filter(F.col("feature").isin(list(names))).groupBy("feature")
              .agg(F.max("mean").alias("mean"), (~F.max("mean").eqNullSafe(F.min("mean"))).alias("odd")))
    mean_of = {}
    for r in stored.collect():
        if r["odd"]:
            raise ValueError(f"several means are stored for {r['feature']}")
        mean_of[r["feature"]] = r["mean"]
    absent = [n for n in names if n not in mean_of]
    if absent:
        raise ValueError(f"no mean is stored for {', '.join(absent)}")
    have = set(features.columns)

    def filled(n: str) -> Column:
        mean = F.lit(mean_of.get(n)).cast("double")
        return (F.coalesce(F.col(n), mean) if n in have else mean).alias(n)
    return features.select(*keys, *[filled(n) for n in names])


def fill_by_label(features: DataFrame, keys: Sequence[str], names: Sequence[str],
                  label: str = "label") -> DataFrame:
    """Missing values take the mean of their own segment label.

    A label has one row of means; they are broadcast if a count shows them few.  Pass
    stored features: they are read twice.
    """
    means = settle(label_means(features, names, label)
                   .withColumnsRenamed({n: f"_m_{n}" for n in names}))
    few = means.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    joined = features.join(F.broadcast(means) if few else means, label)
    return joined.select(*keys, *[F.coalesce(n, f"_m_{n}").alias(n) for n in names])


def feature_names(channels: Sequence[str], stats: Sequence[str]) -> list[str]:
    return [f"{c}_{s}" for c in channels for s in stats]


def fill_defaults(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """NULLs of the named columns replaced by fixed values."""
    return df.na.fill(dict(defaults))
