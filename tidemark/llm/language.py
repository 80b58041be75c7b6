"""Language identification by mixture inference over character trigrams.

Every document is a mixture of languages.  Expectation-maximisation estimates its
proportions from the trigrams' likelihoods, and the set of languages is the one with the
best penalised likelihood (Bayesian information criterion) among the k strongest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_remainder, slices, store, text_key

BUCKETS = 1 << 18
SMOOTHING = 0.05
ROUNDS = 20
UNKNOWN = "und"
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Languages:
    """Learned languages and the share of every trigram bucket in each (buckets x languages)."""

    names: list[str] = field(default_factory=list)
    shares: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every trigram around a letter, in order.

    Text is lower-cased; whatever isn't a letter counts as a blank.
    """
    plain = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = codes[at - 1] * _SALT[0] + codes[at] * _SALT[1] + codes[at + 1] * _SALT[2]
    ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SALT[0]
    return (mixed >> bits).astype(np.int64), np.searchsorted(ends, at, side="right")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          smoothing: float = SMOOTHING) -> Languages:
    """Trigram shares of every language from all labelled rows with a text.

    Tasks count into one table per language; the driver gets the sums only: at most
    ``BUCKETS`` numbers per language.  No labelled row gives no language.
    """
    labelled = (docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
                .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                buckets, owner = trigrams(texts[lo:hi])
                part = np.array(langs[lo:hi], dtype=object)
                for lang in set(langs[lo:hi]):
                    mine = (part == lang)[owner] if len(owner) else np.zeros(0, bool)
                    table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    table += np.bincount(buckets[mine], minlength=BUCKETS)
        for lang, table in tables.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(table[used])],
                names=["lang", "bucket", "n"])
    counts = (labelled.mapInArrow(count, "lang string, bucket bigint, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    sums = counts.toArrow()
    names = sorted(sums["lang"].unique().to_pylist())
    table = np.full((BUCKETS, len(names)), smoothing)
    place = pc.index_in(sums["lang"], pa.array(names, pa.string())).to_numpy()
    np.add.at(table, (sums["bucket"].to_numpy(), place), sums["n"].to_numpy())
    return Languages(names, (table / table.sum(axis=0)).astype(np.float32))


def _em(share: np.ndarray, n: np.ndarray, first: np.ndarray, begin: np.ndarray,
        rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every text; zeros in ``begin`` stay zero."""
    sizes = np.diff(np.append(first, len(n)))
    total = np.add.reduceat(n, first)
    pi = begin
    for _ in range(rounds):
        parts = share * np.repeat(pi, sizes, axis=0)
        parts *= (n / parts.sum(axis=1))[:, None]
        pi = np.add.reduceat(parts, first, axis=0) / total[:, None]
    like = (share * np.repeat(pi, sizes, axis=0)).sum(axis=1)
    return pi, np.add.reduceat(n * np.log(like), first)


def mixtures(texts: list[str | None], model: Languages) -> np.ndarray:
    """Proportions (texts x languages) under the chosen set; zeros without a letter."""
    out = np.zeros((len(texts), len(model.names)))
    if not model.names:
        return out
    buckets, owner = trigrams(texts)
    if not len(buckets):
        return out
    pairs, n = np.unique(owner * BUCKETS + buckets, return_counts=True)
    owner, share = pairs // BUCKETS, model.shares[pairs % BUCKETS].astype(np.float64)
    # Only the ratio between languages matters within a trigram.
    share /= share.max(axis=1, keepdims=True)
    n = n.astype(np.float64)
    some, first = np.unique(owner, return_index=True)
    sizes = np.diff(np.append(first, len(n)))
    log_total = np.log(np.add.reduceat(n, first))
    alone = np.add.reduceat(n[:, None] * np.log(np.maximum(share, 1e-300)), first, axis=0)
    best = np.argmax(alone, axis=1)
    chosen = np.eye(len(model.names))[best]
    score = alone[np.arange(len(some)), best]
    even = np.full((len(some), len(model.names)), 1.0 / len(model.names))
    pi, like = _em(share, n, first, even)
    # No set can beat the full mixture's likelihood: few texts need a closer look.
    open_ = np.flatnonzero(like - 0.5 * log_total > score)
    for k in range(2, len(model.names) + 1) if len(open_) else ():
        rank = np.argsort(np.argsort(-pi[open_], axis=1, kind="stable"), axis=1)
        begin = np.where(rank < k, pi[open_] + 1e-6, 0.0)
        begin /= begin.sum(axis=1, keepdims=True)
        rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(some)), sizes), open_))
        own_first = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        got, gain = _em(share[rows], n[rows], own_first, begin)
        gain = gain - 0.5 * (k - 1) * log_total[open_]
        better = gain > score[open_]
        chosen[open_[better]] = got[better]
        score[open_[better]] = gain[better]
    out[some] = chosen
    return out


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, key, lang_pred, score, mixture): strongest language and its share of each text.

    ``mixture`` maps every language of the chosen set to its share.  A NULL text, one
    without a letter, or a model without languages gives ``und``, 0 and an empty map.
    Ties go to the first name.  Other columns, the label among them, are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores, maps = [], [], []
            for lo, hi in slices([len(t or "") for t in texts]):
                pi = mixtures(texts[lo:hi], model)
                for row in pi:
                    top = int(np.argmax(row)) if len(row) else 0
                    known = len(row) > 0 and row[top] > 0
                    names.append(model.names[top] if known else UNKNOWN)
                    scores.append(min(1.0, float(row[top])) if known else 0.0)
                    maps.append([(model.names[i], float(row[i])) for i in np.flatnonzero(row)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["id", "key", "lang_pred", "score", "mixture"])
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, key bigint, lang_pred string, score double, "
                                "mixture map<string,double>")


def keep_identified(docs: DataFrame, model: Languages, id_col: str = "doc_id",
                    text_col: str = "text", min_score: float = 1 / 3) -> DataFrame:
    """Rows of which one language holds at least ``min_score``; columns unchanged.

    Repeated rows are judged alike, so each stays or goes with its copies.
    """
    verdict = store(identify(docs, model, id_col, text_col)
                    .filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_score))
                    .select(F.col("id").alias("__lang_id"), F.col("key").alias("__lang_key"))
                    .distinct())
    marked = docs.withColumn("__lang_text", text_key(text_col))
    kept = marked.join(verdict, F.col(id_col).eqNullSafe(F.col("__lang_id"))
                       & (F.col("__lang_text") == F.col("__lang_key")), "left_anti")
    return kept.select(*docs.columns)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id leaves another remainder than 2 by 4."""
    return docs.filter(~is_remainder(id_col, 4, 2))
