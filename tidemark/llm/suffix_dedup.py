"""Repeated byte strings across a corpus, by a difference cover and blockwise suffix sorting.

Positions whose index modulo v lies in a difference cover are the sample.  For any two
positions some shift below v makes both of them sample positions, so a string of ``length``
bytes at two places shows as two sample positions whose ``length`` - v + 1 bytes are equal.
Blocks of sample suffixes are sorted first; that rank says whether a sample suffix is tied
with another one.  Then the suffixes proper are sorted, one bucket at a time: only those
with a tied sample within v bytes enter, as all others have no equal, and a tie over
``length`` bytes means repetition.  A suffix enters as a 64-bit key of its first ``length``
bytes (equal strings have equal keys), so a comparison never walks a text and a bucket's
memory is bounded by its share of keys, however long the ties are.

Texts are cut into runs of a few megabytes, written once; keys travel as sorted blobs by
bucket and come back as one bit each.  A pair of unlike strings is taken for equal with a
chance of 2**-64.
"""

from __future__ import annotations

import uuid
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import _BYTE_CODE, _power_tables, join_sized, mix64, store

LENGTH = 400
RUN_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
TABLE_BYTES = 64 << 20
SLAB = 1 << 20
BROADCAST_ROWS = 100_000
ASK = "bucket bigint, run bigint, keys binary, twice binary"
ANSWER = "run bigint, bucket bigint, bits binary, hits bigint"
SPANS = "array<struct<start:bigint,end:bigint>>"


def difference_cover(length: int) -> tuple[int, list[int]]:
    """(v, cover): every difference modulo v occurs in the cover; v is at most half of ``length``.

    Covers of 6 r + 4 elements for v = 24 r * r + 36 r + 13; v = 1 for short lengths.
    """
    best = 1, [0]
    r = 0
    while 2 * (v := 24 * r * r + 36 * r + 13) <= length:
        steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
        best = v, [0, *np.cumsum(steps).tolist()][:6 * r + 4]
        r += 1
    return best


class Run:
    """Some texts in one byte array, and the places that a string of ``length`` may start at."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.v, cover = difference_cover(length)
        in_cover = np.zeros(self.v, dtype=bool)
        in_cover[cover] = True
        self.reach = length - self.v + 1
        sample, whole = [], []
        for at, n in zip(self.starts, self.sizes):
            place = np.arange(max(0, n - self.reach + 1))
            sample.append(at + place[in_cover[place % self.v]])
            whole.append((at, at + n - length + 1))
        self.sample = np.concatenate(sample) if sample else np.zeros(0, np.int64)
        self.whole = whole

    def keys(self, places: np.ndarray, length: int) -> np.ndarray:
        """64-bit keys of the strings of ``length`` at sorted places, slab by slab."""
        out = np.zeros(len(places), dtype=np.uint64)
        up, down = _power_tables(SLAB + length + 1)
        for begin in range(0, len(self.bytes), SLAB):
            lo, hi = np.searchsorted(places, (begin, begin + SLAB))
            if lo == hi:
                continue
            block = self.bytes[begin:begin + SLAB + length]
            sums = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[block] * up[:len(block)], out=sums[1:])
            at = places[lo:hi] - begin
            out[lo:hi] = mix64((sums[at + length] - sums[at]) * down[at])
        return out

    def _within(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes that lie in one of the ranges."""
        edge = np.zeros(len(self.bytes) + 1, dtype=np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1]) > 0

    def suffixes(self, tied: np.ndarray) -> np.ndarray:
        """Places whose whole string may recur: a tied sample lies within v bytes from there on."""
        first = np.repeat(self.starts, self.sizes)
        near = self._within(np.maximum(first[tied], tied - self.v + 1), tied + 1)
        fits = np.zeros(len(self.bytes), dtype=bool)
        for lo, hi in self.whole:
            fits[lo:max(lo, hi)] = True
        return np.flatnonzero(near & fits)

    def covered(self, places: np.ndarray) -> np.ndarray:
        return self._within(places, places + self.length)


def _edges(buckets: int) -> np.ndarray:
    """First key of every bucket but the first; ``buckets`` is a power of two."""
    step = 2**64 // buckets
    return np.array([k * step for k in range(1, buckets)], dtype=np.uint64)


def _asked(run: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket with keys: sorted distinct keys, and whether the run holds each twice.

    Bytes of equal weight stand together: sorted keys share their leading bytes.
    """
    own, times = np.unique(keys, return_counts=True)
    cuts = [0, *np.searchsorted(own, _edges(buckets)).tolist(), len(own)]
    rows = [(b, own[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), np.packbits(times[lo:hi] > 1).tobytes())
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "run": pa.array([run] * len(rows), pa.int64()),
                     "keys": pa.array([r[1] for r in rows], pa.binary()), "twice": pa.array([r[2] for r in rows], pa.binary())})


def _plain(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _answered(table: pa.Table) -> pa.Table:
    """Sort one bucket of keys; a bit for each key of each run: does it occur twice?"""
    own = [_plain(k) for k in table.column("keys").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool)
             for t, k in zip(table.column("twice").to_pylist(), own)]
    keys = np.sort(np.concatenate(own))
    tied = np.unique(np.concatenate([keys[1:][keys[1:] == keys[:-1]], *[k[t] for k, t in zip(own, twice)]]))
    bits = []
    for k in own:
        at = np.searchsorted(tied, k)
        at[at == len(tied)] = 0
        bits.append(tied[at] == k if len(tied) else np.zeros(len(k), bool))
    return pa.table({"run": table.column("run"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
                     "hits": pa.array([int(b.sum()) for b in bits], pa.int64())})


def _marked(keys: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The bits of a run's answers, in the order of ``keys``."""
    own, back = np.unique(keys, return_inverse=True)
    cuts = [0, *np.searchsorted(own, _edges(buckets)).tolist(), len(own)]
    flags = np.zeros(len(own), dtype=bool)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        lo, hi = cuts[b], cuts[b + 1]
        flags[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo).astype(bool)
    return flags[back]


def _buckets(n_bytes: float, least: int) -> int:
    return 1 << max(least, ceil(n_bytes / BUCKET_BYTES) - 1).bit_length()


def _write_runs(texts: DataFrame, n_bytes: int) -> DataFrame:
    """(run, id, copied, text) as a bucketed table, so that later passes don't shuffle texts."""
    spark = texts.sparkSession
    runs = max(1, ceil(n_bytes / RUN_BYTES))
    parts = min(20_000, max(2 * spark.sparkContext.defaultParallelism, ceil(n_bytes / TABLE_BYTES)))
    name = f"runs_{uuid.uuid4().hex}"
    (texts.select(F.pmod(F.xxhash64("digest"), F.lit(runs)).alias("run"), "id", "copied", "text")
     .repartition(parts, "run").write.bucketBy(parts, "run").sortBy("run")
     .option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    table = spark.table(name)
    # The files stay; only the name goes.
    spark.sql(f"DROP TABLE {name}")
    return table


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row.

    ``spans`` are the maximal ranges of bytes (UTF-8, end exclusive) covered by strings of
    ``length`` bytes that start at two places or more, of any texts or of one; ``kept`` is
    what is left, as bytes, since a cut may fall within a character.  Strings don't cross texts.  A NULL text counts as empty.  Equal texts are
    searched once; each of them goes whole if it has ``length`` bytes.
    """
    if length < 1:
        raise ValueError("length must be positive")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("id", "text", F.length("text").cast("bigint").alias("n_bytes"),
                       F.unhex(F.md5("text")).alias("digest"))
    long = F.col("n_bytes") >= length
    copies = store(rows.filter(long).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select("digest", F.lit(True).alias("copied")))
    marked = join_sized(rows, copies, "digest", "left", BROADCAST_ROWS).withColumn("copied", F.coalesce("copied", F.lit(False)))
    kind = rows.schema["id"].dataType.simpleString()
    span = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    plain = marked.filter(~long | F.col("copied")).select(
        "id", "n_bytes", F.when(F.col("copied"), span).otherwise(F.array().cast(SPANS)).alias("spans"),
        F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("text")).alias("kept"))
    first = (marked.filter("copied").groupBy("digest").agg(F.first("text").alias("text"))
             .select("digest", F.lit(None).cast(kind).alias("id"), F.lit(True).alias("copied"), "text"))
    searched = marked.filter(long & ~F.col("copied")).select("digest", "id", "copied", "text").unionByName(first)
    n_bytes = rows.filter(long).agg(F.sum("n_bytes")).first()[0]
    if not n_bytes:
        return plain
    runs = _write_runs(searched, n_bytes)
    v, cover = difference_cover(length)
    least = 4 * docs.sparkSession.sparkContext.defaultParallelism
    blocks = _buckets(8 * n_bytes * len(cover) / v, least)

    def sample(key, table):
        run = Run(table.column("text").to_pylist(), length)
        return _asked(key[0].as_py(), run.keys(run.sample, run.reach), blocks)
    ties = store(runs.groupBy("run").applyInArrow(sample, ASK).groupBy("bucket").applyInArrow(_answered, ANSWER))
    hits = ties.agg(F.sum("hits")).first()[0] or 0
    buckets = _buckets(8 * min(n_bytes, hits * v / len(cover)), least)

    def places(table, answers):
        run = Run(table.column("text").to_pylist(), length)
        tied = run.sample[_marked(run.keys(run.sample, run.reach), answers, blocks)]
        return run, run.suffixes(tied)

    def suffixes(key, table, answers):
        run, at = places(table, answers)
        return _asked(key[0].as_py(), run.keys(at, length), buckets)
    asked = runs.groupBy("run").cogroup(ties.groupBy("run")).applyInArrow(suffixes, ASK)
    again = store(asked.groupBy("bucket").applyInArrow(_answered, ANSWER))
    answers = ties.withColumn("of", F.lit(0)).unionByName(again.withColumn("of", F.lit(1)))

    def cut(key, table, answers):
        of = answers.column("of").to_numpy()
        run, at = places(table, answers.filter(pa.array(of == 0)))
        again = at[_marked(run.keys(at, length), answers.filter(pa.array(of == 1)), buckets)]
        gone = run.covered(again)
        out = []
        for (i, copied), start, n in zip(zip(table.column("id").to_pylist(), table.column("copied").to_pylist()),
                                         run.starts, run.sizes):
            if copied:
                continue
            own = gone[start:start + n]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            pairs = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
            out.append((i, int(n), pairs, run.bytes[start:start + n][~own].tobytes()))
        columns = list(zip(*out)) or [(), (), (), ()]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(columns[0], table.schema.field("id").type), "n_bytes": pa.array(columns[1], pa.int64()),
                         "spans": pa.array(columns[2], spans), "kept": pa.array(columns[3], pa.binary())})
    found = (runs.groupBy("run").cogroup(answers.groupBy("run"))
             .applyInArrow(cut, f"id {kind}, n_bytes bigint, spans {SPANS}, kept binary"))
    return found.unionByName(plain)

