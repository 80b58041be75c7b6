"""SimHash near-duplicates: fingerprints linked by a pigeonring search.

The 64 bits are m segments on a ring.  If two fingerprints differ in at most t bits,
some segment starts a chain in which the first l segments together differ in at most
l * t / m bits, for every l up to m.  The join key is a chain of two segments: the first
equal, the second equal or off by the bits its budget allows.  Longer chains prune the
joined pairs before the full Hamming distance is taken.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_key
from .components import components

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
SEED = 42
SLAB = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 without words.

    A bit is set if it is set in over half of the shingles' XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        shingles = zip(words)
    else:
        shingles = zip(*[words[i:] for i in range(width)])
    digest, join = xxhash.xxh64_intdigest, b" ".join
    values = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)
    n = len(values)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, SLAB):
        bits = values[at:at + SLAB].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): a row per row; ``key`` tells rows of one id apart by text.

    A NULL or empty text has fingerprint 0.  Other columns of ``docs`` are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                names=["id", "key", "fp"])
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, key bigint, fp bigint")


def _rotated(fp: Column, by: int) -> Column:
    """The ring read from bit ``by`` on."""
    if by == 0:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(points: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) for distinct fingerprints a < b with at most ``distance`` differing bits.

    ``points`` has a column fp of distinct values.  Every such pair is found: the chain
    condition holds for some start, whichever bits differ.
    """
    if BITS % segments or segments < 2 or distance >= segments:
        raise ValueError("segments must divide 64 and outnumber the differing bits")
    width = BITS // segments
    budget = [length * distance // segments for length in range(segments + 1)]
    starts = range(segments)
    # Differences of the second segment within the budget of a chain of two.
    flips = [0] + [sum(1 << i for i in some) for k in range(1, budget[2] + 1)
                   for some in combinations(range(width), k)]

    def chain(start: int) -> Column:
        return F.shiftrightunsigned(_rotated(F.col("fp"), start * width), BITS - 2 * width)
    held = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), chain(s).alias("chain"))
                               for s in starts]))
    stored = points.select(F.col("fp").alias("b"), held.alias("h")).select("b", "h.*")
    flip = F.explode(F.lit(flips).cast("array<bigint>"))
    asked = (points.select(F.col("fp").alias("a"), held.alias("h")).select("a", "h.start", "h.chain", flip.alias("flip"))
             .select("a", "start", F.col("chain").bitwiseXOR(F.col("flip")).alias("chain")))
    # Spark takes both sides for as small as their fingerprints before the explosions, and would
    # broadcast one of them with its 4 or 68 rows for each.
    pairs = asked.hint("merge").join(stored, ["start", "chain"]).filter("a < b")
    off = F.col("a").bitwiseXOR(F.col("b"))
    near = F.bit_count(off) <= distance
    for length in range(3, segments):
        for_start = F.lit(False)
        for s in starts:
            part = F.shiftrightunsigned(_rotated(off, s * width), BITS - length * width)
            for_start = for_start | ((F.col("start") == s) & (F.bit_count(part) <= budget[length]))
        near = for_start & near
    return pairs.filter(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(id, key, fp, component): component is the smallest id reachable by links.

    Rows of one fingerprint meet in one representative before the search, so copies
    cost no pairs.  A NULL id never is a component's name unless all ids are NULL.
    """
    rows = store(fingerprints(docs, id_col, text_col))
    points = store(rows.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(links(points.select("fp"), distance, segments))
    rooted = points.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    names = store(rooted.join(named, "root").select("fp", "component"))
    return rows.join(names, "fp").select("id", "key", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The document with the smallest id of every component, columns unchanged.

    Rows that repeat an id are told apart by text; of equal rows one stays.
    """
    found = near_duplicates(docs, id_col, text_col, distance, segments)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key"))
    chosen = (found.groupBy("component").agg(first.alias("first"))
              .select(F.col("first.id").alias("__simhash_id"), F.col("first.key").alias("__simhash_key")))
    marked = docs.withColumn("__simhash_text", text_key(text_col))
    kept = marked.join(chosen, F.col(id_col).eqNullSafe(F.col("__simhash_id"))
                       & (F.col("__simhash_text") == F.col("__simhash_key")), "left_semi")
    return kept.dropDuplicates([id_col, "__simhash_text"]).select(*docs.columns)
