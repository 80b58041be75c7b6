"""Shared small parts: reading, storing, row identity and blocks of texts for numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str) -> Column:
    """Tells rows of one id apart by their text; NULL and empty text differ."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array for NULL."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.filter(pieces, lambda w: w != "")


def is_remainder(doc_id: str, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; a NULL id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor)) == remainder


def small_enough(df: DataFrame, rows: int) -> bool:
    """Does a stored table hold at most so many rows?  Decides on a broadcast."""
    return df.limit(rows + 1).count() <= rows


def join_sized(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join that broadcasts the second side only after counting it; else it shuffles."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


# Texts as one byte array --------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# White space and ASCII punctuation: words without their commas and stops.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Word positions and word hashes of several texts, without a loop over words.

    A word's hash is its part of a running polynomial modulo 2**64, so that all words
    of the block are hashed at once, whatever their lengths.
    """

    def __init__(self, texts: Sequence[bytes | None], breaks: np.ndarray = SPACE,
                 lower: bool = True):
        plain = [t or b"" for t in texts]
        joined = np.frombuffer(b"\n".join(plain) + b"\n", dtype=np.uint8)
        self.bytes = _LOWER[joined] if lower else joined
        sizes = np.fromiter((len(t) for t in plain), np.int64, len(plain)) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        space = breaks[self.bytes]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        self.word_start = np.flatnonzero(edge == -1)
        self.word_end = np.flatnonzero(edge == 1)
        # First word of every text and, last, the number of words.
        self.first = np.searchsorted(self.word_start, np.append(self.starts, self.ends[-1:] if len(plain) else 0))
        self.n_words = np.diff(self.first)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each range."""
        up, down = _power_tables(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.bytes] * up[:len(self.bytes)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start])

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.word_start, self.word_end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


def slices(sizes: Sequence[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes in all; a longer text stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
