"""Line deduplication by a fixed-depth template tree.

A line falls into the leaf named by its number of words and its leading words, words with
a digit counting as variable.  Within a leaf, a word that at its position occurs in too few
documents is a variable field as well; what remains is the line's template.  Templates that
recur across documents are dropped, but for the first line that shows them.  Long lines
need no template: one that stands word for word in an earlier document is dropped as well.

Texts are cut into lines and words in numpy blocks, where a line gets three hashes: of its
leaf, of its words and of its words with numbers masked.  All else is an aggregation or an
equi-join on hashes, so neither a leaf nor a template has to fit into a task: copies of a
line are one row before its words are spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, join_sized, mix64, slices, store, text_key

DEPTH = 3
MIN_DOCS = 5
MIN_WORDS = 5
LONG_WORDS = 20
MIN_FIXED = 0.7
MIN_LEFT = 0.2
VARIABLE = Block([b"<*>"]).word_hashes()[0]
STEP, SIZE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
BROADCAST_ROWS = 200_000


class Lines:
    """The lines of several texts and 64-bit hashes of them; a missing text has none.

    ``words`` is a line's words as they are, ``masked`` the same with each word with a digit
    as ``VARIABLE``, ``leaf`` their number and the first ``depth`` of the latter.
    """

    def __init__(self, texts: Sequence[bytes | None], depth: int):
        block = Block(texts, lower=False)
        end = np.flatnonzero(block.bytes == 10)
        own = np.searchsorted(block.ends, end, "right")
        first = np.searchsorted(block.word_start, np.concatenate([[0], end[:-1] + 1]))
        self.at = np.arange(len(end)) - np.searchsorted(own, np.arange(len(texts)))[own]
        self.text, self.first = own, first
        self.n_words = np.diff(first, append=len(block.word_start))
        plain = block.word_hashes()
        digit = np.flatnonzero((block.bytes >= 48) & (block.bytes <= 57))
        self.word = plain.copy()
        self.word[np.searchsorted(block.word_start, digit, "right") - 1] = VARIABLE
        place = np.arange(len(plain)) - np.repeat(first, self.n_words)
        masked = self._placed(self.word, place)
        self.words, self.masked = self._line(self._placed(plain, place)), self._line(masked)
        self.leaf = self._line(np.where(place < depth, masked, np.uint64(0)))
        self.real = np.array([t is not None for t in texts], bool)[own]

    @staticmethod
    def _placed(word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix64(word + (place + 1).astype(np.uint64) * STEP)

    def _line(self, placed: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed)])
        n = self.n_words
        return mix64(sums[self.first + n] - sums[self.first] + n.astype(np.uint64) * SIZE).view(np.int64)


def _blocks(batches, column: int, depth: int):
    """(batch, first row, lines) block by block; ``column`` holds the texts."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for lo, hi in slices([len(t or b"") for t in texts]):
            yield batch, lo, Lines(texts[lo:hi], depth)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(id, key, at, n_words, leaf, hash, words) for every line of a text; hashes as in ``Lines``."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))

    def cut(batches):
        for batch, lo, lines in _blocks(batches, 2, depth):
            real = np.flatnonzero(lines.real)
            row = pa.array(lines.text[real] + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(lines.at[real], pa.int32()),
                 pa.array(lines.n_words[real], pa.int32()), *[pa.array(h[real]) for h in (lines.leaf, lines.masked, lines.words)]],
                names=["id", "key", "at", "n_words", "leaf", "hash", "words"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, key bigint, at int, n_words int, leaf bigint, hash bigint, words bigint")


def _line_words(docs: DataFrame, text_col: str, depth: int, min_words: int) -> DataFrame:
    """(leaf, hash, words) for every line of ``min_words`` or more: hashes of its words, numbers masked."""
    def cut(batches):
        for _, _, lines in _blocks(batches, 0, depth):
            long = np.flatnonzero(lines.real & (lines.n_words >= min_words))
            n = lines.n_words[long]
            ends = np.cumsum(n)
            at = np.repeat(lines.first[long] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            words = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(lines.word[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[long]), pa.array(lines.masked[long]), words],
                                             names=["leaf", "hash", "words"])
    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(
        cut, "leaf bigint, hash bigint, words array<bigint>")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "at")


def repeated_passages(lines: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, key, at, gone) of long lines that stand word for word in two or more documents.

    ``gone`` is 0 for the first place (by id, NULL last, then text key and position), else 1.
    """
    long = lines.filter(F.col("n_words") >= long_words)
    place = _place()
    # Two documents hold a line if its first and its last place differ in the document.
    again = (long.groupBy("words").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter(~(F.col("first.id").eqNullSafe(F.col("last.id"))
                       & (F.col("first.key") == F.col("last.key")))))
    again = store(again.select("words", F.col("first.id").alias("first_id"),
                               F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at")))
    here = (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
            & (F.col("at") == F.col("first_at")))
    return store(join_sized(long, again, "words", "inner", BROADCAST_ROWS)
                 .select("id", "key", "at", F.when(here, 0).otherwise(1).alias("gone")))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    depth: int = DEPTH, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS,
                    min_fixed: float = MIN_FIXED) -> tuple[DataFrame, DataFrame]:
    """All lines (id, key, at, n_words, leaf, hash, words), and those dropped (with their template).

    ``words`` is a hash of the line's words as they are, ``hash`` one with numbers masked.
    A template counts if it has ``min_words`` words, at least the share ``min_fixed`` of
    them fixed, and ``min_docs`` documents show it.  Repeated rows (same id and text) are
    one document.  The first line that shows a template (by id, NULL last, then text key
    and position) isn't dropped.  NULL texts have no lines.
    """
    lines = store(_lines(docs, id_col, text_col, depth))
    long = lines.filter(F.col("n_words") >= min_words)
    leaves = store(long.select("leaf", "id", "key").distinct().groupBy("leaf")
                   .agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
                   .select("leaf"))
    shown = (long.select("leaf", "hash", "id", "key").distinct()
             .groupBy("leaf", "hash").agg(F.count(F.lit(1)).alias("docs")))
    # One row for each distinct line of a leaf that recurs, then one for each of its words.
    texts = (join_sized(_line_words(docs, text_col, depth, min_words), leaves, "leaf", "left_semi", BROADCAST_ROWS)
             .groupBy("leaf", "hash").agg(F.first("words").alias("words")))
    spread = store(texts.join(shown, ["leaf", "hash"])
                   .select("leaf", "hash", "docs", F.posexplode("words").alias("at", "word")))
    variable = F.lit(int(VARIABLE.view(np.int64)))
    support = (spread.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("support"))
               .filter((F.col("support") >= min_docs) & (F.col("word") != variable))
               .select("leaf", "at", "word", F.lit(True).alias("fixed")))
    # Stored tables on the joins' small sides: a hot key is broadcast, or split by Spark.
    fields = join_sized(spread, store(support), ["leaf", "at", "word"], "left", BROADCAST_ROWS)
    field = F.when(F.col("fixed"), F.xxhash64("at", "word")).otherwise(F.xxhash64("at", variable))
    templates = (fields.groupBy("leaf", "hash")
                 .agg(F.bit_xor(field).alias("template"), F.count("fixed").alias("fixed"),
                      F.count(F.lit(1)).alias("words"))
                 .filter(F.col("fixed") >= F.col("words") * F.lit(min_fixed))
                 .select("leaf", "hash", "template"))
    members = store(join_sized(long, store(templates), ["leaf", "hash"], "inner", BROADCAST_ROWS)
                    .select("leaf", "template", "id", "key", "at"))
    place = _place()
    # Twice: per document first, so that a common template's documents are counted in parts.
    often = (members.groupBy("leaf", "template", "id", "key").agg(F.min("at").alias("at"))
             .groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"),
                                              F.min(place).alias("first"))
             .filter(F.col("docs") >= min_docs))
    first = F.col("first")
    dropped = join_sized(members, store(often), ["leaf", "template"], "inner", BROADCAST_ROWS).filter(
        ~(F.col("id").eqNullSafe(first["id"]) & (F.col("key") == first["key"])
          & (F.col("at") == first["at"])))
    return lines, dropped.select("id", "key", "at", "leaf", "template")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_left: float = MIN_LEFT, long_words: int = LONG_WORDS, **rules) -> DataFrame:
    """All rows and columns, with ``text_col`` cut, and three columns more.

    ``__n_lines`` and ``__n_dropped`` count lines; ``__kept`` is false where lines were
    dropped and less than ``min_left`` of the words is left, unless the first place of a
    long line that others lose is there and stays.  Lines that stay keep their
    order and form.  A NULL text stays NULL with 0 lines; an empty one has one line.
    """
    lines, dropped = recurring_lines(docs, id_col, text_col, **rules)
    passages = repeated_passages(lines, long_words)
    gone = dropped.select("id", "key", "at").unionByName(
        passages.filter("gone = 1").select("id", "key", "at")).distinct().withColumn("gone", F.lit(1))
    only = passages.filter("gone = 0").select("id", "key", "at", F.lit(0).alias("n_words"),
                                              F.lit(0).alias("gone"), F.lit(1).alias("only"))
    # Only documents that lose lines are gathered here.
    marks = (lines.select("id", "key", "at", "n_words", F.lit(0).alias("gone"))
             .join(gone.select("id", "key").distinct(),
                   lines["id"].eqNullSafe(gone["id"]) & (lines["key"] == gone["key"]), "left_semi")
             .withColumn("only", F.lit(0)).unionByName(gone.withColumns({"n_words": F.lit(0), "only": F.lit(0)}))
             .unionByName(only))
    cut = (marks.groupBy("id", "key", "at").agg(F.max("n_words").alias("n"), F.max("gone").alias("gone"),
                                                F.max("only").alias("only"))
           .groupBy("id", "key").agg(
               F.collect_list(F.when(F.col("gone") == 1, F.col("at"))).alias("__cut"),
               F.sum("n").alias("__all"),
               F.sum(F.when(F.col("gone") == 0, F.col("n")).otherwise(0)).alias("__rest"),
               F.max(F.when(F.col("gone") == 0, F.col("only")).otherwise(0)).alias("__only"))
           .filter(F.size("__cut") > 0)
           .select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__cut", "__all", "__rest", "__only"))
    joined = docs.withColumn("__text", text_key(text_col)).join(
        cut, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("__cut", i)), "\n")
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(left)
    kept = F.coalesce((F.col("__rest") >= F.col("__all") * F.lit(min_left)) | (F.col("__only") == 1), F.lit(True))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).alias("__n_lines"),
        F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).alias("__n_dropped"),
        kept.alias("__kept"))
