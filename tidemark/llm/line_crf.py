"""Quality by line labels: a linear-chain conditional random field with Viterbi decoding.

Every line of a text is content or boilerplate.  Features of the line and the label of the
line before it decide; the best sequence of the whole text is decoded, and the share of
words on content lines decides whether a document stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, mix64, slices, text_key

TRAIN_DOCS = 2_000
CHAIN = 64
STEPS = 100
RATE = 0.2
PENALTY = 0.01
MIN_CONTENT = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "no_word", "words_1_2", "words_3_5", "words_6_10", "words_11_20", "words_over_20",
            "symbols_10", "symbols_50", "upper_30", "upper_70", "digits_10", "calls_50", "bars_30",
            "repeats_30", "repeats_60", "sentence_end", "capital_start", "seen_before",
            "short_words", "long_words", "first_line", "last_line")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASSES = {"symbol": _table(SYMBOLS), "upper": _table(bytes(range(65, 91))), "digit": _table(b"0123456789"),
            "call": _table(b"!"), "bar": _table(b"|"),
            # A character's first byte, other than white space.
            "char": np.array([b & 0xC0 != 0x80 and b not in (32, 9, 10, 11, 12, 13) for b in range(256)])}


class Lines:
    """Lines of several texts with their features, and the texts' base counts."""

    def __init__(self, texts: list[bytes | None]):
        block = Block(texts, lower=False)
        data = block.bytes
        end = np.flatnonzero(data == 10)
        start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
        self.first = np.searchsorted(start, np.append(block.starts, len(data)))
        self.n_lines = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n_lines)), self.n_lines)
        first_word = np.searchsorted(block.word_start, np.append(start, len(data)))
        self.words = np.diff(first_word)
        counts = {}
        for name, table in _CLASSES.items():
            total = np.concatenate([[0], np.cumsum(table[data])])
            counts[name] = total[end] - total[start]
        word = block.word_hashes()
        line_of_word = np.repeat(np.arange(len(start)), self.words)
        _, own = np.unique(mix64(word ^ mix64(line_of_word.astype(np.uint64) + np.uint64(1))), return_index=True)
        distinct = np.bincount(line_of_word[own], minlength=len(start))
        line = mix64(block.hashes(start, end) ^ mix64(self.text.astype(np.uint64) + np.uint64(1)))
        # Stable sort: the first of equal lines is the earliest.
        _, fresh = np.unique(line, return_index=True)
        again = np.ones(len(line), bool)
        again[fresh] = False
        self.again = again & (self.words > 0)

        self.n_words = block.n_words
        self.word_chars = np.add.reduceat(counts["char"], self.first[:-1])
        self.n_symbols = np.add.reduceat(counts["symbol"], self.first[:-1])
        self.n_dup_lines = np.bincount(self.text[self.again], minlength=len(self.n_words))
        self.n_repeat_words = _repeated(word, block.first)

        w = np.maximum(self.words, 1)
        chars = np.maximum(counts["char"], 1)
        last = np.maximum(end - 1, start)
        head = data[np.minimum(block.word_start[np.minimum(first_word[:-1], max(len(word) - 1, 0))], len(data) - 1)] \
            if len(word) else data[start]
        repeats = (self.words - distinct) / w
        position = np.arange(len(start)) - self.first[self.text]
        self.features = np.stack([
            np.ones(len(start), bool), self.words == 0, (self.words > 0) & (self.words <= 2),
            (self.words >= 3) & (self.words <= 5), (self.words >= 6) & (self.words <= 10),
            (self.words >= 11) & (self.words <= 20), self.words > 20,
            counts["symbol"] > 0.1 * w, counts["symbol"] > 0.5 * w,
            counts["upper"] > 0.3 * chars, counts["upper"] > 0.7 * chars, counts["digit"] > 0.1 * chars,
            counts["call"] > 0.5 * w, counts["bar"] > 0.3 * w, repeats > 0.3, repeats > 0.6,
            np.isin(data[last], list(b".!?")) & (end > start), (head >= 65) & (head <= 90) | (head >= 0xC3),
            self.again, chars < 3 * w, chars > 9 * w, position == 0,
            position == self.n_lines[self.text] - 1], axis=1).astype(np.float32)


def _repeated(word: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more there."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    if len(word) < width:
        return np.zeros(texts, np.int64)
    n = len(word) - width + 1
    inside = text[:n] == text[width - 1:]
    window = mix64(text[:n].astype(np.uint64) + np.uint64(1))
    for i in range(width):
        window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + word[i:n + i])
    at = np.flatnonzero(inside)
    _, back, times = np.unique(window[at], return_inverse=True, return_counts=True)
    hit = at[times[back] >= 2]
    marked = np.zeros(len(word), bool)
    for i in range(width):
        marked[hit + i] = True
    return np.bincount(text[marked], minlength=texts)


@dataclass(frozen=True)
class Field:
    """Weights of the features for content (against boilerplate) and of label changes."""

    weight: np.ndarray
    change: np.ndarray

    def content(self, lines: Lines) -> np.ndarray:
        """Viterbi: is each line content?  All texts of the block take a step together."""
        score = lines.features @ self.weight
        emit = np.stack([np.zeros_like(score), score], axis=1)
        order = np.argsort(-lines.n_lines, kind="stable")
        first, n = lines.first[:-1][order], lines.n_lines[order]
        back = np.zeros(emit.shape, np.int8)
        best = emit[first].copy()
        ends = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
        for t in range(1, len(ends)):
            k = ends[t]
            paths = best[:k, :, None] + self.change
            back[first[:k] + t] = paths.argmax(axis=1)
            best[:k] = paths.max(axis=1) + emit[first[:k] + t]
        label = np.zeros(len(emit), np.int8)
        state = best.argmax(axis=1)
        label[first + n - 1] = state
        for t in range(len(ends) - 1, 0, -1):
            k = ends[t]
            state[:k] = back[first[:k] + t, state[:k]]
            label[first[:k] + t - 1] = state[:k]
        return label == 1


def fit(features: np.ndarray, chain: np.ndarray, label: np.ndarray) -> Field:
    """Penalised maximum likelihood by gradient steps (Adam).

    ``chain`` numbers the sequences, in order; ``label`` is 1 for content.  Forward and
    backward sums run over all sequences at once.  Long sequences are cut at ``CHAIN``.
    """
    place = np.arange(len(chain)) - np.searchsorted(chain, chain)
    _, row = np.unique(chain * 1_000_000 + place // CHAIN, return_inverse=True)
    col = place % CHAIN
    n, f = row.max() + 1, features.shape[1]
    x = np.zeros((n, CHAIN, f), np.float32)
    y = np.zeros((n, CHAIN), np.int64)
    on = np.zeros((n, CHAIN), bool)
    x[row, col], y[row, col], on[row, col] = features, label, True
    pair = on[:, 1:] & on[:, :-1]
    change_seen = np.zeros((2, 2))
    np.add.at(change_seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    seen = (features * label[:, None]).sum(axis=0)
    theta = np.zeros(f + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    count = on.sum()
    for step in range(1, STEPS + 1):
        weight, change = theta[:f], theta[f:].reshape(2, 2)
        emit = np.stack([np.zeros((n, CHAIN)), x @ weight], axis=2)
        fore, rear = np.zeros((n, CHAIN, 2)), np.zeros((n, CHAIN, 2))
        fore[:, 0] = emit[:, 0]
        for t in range(1, CHAIN):
            fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + change, axis=1) + emit[:, t]
        for t in range(CHAIN - 2, -1, -1):
            nxt = np.logaddexp.reduce(change + (emit[:, t + 1] + rear[:, t + 1])[:, None, :], axis=2)
            rear[:, t] = np.where(on[:, t + 1, None], nxt, 0.0)
        both = fore + rear
        z = np.logaddexp.reduce(both, axis=2)
        p = np.exp(both[:, :, 1] - z) * on
        joint = np.exp(fore[:, :-1, :, None] + change + (emit + rear)[:, 1:, None, :] - z[:, 1:, None, None])
        grad = np.concatenate([seen - np.einsum("nt,ntf->f", p, x),
                               (change_seen - (joint * pair[:, :, None, None]).sum(axis=(0, 1))).ravel()])
        grad = grad / count - PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Field(theta[:f].astype(np.float32), theta[f:].reshape(2, 2).astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Field | None:
    """Field from documents labelled good (1) or bad (0); None where one kind is absent.

    Lines take their document's label; the better one where several are given.  At most about ``train_docs`` labelled documents,
    chosen by hash of the id, are fitted; their lines' features reach the driver.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).select(
        F.col(label_id).cast("string").alias("id"), F.col(label_col).cast("int").alias("good")).groupBy("id").agg(
        F.max("good").alias("good"))
    part = max(1, known.count() // train_docs)
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(part)) == 0)
    texts = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).filter(
        F.pmod(F.xxhash64("id"), F.lit(part)) == 0)
    sample = texts.join(chosen, "id").select("text", "good")

    def lines(batches):
        for batch in batches:
            texts, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for t, g in zip(texts, good):
                found = Lines([t])
                rows.append((g, np.packbits(found.features.astype(bool), axis=1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["good", "lines"])
    got = sample.mapInArrow(lines, "good int, lines binary").collect()
    if {r["good"] for r in got} != {0, 1}:
        return None
    # A defined order, so that the same rows give the same field.
    got.sort(key=lambda r: (r["good"], bytes(r["lines"])))
    width = -(-len(FEATURES) // 8)
    parts = [np.frombuffer(r["lines"], np.uint8).reshape(-1, width) for r in got]
    sizes = [len(p) for p in parts]
    features = np.unpackbits(np.concatenate(parts), axis=1)[:, :len(FEATURES)].astype(np.float32)
    chain = np.repeat(np.arange(len(parts)), sizes)
    return fit(features, chain, np.repeat([r["good"] for r in got], sizes))


def rate(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text",
         min_content: float = MIN_CONTENT) -> DataFrame:
    """A row per row: id, key, base counts, base_failed, content share, kept.

    A NULL text counts as empty: no words, so it fails.  Without a field every line is
    content.  ``content`` is the share of words on content lines (0 without words).
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts, failed, share = {n: [] for n in names}, [], []
            for lo, hi in slices([len(t or b"") for t in texts]):
                lines = Lines(texts[lo:hi])
                good = field.content(lines) if field else np.ones(len(lines.words), bool)
                inside = np.add.reduceat(lines.words * good, lines.first[:-1])
                for n in names:
                    counts[n].append(getattr(lines, n).astype(np.int64))
                failed.append((lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > 50 * lines.n_words))
                share.append(inside / np.maximum(lines.n_words, 1))

            def column(parts, kind):
                return pa.array(np.concatenate(parts) if parts else [], kind)
            bad, part = column(failed, pa.bool_()), column(share, pa.float64())
            kept = [not b and s >= min_content for b, s in zip(bad.to_pylist(), part.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[column(counts[n], pa.int64()) for n in names],
                 bad, part, pa.array(kept, pa.bool_())],
                names=["id", "key", *names, "base_failed", "content", "kept"])
    kind = slim.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{n} bigint" for n in names)
    return slim.mapInArrow(run, f"id {kind}, key bigint, {longs}, base_failed boolean, content double, kept boolean")
