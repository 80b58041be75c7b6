"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped.

Tasks count the bigrams of their documents by hash; shards of the hash space are merged
into sorted arrays, written to the shared folder, and mapped by the workers that score.
A shard holds its part of the bigrams, not of the words, so a frequent word is spread
over all shards.  Words' own counts follow from the merged bigrams: how often a word is
followed, by how many words once, twice and more often, and after how many words it stands.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import Block, is_remainder, mix64, slices, text_key

SHARD_TOKENS = 1 << 21
FLUSH_TOKENS = 1 << 22
SCORE_BYTES = 1 << 22
BYTES_PER_TOKEN = 6
ALPHA = 0.1
#: Stand for the start and the end of a text; words hash to these by chance only.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)
WORD_COLUMNS = ("raw", "followed", "once", "twice", "often", "after")


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends, of what stands before each, and the texts' sizes."""
    word, sizes = [], []
    for lo, hi in slices([len(t or b"") for t in texts]):
        block = Block(texts[lo:hi])
        ends = block.first[1:] + np.arange(len(block.n_words))
        own = np.full(len(block.word_start) + len(ends), END, np.uint64)
        inside = np.ones(len(own), bool)
        inside[ends] = False
        own[inside] = block.word_hashes()
        word.append(own)
        sizes.append(block.n_words + 1)
    if not word:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, sizes = np.concatenate(word), np.concatenate(sizes)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return word, before, sizes


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so shards in order are the sorted whole."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _pack(columns: list[np.ndarray]) -> bytes:
    parts = [_narrow(c) for c in columns]
    head = bytes([len(parts), *[p.dtype.itemsize for p in parts]]) + len(columns[0]).to_bytes(8, "little")
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k, n = raw[0], int.from_bytes(raw[1 + raw[0]:9 + raw[0]], "little")
    at, out = 9 + k, []
    for size in raw[1:1 + k]:
        out.append(np.frombuffer(raw, f"<u{size}", n, at).astype(np.uint64))
        at += size * n
    return out


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, a row of each, and the columns' sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], [np.add.reduceat(c[order], first) if len(keys) else c for c in columns]


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that runs again writes the same file again."""
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        np.save(out, array)
    os.replace(temporary, f"{folder}/{name}.npy")


def _rows(shards, payloads):
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())],
                                      names=["shard", "data"])


def _count(shards: int):
    """Bigrams of a task's texts: (shard, packed before, word, count)."""
    def flush(held):
        before, word = (np.concatenate(x) for x in zip(*held))
        key = bigram(before, word)
        keys, row, (n,) = _sums(key, [np.ones(len(key), np.uint64)])
        before, word, place = before[row], word[row], shard_of(keys, shards)
        cuts = np.searchsorted(place, np.arange(shards + 1))
        for s in range(shards):
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo:
                # Sorted by the word before, which is kept once for all that follow it.
                order = np.argsort(before[lo:hi], kind="stable") + lo
                new = np.concatenate([[True], np.diff(before[order]) != 0])
                yield s, b"".join(_framed([before[order][new]], [np.diff(np.append(np.flatnonzero(new), hi - lo))],
                                          [word[order], n[order]]))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts], SCORE_BYTES):
                word, before, _ = tokens(texts[lo:hi])
                held.append((before, word))
                size += len(word)
                if size >= FLUSH_TOKENS:
                    yield _rows(*zip(*flush(held)))
                    held, size = [], 0
        if size:
            yield _rows(*zip(*flush(held)))
    return run


def _framed(*groups: list[np.ndarray]) -> list[bytes]:
    out = []
    for g in groups:
        data = _pack(g)
        out += [len(data).to_bytes(8, "little"), data]
    return out


def _unframed(data: bytes) -> list[list[np.ndarray]]:
    at, out = 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(_unpack(data[at + 8:at + 8 + size]))
        at += 8 + size
    return out


def _merge(folder: str, word_shards: int):
    """Write a shard's sorted bigrams; pass on what they tell about words, and their totals."""
    def run(key, table):
        shard = key[0].as_py()
        before, word, n = [], [], []
        for data in table.column("data").to_pylist():
            (distinct,), (times,), (w, c) = _unframed(data)
            before.append(np.repeat(distinct, times.astype(np.int64)))
            word.append(w)
            n.append(c)
        before, word = np.concatenate(before), np.concatenate(word)
        keys, row, (n,) = _sums(bigram(before, word), [np.concatenate(n)])
        before, word = before[row], word[row]
        _save(folder, f"pairs-{shard:05d}-keys", keys)
        _save(folder, f"pairs-{shard:05d}-n", np.minimum(n, 255).astype(np.uint8))
        _save(folder, f"pairs-{shard:05d}-many", np.stack([np.flatnonzero(n >= 255).astype(np.uint64), n[n >= 255]]))
        zero = np.zeros(len(n), np.uint64)
        facts = [np.concatenate(x) for x in (
            (zero, n), (n, zero), ((n == 1).astype(np.uint64), zero), ((n == 2).astype(np.uint64), zero),
            ((n >= 3).astype(np.uint64), zero), (zero, zero + np.uint64(1)))]
        words, _, facts = _sums(np.concatenate([before, word]), facts)
        place = shard_of(words, word_shards)
        cuts = np.searchsorted(place, np.arange(word_shards + 1))
        shards, payloads = [-1], [_pack([np.array([(n == i).sum()], np.uint64) for i in (1, 2, 3, 4)])]
        for s in range(word_shards):
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo:
                shards.append(s)
                payloads.append(_pack([words[lo:hi], *[f[lo:hi] for f in facts]]))
        return pa.table({"shard": pa.array(shards, pa.int32()), "data": pa.array(payloads, pa.binary())})
    return run


def _words(folder: str):
    """Write a shard's sorted words; return totals: tokens, words, pairs and counts of counts."""
    def run(key, table):
        shard = key[0].as_py()
        parts = [_unpack(data) for data in table.column("data").to_pylist()]
        if shard < 0:
            return pa.table({"kind": ["pairs"], "totals": [[float(sum(p[i][0] for p in parts)) for i in range(4)]]})
        keys, _, facts = _sums(np.concatenate([p[0] for p in parts]),
                               [np.concatenate([p[i] for p in parts]) for i in range(1, len(WORD_COLUMNS) + 1)])
        _save(folder, f"words-{shard:05d}-keys", keys)
        _save(folder, f"words-{shard:05d}-facts", _narrow(np.stack(facts).ravel()).reshape(len(facts), -1))
        raw, after = facts[0], facts[5]
        totals = [raw.sum(), (raw > 0).sum(), after.sum(), *[(after == i).sum() for i in (1, 2, 3, 4)], (after >= 3).sum()]
        return pa.table({"kind": ["words"], "totals": [[float(t) for t in totals]]})
    return run


def discounts(counts: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from counts of counts 1 to 4.

    Where a count of counts is missing, as in small data, the discount is half its count.
    """
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0.0, 1 - 2 * y * n2 / n1, max(d2, 0.0), max(d3, 0.0)])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals."""

    folder: str
    shards: int
    word_shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_rest: float


def mounted(folder: str) -> str:
    """The shared folder as a path; mapping files needs one that is mounted everywhere."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError("memory mapping needs a mounted shared folder, not " + folder)
    return unquote(parts.path) if parts.scheme else folder


def learn(docs: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count all rows of ``docs`` and write the arrays below the shared folder.

    NULL texts count as empty: an end after a start.  The driver gets a row of totals per
    shard.  No rows give a model without words.
    """
    spark = docs.sparkSession
    folder = f"{mounted(shared_dir(spark)).rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    facts = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    expected = (facts["bytes"] or 0) / BYTES_PER_TOKEN + facts["rows"]
    shards = max(1, -(-int(expected) // shard_tokens))
    word_shards = max(1, shards // 2)
    schema = "shard int, data binary"
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    totals = (texts.mapInArrow(_count(shards), schema)
              .groupBy("shard").applyInArrow(_merge(folder, word_shards), schema)
              .groupBy("shard").applyInArrow(_words(folder), "kind string, totals array<double>").collect())
    pairs = np.zeros(4)
    words = np.zeros(8)
    for r in totals:
        if r["kind"] == "pairs":
            pairs += r["totals"]
        else:
            words += r["totals"]
    by_word = discounts(list(words[3:7]))
    rest = by_word[1] * words[3] + by_word[2] * words[4] + by_word[3] * words[7]
    return Model(folder, shards, word_shards, int(words[0]), int(words[1]), int(words[2]),
                 discounts(list(pairs)), by_word, rest / words[2] if words[2] else 1.0)


class Arrays:
    """The model's files, mapped once per worker."""

    _open: dict[str, "Arrays"] = {}

    def __init__(self, model: Model):
        def load(name):
            path = f"{model.folder}/{name}.npy"
            return np.load(path, mmap_mode="r") if os.path.exists(path) else None
        self.pairs = [[load(f"pairs-{s:05d}-{k}") for k in ("keys", "n", "many")] for s in range(model.shards)]
        self.words = [[load(f"words-{s:05d}-{k}") for k in ("keys", "facts")] for s in range(model.word_shards)]

    @classmethod
    def of(cls, model: Model) -> "Arrays":
        if model.folder not in cls._open:
            cls._open.clear()
            cls._open[model.folder] = cls(model)
        return cls._open[model.folder]

    @staticmethod
    def _places(keys, wanted):
        at = np.searchsorted(keys, wanted)
        found = keys[np.minimum(at, len(keys) - 1)] == wanted
        return at[found], found

    def pair_counts(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram hashes."""
        out = np.zeros(len(wanted))
        cuts = np.searchsorted(shard_of(wanted, len(self.pairs)), np.arange(len(self.pairs) + 1))
        for (keys, small, many), lo, hi in zip(self.pairs, cuts, cuts[1:]):
            if hi > lo and keys is not None and len(keys):
                at, found = self._places(keys, wanted[lo:hi])
                n = small[at].astype(np.float64)
                over = np.flatnonzero(n == 255)
                n[over] = many[1][np.searchsorted(many[0], at[over].astype(np.uint64))]
                out[lo:hi][found] = n
        return out

    def word_facts(self, wanted: np.ndarray) -> np.ndarray:
        """Facts (columns x words) of sorted word hashes."""
        out = np.zeros((len(WORD_COLUMNS), len(wanted)))
        cuts = np.searchsorted(shard_of(wanted, len(self.words)), np.arange(len(self.words) + 1))
        for (keys, facts), lo, hi in zip(self.words, cuts, cuts[1:]):
            if hi > lo and keys is not None and len(keys):
                at, found = self._places(keys, wanted[lo:hi])
                out[:, lo:hi][:, found] = facts[:, at]
        return out


def score_texts(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of every text."""
    arrays = Arrays.of(model)
    word, before, sizes = tokens(texts)
    first = np.cumsum(sizes) - sizes
    distinct, back = np.unique(np.concatenate([word, before]), return_inverse=True)
    facts = arrays.word_facts(distinct)
    own, context = back[:len(word)], back[len(word):]
    raw, after = facts[0][own], facts[5][own]
    pair, where = np.unique(bigram(before, word), return_inverse=True)
    n = arrays.pair_counts(pair)[where]
    base = np.log10((raw + ALPHA) / (model.tokens + ALPHA * (model.words + 1)))
    lower = model.word_rest / (model.words + 1)
    if model.pairs:
        kept = np.maximum(after - model.word_discounts[np.minimum(after, 3).astype(np.int64)], 0)
        lower = kept / model.pairs + lower
    d = model.pair_discounts
    followed = facts[1][context]
    rest = d[1] * facts[2][context] + d[2] * facts[3][context] + d[3] * facts[4][context]
    top = np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0) + rest * lower
    p = np.where(followed > 0, top / np.maximum(followed, 1), lower)
    total = np.add.reduceat
    return sizes, total((raw > 0).astype(np.int64), first), total(base, first), total(np.log10(p), first)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_tokens, n_known, base_score, score, perplexity) for every row.

    ``base_score`` sums log10 of add-0.1 unigram probabilities, ``score`` those of the
    model; ``perplexity`` is 10 to the mean loss by token.  A NULL text counts as empty.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts = [score_texts(texts[lo:hi], model)
                     for lo, hi in slices([len(t or b"") for t in texts], SCORE_BYTES)]
            if not parts:
                continue
            n, known, base, got = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(got),
                 pa.array(10 ** (-got / n))],
                names=["id", "key", "n_tokens", "n_known", "base_score", "score", "perplexity"])
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, key bigint, n_tokens bigint, n_known bigint, base_score double, "
                                "score double, perplexity double")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id isn't divisible by 10."""
    return docs.filter(~is_remainder(id_col, 10, 0))
