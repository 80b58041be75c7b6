"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of words, weighted by TF-IDF.  A
randomised singular value decomposition of the benchmark's passages, summed over Spark's
partitions, spans the latent space.  Document passages near a benchmark passage by cosine
there are candidates; a longest common subsequence of words and a check of the item's
last words (its answer) decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import PUNCTUATION, Block, slices, store, text_key

FEATURES = 1 << 18
PASSAGE = 24
STRIDE = 12
RANK = 448
EXTRA = 16
MIN_ITEM = 5
ITEM_BLOCK = 1024
MIN_SHARE = 0.4
PAIRS = 1 << 20
MIN_COSINE = 0.5
MIN_COMMON = 0.8
ANSWER_WORDS = 5
ANSWER_COMMON = 0.6


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (FEATURES.bit_length() - 1))).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(1 + (N + 1) / (df + 1)) of every hashed word over all documents; never zero, so that
    a table of one document, or a word in all of them, weighs something.

    The driver gets one number per hash bucket at most (``FEATURES``).
    """
    def count(batches):
        table, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts]):
                block = Block(texts[lo:hi], PUNCTUATION)
                seen = block.text_of_word() * FEATURES + _feature(block.word_hashes())
                table += np.bincount(np.unique(seen) % FEATURES, minlength=FEATURES)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(table[used], rows))],
            names=["feature", "n"])
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    sums = (texts.mapInArrow(count, "feature bigint, n bigint")
            .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())
    place, n = sums["feature"].to_numpy(), sums["n"].to_numpy()
    rows = n[place < 0].sum()
    df = np.zeros(FEATURES)
    df[place[place >= 0]] = n[place >= 0]
    return np.log1p((rows + 1.0) / (df + 1.0)).astype(np.float32)


def passage_bounds(first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end word of every passage; the last ends with the text."""
    steps = np.where(n_words > PASSAGE, -(-(n_words - PASSAGE) // STRIDE) + 1, n_words > 0)
    owner = np.repeat(np.arange(len(n_words)), steps)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    begin = np.minimum(nth * STRIDE, np.maximum(n_words[owner] - PASSAGE, 0))
    size = np.minimum(n_words[owner], PASSAGE)
    return owner, first[owner] + begin, first[owner] + begin + size


def common_words(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = state & where.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@dataclass(frozen=True)
class Latent:
    """Benchmark items in the latent space.

    ``column`` maps a feature to its row of ``basis`` (-1: not in the benchmark);
    ``passages`` are the items' passages there, of TF-IDF length ``length`` before they were
    scaled to 1, ``floor`` the product of a copy.  ``shares`` holds, for every passage,
    the share of its weight that each of its features makes up.
    """

    idf: np.ndarray
    column: np.ndarray
    basis: np.ndarray
    passages: np.ndarray
    item_of: np.ndarray
    length: np.ndarray
    floor: np.ndarray
    shares: list[dict[int, float]]
    ids: list
    words: list[np.ndarray]


def _matrix(words: list[np.ndarray], idf: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense TF-IDF rows of the items' passages, of length 1, their items and former lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    owner, lo, hi = passage_bounds(first, sizes)
    out = np.zeros((len(owner), width), np.float32)
    feature = _feature(flat)
    for i, (a, b) in enumerate(zip(lo, hi)):
        np.add.at(out[i], column[feature[a:b]], idf[feature[a:b]])
    norm = np.maximum(np.linalg.norm(out, axis=1), 1e-12)
    return out / norm[:, None], owner, norm


def _summed(items: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """Sum over partitions of a matrix that ``part`` makes of a partition's items."""
    def run(batches):
        total = np.zeros(shape, np.float32)
        for batch in batches:
            total += part([np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])
    out = np.zeros(shape, np.float32)
    for row in items.select("words").mapInArrow(run, "m binary").toLocalIterator():
        out += np.frombuffer(row["m"], np.float32).reshape(shape)
    return out


def fit(items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> Latent:
    """Latent space of a block of items: (id, words) with hashed words as binary.

    Two rounds of A'A against a random test matrix, summed over the partitions, then the
    small projected problem on the driver; its size depends on the block only.
    """
    rows = items.collect()
    ids = [r["id"] for r in rows]
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    features = np.unique(_feature(np.concatenate(words))) if words else np.zeros(0, np.int64)
    column = np.full(FEATURES, -1, np.int32)
    column[features] = np.arange(len(features))
    width = len(features)
    passages, item_of, length = _matrix(words, idf, column, width)
    shares = [dict(zip(features[at].tolist(), (row[at] ** 2).tolist()))
              for row in passages for at in [np.flatnonzero(row)]]
    rank = max(1, min(rank, width, len(passages)))
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal(
        (width, min(width, rank + EXTRA)), np.float32))[0]

    def product(q):
        def part(some):
            a = _matrix(some, idf, column, width)[0]
            return a.T @ (a @ q)
        return part
    for _ in range(2):
        test = np.linalg.qr(_summed(items, product(test), test.shape))[0]
    side = test.shape[1]

    def gram(some):
        a = _matrix(some, idf, column, width)[0] @ test
        return a.T @ a
    value, vector = np.linalg.eigh(_summed(items, gram, (side, side)))
    basis = (test @ vector[:, np.argsort(-value)[:rank]]).astype(np.float32)
    inside = passages @ basis
    # A copy of a passage reaches the square of its own length in the space.
    return Latent(idf, column, basis, inside, item_of, length, np.maximum((inside ** 2).sum(axis=1), 1e-12),
                  shares, ids, words)


class ShareIndex:
    """Which passages of the benchmark can have ``min_share`` of their weight in a stretch of words?

    Every passage is listed under its features but for its commonest ones, which make up at
    most half of ``min_share`` (``left``): a stretch without a listed feature can't reach it.
    """

    def __init__(self, model: Latent, min_share: float):
        self.least = min_share - 1e-6
        self.left = np.zeros(len(model.shares))
        places, owners, parts = [], [], []
        for nth, own in enumerate(model.shares):
            feature = np.array(sorted(own, key=lambda f: (model.idf[f], f)), np.int64)
            part = np.array([own[f] for f in feature.tolist()])
            out = int((np.cumsum(part) <= min_share / 2).sum())
            self.left[nth] = part[:out].sum()
            places.append(model.column[feature[out:]])
            owners.append(np.full(len(feature) - out, nth))
            parts.append(part[out:])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(place, kind="stable")
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.part = np.concatenate(parts)[order] if parts else np.zeros(0)
        # The last place is for words that no item has.
        self.n = np.bincount(place, minlength=len(model.basis) + 1)
        self.first = np.cumsum(self.n) - self.n

    def pairs(self, known: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(stretches, passages) that may agree, in order and in bounded portions.

        ``known`` is each word's row of the basis (-1: none); a repeated word counts once.
        """
        if self.least <= 0:
            for at in range(0, len(lo), 2048):
                some = np.arange(at, min(at + 2048, len(lo)))
                yield np.repeat(some, len(self.left)), np.tile(np.arange(len(self.left)), len(some))
            return
        listed = np.flatnonzero(self.n[known])
        place = known[listed]
        weight = np.concatenate([[0], np.cumsum(self.n[place])])
        begin, end = np.searchsorted(listed, lo), np.searchsorted(listed, hi)
        some = np.flatnonzero(end > begin)
        for a, b in slices((weight[end[some]] - weight[begin[some]]).tolist(), PAIRS):
            rows = some[a:b]
            word = _ranges(begin[rows], end[rows] - begin[rows])
            own = np.unique(np.repeat(rows, end[rows] - begin[rows]) * len(self.n) + place[word])
            row, feature = np.divmod(own, len(self.n))
            entry = _ranges(self.first[feature], self.n[feature])
            key = np.repeat(row, self.n[feature]) * len(self.left) + self.owner[entry]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            share = np.add.reduceat(self.part[entry[order]], first)
            row, passage = np.divmod(key[first], len(self.left))
            near = share + self.left[passage] >= self.least - 1e-9
            yield row[near], passage[near]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _hits(block: Block, model: Latent, index: ShareIndex, min_cosine: float, min_common: float):
    """{(text, item): (common share, answer share, cosine)} where text and item agree."""
    hashes = block.word_hashes()
    feature = _feature(hashes)
    weight = model.idf[feature].astype(np.float64) ** 2
    known = model.column[feature]
    owner, lo, hi = passage_bounds(block.first[:-1], block.n_words)
    if not len(owner):
        return {}
    total = np.concatenate([[0.0], np.cumsum(weight)])
    energy = total[hi] - total[lo]
    regions: dict[tuple[int, int], list[list]] = {}
    for row, passage in index.pairs(known, lo, hi):
        some, nth = np.unique(row, return_inverse=True)
        near = np.zeros(len(row), np.float32)
        for at in range(0, len(some), 2048):
            part = some[at:at + 2048]
            sizes = hi[part] - lo[part]
            flat = _ranges(lo[part], sizes)
            column = known[flat]
            vectors = model.basis[np.maximum(column, 0)] * np.where(column >= 0, model.idf[feature[flat]], 0)[:, None]
            latent = np.add.reduceat(vectors, np.cumsum(sizes) - sizes, axis=0)
            # What a stretch holds besides a shorter item isn't held against it.
            shorter = np.minimum(np.sqrt(energy[part])[:, None].astype(np.float32), model.length[None, :])
            cosine = (latent @ model.passages.T) / (shorter * model.floor[None, :])
            own = slice(*np.searchsorted(nth, (at, at + 2048)))
            near[own] = cosine[nth[own] - at, passage[own]]
        for at in np.flatnonzero(near >= min_cosine).tolist():
            i, j = int(row[at]), int(passage[at])
            here = set(feature[lo[i]:hi[i]].tolist())
            # A hair's breadth for sums of rounded shares.
            if sum(s for f, s in model.shares[j].items() if f in here) < index.least:
                continue
            text, item = int(owner[i]), int(model.item_of[j])
            size = len(model.words[item])
            # The item may lie anywhere around the passage; regions that touch are one.
            a = max(block.first[text], lo[i] - size)
            b = min(block.first[text + 1], hi[i] + size)
            own = regions.setdefault((text, item), [])
            if own and a <= own[-1][1]:
                own[-1][1:] = [max(b, own[-1][1]), max(own[-1][2], float(near[at]))]
            else:
                own.append([a, b, float(near[at])])
    best: dict[tuple[int, int], tuple] = {}
    for pair, own in regions.items():
        item = model.words[pair[1]].tolist()
        answer = item[-ANSWER_WORDS:]
        for a, b, cosine in own:
            region = hashes[a:b].tolist()
            share = common_words(item, region) / len(item)
            if share >= min_common:
                found = common_words(answer, region) / len(answer)
                if found >= ANSWER_COMMON and (share, found, cosine) > best.get(pair, ()):
                    best[pair] = (share, found, cosine)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 rank: int = RANK, min_share: float = MIN_SHARE, min_cosine: float = MIN_COSINE,
                 min_common: float = MIN_COMMON) -> DataFrame:
    """(id, key, item_id, cosine, common, answer): documents that hold a benchmark item.

    ``cosine`` is relative to a copy of the item's passage, and the document's passage counts
    as no longer than the item's, so that a short item may stand amid any words (it may pass
    1 there); ``common`` and ``answer`` are shares of the item's words, and of its last five,
    found in order near the passage.  A passage is looked at unless its words make up less
    than ``min_share`` of the weight of every passage of the benchmark.  Items under five words (after ASCII punctuation) hold
    too little to tell and give no row, nor do NULL and empty texts; repeated rows are
    reported each.  Items are taken in blocks of about ``ITEM_BLOCK``, each against all
    documents, so a larger benchmark needs no more memory.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))
    named = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("binary").alias("text"))
    item_type = named.schema["id"].dataType.simpleString()
    kind = to_arrow_type(named.schema["id"].dataType)

    def hashed(batches):
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Block([t], PUNCTUATION).word_hashes()
                if len(words) >= MIN_ITEM:
                    ids.append(i)
                    out.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(out, pa.binary())], names=["id", "words"])
    items = store(named.mapInArrow(hashed, f"id {item_type}, words binary").distinct())
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    idf = inverse_frequencies(docs, text_col)
    id_type = slim.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, key bigint, item_id {item_type}, cosine double, common double, "
              "answer double")
    out = None
    for nth in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == nth)
        model = fit(block, idf, rank)
        part = slim.mapInArrow(_search(model, kind, min_share, min_cosine, min_common), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _search(model: Latent, kind, min_share: float, min_cosine: float, min_common: float):
    index = ShareIndex(model, min_share)

    def run(batches):
        for batch in batches:
            ids, keys, items, shares = [], [], [], []
            texts = batch.column(2).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts]) if model.ids else ():
                block = Block(texts[lo:hi], PUNCTUATION)
                for (text, item), got in sorted(_hits(block, model, index, min_cosine, min_common).items()):
                    ids.append(batch.column(0)[lo + text])
                    keys.append(batch.column(1)[lo + text].as_py())
                    items.append(model.ids[item])
                    shares.append(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.as_py() for i in ids], batch.column(0).type), pa.array(keys, pa.int64()),
                 pa.array(items, kind), *[pa.array([s[k] for s in shares], pa.float64()) for k in (2, 0, 1)]],
                names=["id", "key", "item_id", "cosine", "common", "answer"])
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **search) -> DataFrame:
    """Documents that hold no benchmark item; columns unchanged."""
    hits = store(contaminated(docs, benchmark, id_col, text_col, **search)
                 .select(F.col("id").alias("__leak_id"), F.col("key").alias("__leak_key")).distinct())
    marked = docs.withColumn("__leak_text", text_key(text_col))
    kept = marked.join(hits, F.col(id_col).eqNullSafe(F.col("__leak_id"))
                       & (F.col("__leak_text") == F.col("__leak_key")), "left_anti")
    return kept.select(*docs.columns)
