"""Repeated byte strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import queries, suffix_dedup


def repeats_by_hand(texts, length):
    """(spans, kept) of every text; ``texts`` are bytes."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[max(i, end):i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        flags = bytes([0, *gone, 0])
        starts = [i for i in range(len(t) + 1) if flags[i] == 0 and flags[i + 1] == 1]
        ends = [i for i in range(1, len(t) + 1) if flags[i] == 1 and flags[i + 1] == 0]
        out.append((list(zip(starts, ends)), bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [1, 12, 26, 146, 362, 400, 1000])
def test_difference_cover(length):
    v, cover = suffix_dedup.difference_cover(length)
    assert v <= max(1, length // 2) and len(set(cover)) == len(cover) and max(cover) < v
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("length", [5, 30, 200])
def test_repeats(make, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (2, 5, 6, 8, 30, 60, 90)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts += [p[cut:], prose(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    near = rows[7][1]
    rows += [(100 + i, near[:i] + "#" + near[i + 1:]) for i in range(0, len(near), 97)]
    rows += [(200, None), (201, ""), (202, "z" * (length - 1)), (203, "z" * length), (204, "y" * (3 * length)), (None, near),
             (205, rows[3][1]), (3, rows[3][1]), (206, "ab" * 3000), (None, prose(50)), (207, prose(40_000 // 6))]
    got = Counter((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
                  for r in suffix_dedup.repeated_spans(make(rows), length=length).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((i, len(t), tuple(s), k) for (i, _), t, (s, k) in zip(rows, texts, repeats_by_hand(texts, length)))
    assert got == want


def test_nothing_to_search(make):
    assert suffix_dedup.repeated_spans(make([])).count() == 0
    got = suffix_dedup.repeated_spans(make([(1, None), (2, "short")])).collect()
    assert sorted((r["id"], r["n_bytes"], r["spans"], bytes(r["kept"])) for r in got) == [(1, 0, [], b""), (2, 5, [], b"short")]


def test_driver_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in docs]
    want = {(r["doc_id"], len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())
            for r, t, (s, k) in zip(docs, texts, repeats_by_hand(texts, 400))}
    assert {tuple(r) for r in queries.op12_suffix_dedup(spark, sf).collect()} == want
