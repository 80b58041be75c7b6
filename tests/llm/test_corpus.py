"""Line templates, near duplicates, decontamination, mixing and the pipeline against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import components, decontaminate, line_templates, mixing, simhash
from tidemark.llm.common import Block, PUNCTUATION

RNG = np.random.default_rng(17)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def union_find(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def simhash_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    values = [xxhash.xxh64_intdigest(b" ".join(p), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_simhash(spark, make):
    base = [prose(150) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for k in range(4):
            words = t.split()
            words[int(RNG.integers(150))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (504, "one"), (505, "a b"), (None, base[0]),
             (None, "nobody else has this text"), (7, rows[7][1]), (506, "é É ß"), (507, "w " * 50000)]
    docs = make(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    marks = [r["fp"] % 2**64 for r in got]
    want = Counter((i, simhash_by_hand(t)) for i, t in rows)
    assert Counter((r["id"], m) for r, m in zip(got, marks)) == want
    n = len(got)
    group = union_find(n, [(i, j) for i in range(n) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3])
    least = {}
    for r, g in zip(got, group):
        if r["id"] is not None:
            least[g] = min(least.get(g, r["id"]), r["id"])
    assert [r["component"] for r in got] == [least.get(g) for g in group]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(group)) and sorted(i for i in ids if i is not None) == sorted(least.values())
    assert simhash.near_duplicates(make([])).count() == simhash.keep_one(make([])).count() == 0


def test_links_lose_nothing(spark):
    """Clusters of fingerprints around a centre, and chains; all pairs within three bits."""
    rng = np.random.default_rng(2)
    marks = set()
    for _ in range(40):
        centre = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            marks.add(centre ^ sum(1 << int(f) for f in flips))
    signed = sorted(m - 2**64 if m >= 2**63 else m for m in marks)
    points = spark.createDataFrame([(m,) for m in signed], "fp bigint")
    for segments in (4, 8):
        got = {(r["a"], r["b"]) for r in simhash.links(points, 3, segments).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}


def test_links_never_broadcast_exploded_fingerprints(spark):
    """Spark sees their size before the explosion, a row for what becomes 4 or 68."""
    plan = simhash.links(spark.range(1000).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(200)] + [(300, 300 + i) for i in range(1, 100)] + [(5, 5)]
    links += [tuple(map(int, p)) for p in rng.integers(500, 700, (150, 2))]
    got = {r["node"]: r["root"] for r in components.components(
        spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    group = union_find(700, links)
    for a, b in links:
        if a != b:
            assert got[a] == got[b] == min(i for i in range(700) if group[i] == group[a])
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def templates_by_hand(rows, depth=3, min_docs=5, min_words=5, min_fixed=0.7):
    """(id, text, line number) of the lines that go."""
    mask = lambda w: "<*>" if any(c in "0123456789" for c in w) else w
    lines = [((d, t), i, tuple(mask(w) for w in line.split())) for d, t in set(rows) if t is not None
             for i, line in enumerate(t.split("\n"))]
    leaf = lambda w: (len(w), w[:depth])
    shown, support = defaultdict(set), Counter()
    for doc, _, w in lines:
        shown[w].add(doc)
    docs = defaultdict(set)
    for w, own in shown.items():
        docs[leaf(w)] |= own
    for w, own in shown.items():
        for k in enumerate(w):
            support[leaf(w), k] += len(own)
    holders, places = defaultdict(set), defaultdict(list)
    for doc, i, w in lines:
        if len(w) < min_words or len(docs[leaf(w)]) < min_docs:
            continue
        t = tuple(x if x != "<*>" and support[leaf(w), (k, x)] >= min_docs else "<*>" for k, x in enumerate(w))
        if sum(x != "<*>" for x in t) >= len(w) * min_fixed:
            holders[leaf(w), t].add(doc)
            places[leaf(w), t].append((doc, i))
    out = set()
    for t, own in holders.items():
        if len(own) >= min_docs:
            ids = sorted(places[t], key=lambda p: (p[0][0] is None, p[0][0] or 0, p[1]))
            out |= set(ids) - {ids[0]}
    return out


def test_line_templates(spark, make):
    note = "Copyright {} by the Example Company and all its many partners"
    rows = []
    for i in range(40):
        parts = [prose(12) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, note.format(2000 + i))
        if i % 4 == 0:
            parts += ["Read more about this on our pages today", "ok"]
        if i % 7 == 0:
            parts.append("Dear Sir or Madam, {} writes to you again".format(VOCABULARY[i]))
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, note.format(1)), (None, note.format(2)),
             (104, "one two three four " + "x" * 30000), (3, rows[3][1]), (105, "\n".join([note.format(i) for i in range(9)]))]
    docs = make(rows)
    gone = templates_by_hand(rows)
    assert len(gone) > 30
    cut = line_templates.drop_recurring(docs).collect()
    assert len(cut) == len(rows)

    def left(d, t):
        return None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if ((d, t), i) not in gone)
    want = Counter((d, left(d, t), 0 if t is None else t.count("\n") + 1) for d, t in rows)
    assert Counter((r["doc_id"], r["text"], r["__n_lines"]) for r in cut) == want
    for r in cut:
        assert r["__kept"] or r["__n_dropped"] > 0
    assert line_templates.drop_recurring(make([])).count() == 0


def test_line_hashes():
    """Lines have one hash exactly if they have the same words, masked words or leaf."""
    turn = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [None, "", "\n", "one two  three\tfour\n one two three four ", "one two 3 four\r\none two x9y four\none two <*> four",
             "one two three fo\u00a0ur\none two three \u0663\none two three\x0bfour", "two one three four", "one two\none two",
             " ".join("ab"[t] for t in turn) + "\n" + " ".join("ba"[t] for t in turn), "7 " * 9 + "\n" + "8 " * 9, "Café 1é\nCafé 2"]

    def words(line):
        return tuple(w for w in re.split("[ \t-\r]+", line) if w)

    def masked(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
    want = [(i, at, line) for i, t in enumerate(texts) if t is not None for at, line in enumerate(t.split("\n"))]
    lines = line_templates.Lines([None if t is None else t.encode() for t in texts], 3)
    real = np.flatnonzero(lines.real)
    assert list(zip(lines.text[real].tolist(), lines.at[real].tolist())) == [w[:2] for w in want]
    assert lines.n_words[real].tolist() == [len(words(line)) for _, _, line in want]
    for got, plain in ((lines.words, words), (lines.masked, masked), (lines.leaf, lambda x: (len(words(x)), masked(x)[:3]))):
        pairs = {(h, plain(line)) for h, (_, _, line) in zip(got[real].tolist(), want)}
        assert len(pairs) == len({h for h, _ in pairs}) == len({k for _, k in pairs})


def passages_by_hand(rows, long_words=20):
    """Places of long lines that stand word for word in two documents: those that go, those that stay."""
    places = defaultdict(list)
    for d, t in set(rows):
        for i, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= long_words:
                places[tuple(line.split())].append(((d, t), i))
    gone, first = set(), set()
    for own in places.values():
        if len({doc for doc, _ in own}) > 1:
            own.sort(key=lambda p: (p[0][0], p[1]))
            first.add(own[0])
            gone |= set(own[1:])
    return gone, first


def test_long_lines_of_two_documents(spark, make):
    """A long line goes from the second document on; short ones and the last copy stay."""
    rng = np.random.default_rng(37)
    line = {n: prose(n, rng) for n in (8, 19, 20, 60)}
    own = [prose(100, rng) for _ in range(9)]
    rows = [(0, "\n".join([own[0], line[60], line[8], line[60]])), (1, "\n".join([line[60], own[1], line[8]])),
            (2, own[2] + "\n" + line[20]), (3, own[3] + "\n  " + line[20].replace(" ", "  ")),
            (4, own[4] + "\n" + line[19]), (5, own[5] + "\n" + line[19]), (None, own[2]),
            # 7 repeats 6 but for a line of its own, which 8 shows too: one of the two must keep it.
            (6, own[6] + "\n" + own[7]), (7, own[6] + "\n" + own[7] + "\n" + prose(25, rng))]
    rows += [(8, rows[8][1].split("\n")[-1] + "\n" + own[8]), (9, own[8]), (9, own[8]), (10, (line[60] + "7\n") * 2)]
    got = {(r["doc_id"], r["text"]): r["__kept"] for r in line_templates.drop_recurring(make(rows)).collect()}
    assert got == {
        (0, "\n".join([own[0], line[60], line[8]])): True, (1, own[1] + "\n" + line[8]): True,
        (2, rows[2][1]): True, (3, own[3]): True, (4, rows[4][1]): True, (5, rows[5][1]): True, (None, ""): False,
        (6, rows[7][1]): True, (7, rows[8][1].split("\n")[-1]): True, (8, own[8]): True, (9, ""): False,
        (10, rows[-1][1]): True}


def test_common_words():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 70)).tolist(), rng.integers(0, 6, rng.integers(0, 90)).tolist()
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_words(a, b) == table[-1][-1]


def test_decontamination(spark, make):
    rng = np.random.default_rng(23)
    items = [(i, prose(int(n), rng)) for i, n in enumerate(rng.integers(12, 60, 60))]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, id string")
    rows, planted = [], set()
    for i in range(200):
        text = prose(int(rng.integers(30, 400)), rng).split()
        if i % 2:
            item, t = items[int(rng.integers(0, 60))]
            words = t.split()
            if i % 4 == 1:
                # A paraphrase: a tenth of the words replaced, other case and punctuation.
                for k in rng.choice(len(words), len(words) // 10, replace=False):
                    words[k] = "reworded"
                words = [w.title() + "," for w in words]
            at = int(rng.integers(0, len(text)))
            text[at:at] = words
            planted |= {(i, item)} | ({(i, 103)} if item == 0 else set()) | ({(i, 0)} if item == 103 else set())
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (None, items[5][1]), (502, prose(20000, rng) + " " + items[6][1]), (1, rows[1][1])]
    planted |= {(None, 5), (502, 6)}
    docs = make(rows)

    def exact(item, text):
        """Brute force: the item's words, in order, in some stretch three times as long."""
        a, b = (Block([t.encode()], PUNCTUATION).word_hashes().tolist() for t in (item, text or ""))
        return len(a) >= 5 and any(decontaminate.common_words(a, b[k:k + 2 * len(a)]) >= 0.8 * len(a)
                                   for k in range(0, max(1, len(b)), max(1, len(a) // 4)))
    want = {(d, i) for d, t in rows[:200:5] for i, x in items if x and exact(x, t)}
    assert want <= planted
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in {g[0] for g in got})
    assert decontaminate.contaminated(make([]), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, make, monkeypatch):
    rng = np.random.default_rng(29)
    items = [(i, prose(30, rng)) for i in range(40)]
    docs = make([(i, prose(50, rng) + " " + t + " " + prose(50, rng)) for i, t in items])
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 8)
    got = sorted((r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark, rank=6).collect())
    assert got == [(i, i) for i in range(40)]


def test_candidates_by_shares(spark):
    """No passage with the share is lost; repeated words don't make a stretch a candidate."""
    rng = np.random.default_rng(41)
    texts = [prose(int(n), rng) for n in rng.integers(5, 60, 30)]
    items = spark.createDataFrame([(i, Block([t.encode()], PUNCTUATION).word_hashes().tobytes()) for i, t in enumerate(texts)],
                                  "id int, words binary")
    model = decontaminate.fit(items, rng.uniform(0.5, 9, decontaminate.FEATURES).astype(np.float32))
    words = [t.split() for t in texts]
    docs = [" ".join(sum((w[:int(rng.integers(0, len(w)))] for w in rng.permutation(np.array(words, object))[:6]), []))
            for _ in range(40)]
    docs += [" ".join([w[at]] * 200) for w in words[:8] for at in (0, -1)]
    block = Block([d.encode() for d in docs], PUNCTUATION)
    feature = decontaminate._feature(block.word_hashes())
    owner, lo, hi = decontaminate.passage_bounds(block.first[:-1], block.n_words)
    shares = np.array([[sum(s for f, s in own.items() if f in here) for own in model.shares]
                       for here in (set(feature[a:b].tolist()) for a, b in zip(lo, hi))])
    for least in (0.0, 0.2, decontaminate.MIN_SHARE, 0.9):
        index = decontaminate.ShareIndex(model, least)
        got = [p for i, j in index.pairs(model.column[feature], lo, hi) for p in zip(i.tolist(), j.tolist())]
        assert got == sorted(set(got)) and {tuple(p) for p in np.argwhere(shares >= least).tolist()} <= set(got)
        # What is left out of the index is all that an inexact candidate may lack.
        assert all(shares[p] >= least / 2 - 1e-6 for p in got)


def test_short_items_amid_unknown_words(spark, make, monkeypatch):
    """Whole copies of items of 5 to 16 words are found whatever stands around them."""
    rng = np.random.default_rng(37)
    sizes = (5, 6, 7, 8, 10, 12, 14, 16)
    items = [(100 * n + k, prose(n, rng)) for n in sizes for k in range(12)]
    # Half of the copies' words are common ones, which weigh little.
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    for at in range(0, len(items), 2):
        i, t = items[at]
        words = t.split()
        words[::2] = rng.choice(common, len(words[::2]))
        items[at] = (i, " ".join(words))
    benchmark = spark.createDataFrame(items, "item_id int, text string")

    def rare(n):
        return " ".join("".join(rng.choice(list("qrstuvwxyz"), 9)) for _ in range(n))
    rows = [(i, f"{rare(int(rng.integers(30, 90)))} {t} {rare(40)}") for i, t in items]
    rows += [(9000 + k, f"{rare(60)} {' '.join(rng.choice(common, 20))} {rare(9)}") for k in range(200)]
    docs = make(rows)
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    for n in sizes:
        assert sum((i, i) in got for i, _ in items if i // 100 == n) >= 0.95 * 12
    assert not [g for g in got if g[0] >= 9000]
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 16)
    assert {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == got
    # A table of one document weighs its words, too.
    one = decontaminate.contaminated(make(rows[:1]), benchmark).collect()
    assert (rows[0][0], items[0][0]) in {(r["id"], r["item_id"]) for r in one}


def entropy(weights):
    w = np.array(weights, float) / sum(weights)
    return -(w * np.log(w)).sum()


@pytest.mark.parametrize("limit, entropy_place", [(50.0, 0.5), (1.5, 1.0)])
def test_mixing(spark, make, limit, entropy_place):
    rng = np.random.default_rng(31)
    sizes = {"big": 300, "mid": 80, "low": 30, None: 12}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at, prose(int(rng.integers(5, 40)), rng), "en", source))
            at += 1
    rows += [(900, None, "en", "big"), (901, " ", "en", "only blanks"), (None, "some words here", "en", "low"), rows[0]]
    docs = make(rows)
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    share = np.array(list(tokens.values())) / total
    target = entropy(share) + entropy_place * (np.log(len(share)) - entropy(share))

    def fits(a):
        w = share ** a / (share ** a).sum()
        return entropy(w) <= target + 1e-9 and (w / share).max() <= limit + 1e-9
    low, high = 0.0, 1.0
    if not fits(low):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    else:
        high = 0.0
    weight = dict(zip(tokens, share ** high / (share ** high).sum()))
    plan = {r["source"]: r for r in mixing.source_plan(docs, entropy=entropy_place, max_epochs=limit).collect()}
    assert set(plan) == set(tokens)
    for s, r in plan.items():
        assert r["alpha"] == pytest.approx(high, abs=1e-6) and r["weight"] == pytest.approx(weight[s], abs=1e-6)
        assert r["passes"] == int(weight[s] * total / tokens[s] + 1e-9)
    out = mixing.mix(docs, entropy=entropy_place, max_epochs=limit)
    assert out.columns == [*docs.columns, "epoch", "block_order", "doc_order"]
    passes, got = defaultdict(list), Counter()
    longest = max(len((t or "").split()) for _, t, _, _ in rows)
    for r in out.collect():
        passes[r["source"], r["doc_id"], r["text"]].append(r["epoch"])
        got[r["source"]] += len(r["text"].split())
    for s, n in got.items():
        assert weight[s] * total - 2 * longest <= n <= weight[s] * total + 1e-6
    times = Counter((s, d, t) for d, t, _, s in rows)
    for k, epochs in passes.items():
        assert sorted(set(epochs)) == list(range(max(epochs) + 1))
        assert set(Counter(epochs).values()) == {times[k]}
        assert max(epochs) <= plan[k[0]]["passes"]
    full = {k for k in times if k[2] and k[2].split() and plan[k[0]]["passes"]}
    assert full <= set(passes)
    again = mixing.mix(docs, entropy=entropy_place, max_epochs=limit)
    assert sorted(map(tuple, again.select("doc_id", "epoch", "doc_order").collect()), key=str) == \
        sorted(map(tuple, out.select("doc_id", "epoch", "doc_order").collect()), key=str)
    assert mixing.mix(make([])).count() == 0


def test_pipeline(spark, sf):
    """Every stage on its own input: what goes and what stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "source_mixing":
            assert out.columns == docs.columns
        rows, before = out.collect(), docs.collect()
        seen[name] = rows
        if name == "line_dedup":
            pairs = [(r["doc_id"], r["text"]) for r in before]
            long_gone, first = passages_by_hand(pairs)
            gone, want = templates_by_hand(pairs) | long_gone, {}
            for d, t in pairs:
                left = [(i, x) for i, x in enumerate(t.split("\n")) if ((d, t), i) not in gone]
                cut = len(left) <= t.count("\n")
                enough = sum(len(x.split()) for _, x in left) >= 0.2 * len(t.split())
                if not cut or enough or any(((d, t), i) in first for i, _ in left):
                    want[d] = "\n".join(x for _, x in left)
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "simhash_near_dedup":
            marks = [simhash_by_hand(r["text"]) for r in before]
            group = union_find(len(before), [(i, j) for i in range(len(before)) for j in range(i)
                                             if (marks[i] ^ marks[j]).bit_count() <= 3])
            least = {}
            for r, g in zip(before, group):
                least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in rows) == sorted(least.values())
        if name == "benchmark_decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            for r in rows:
                plain = " ".join(r["text"].split())
                assert not any(i in plain for i in items)
            kept = {r["doc_id"] for r in rows}
            for r in before:
                plain = " ".join(r["text"].split())
                if not any(i[:40] in plain or i[-40:] in plain for i in items):
                    assert r["doc_id"] in kept
        docs = out
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()
    kept = {r["doc_id"] for r in seen["language_id"]}
    assert all(r["doc_id"] in kept for r in labels)
    assert seen["source_mixing"]
