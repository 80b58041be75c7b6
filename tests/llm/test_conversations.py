"""Conversation operators against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import conversation_repair, ordered, prefix_trie, queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("conv", "at", "key", "item", "n", "box", "part")]])


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """Writes (conv_id, turn, role, text) rows, with clashing columns; gives the folder."""
    def build(rows):
        folder = str(tmp_path_factory.mktemp("talk"))
        spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(5).write.parquet(
            f"{folder}/conversations.parquet")
        return folder
    return build


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_turn(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    # Ties fall by role, then by digest of the text; tests have ties only among equal texts.
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}


def trie_by_hand(convs):
    """Rows of the trie over conv -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    name = lambda m: min((c for c in m if c is not None), default=None)
    out = []
    for k, m in members.items():
        ends = sorted((c for c in m if len(convs[c]) == len(k)), key=lambda c: (c is None, c or 0))
        out.append((name(m), len(k), name(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    sha(",".join("" if c is None else str(c) for c in ends))))
    return Counter(out)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        start = [] if c is None else convs.get(c - c % 5, [])[:h]
        out[c] = start + own[h:]
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got_trie(df):
    assert df.columns == list(TRIE)
    return Counter(tuple(r) for r in df.collect())


def talks(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        base = rng.choice([0, 0, 0, 5, 10])
        for t in range(rng.randint(1, 9)):
            text = f"start {base} {t}" if t < base // 2 or rng.random() < 0.5 else f"own {c} é {t}"
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    for c in range(100, 160):
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(300)] + [(201, t, "user", f"long {t % 3}") for t in range(290)]
    rows += [(None, 1, "user", "start 0 0"), (None, None, None, None), (300, None, "user", "a"), (300, None, "user", "a"),
             (301, 2, None, ""), (302, 3, "", None), (307, 1, "user", "x" * 100_000)]
    return rows


def test_trie(spark, talk):
    rows = talks()
    folder = talk(rows)
    convs = by_turn(rows)
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    want = trie_by_hand(convs)
    for limit in (2, 7, 1000):
        assert got_trie(prefix_trie.conversation_trie(table, limit=limit)) == want
    assert got_trie(queries.op13_prefix_trie(spark, folder)) == trie_by_hand(rebuilt(convs))
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0


def test_trie_of_driver_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.op13_prefix_trie(spark, sf)) == trie_by_hand(rebuilt(by_turn(rows)))


def test_numbering_across_tasks(spark):
    """A conversation over many tasks gets the numbers and keys that it gets in one."""
    items = [(1 if i < 900 else i, i, hashlib.md5(str(i % 7).encode()).digest()) for i in range(1000)]
    rows = spark.createDataFrame(items, "conv bigint, turn bigint, item binary").repartition(6)
    found = {}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found[parts] = sorted((r["conv"], r["turn"], r["at"], bytes(r["key"]), bytes(r["before"]))
                              for r in ordered.number(rows, ["turn"]).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found["1"] == found["7"]
    assert [r[2] for r in found["7"]] == list(range(1, 901)) + [1] * 100


# Repair -------------------------------------------------------------------------------------

BLANK_CHARS = " \t\n\x0b\x0c\r"
STEPS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage_by_hand(rows):
    out, ids = [], set()
    for c, turn, role, text in rows:
        ids.add(c)
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [(c, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out, ids


def repair_by_hand(rows):
    """rows: (turn, role, text) in order."""
    faults, seen, what = Counter(), set(), []
    for _, role, text in rows:
        plain = text.strip(BLANK_CHARS)
        fault = ("blank" if not plain else "duplicate" if (role, text) in seen
                 else "truncated" if plain[-1] not in ".!?" else None)
        seen.add((role, text))
        faults[fault] += 1
        what.append(fault)
    best = {}
    for i in range(len(rows), -1, -1):
        # No sense in more than two insertions at one place.
        for state in range(4):
            ways = []
            for k in range(3):
                at = state
                for _ in range(k):
                    at = STEPS[at][1]
                lead = (5 * k, "I" * k)
                if i == len(rows):
                    if at in (0, 3):
                        ways.append(lead)
                    continue
                _, role, _ = rows[i]
                nexts = [("D", 2, at)]
                if what[i] in (None, "truncated"):
                    extra = 5 if what[i] else 0
                    nexts.append(("R", 1 + extra, STEPS[at][1]))
                    if (at, role[:1]) in KEPT:
                        nexts.append(("K", extra, KEPT[at, role[:1]]))
                for letter, cost, to in nexts:
                    rest = best[i + 1, to]
                    ways.append((lead[0] + cost + rest[0], lead[1] + letter + rest[1]))
            best[i, state] = min(ways)
    cost, edits = best[0, 0]
    out, at, state = [], 0, 0
    for letter in edits:
        row = rows[at] if letter != "I" else None
        at += letter != "I"
        if letter == "K":
            out.append(f"{row[1]}:{row[2]}")
            state = KEPT[state, row[1][0]]
        elif letter in "RI":
            out.append(f"{STEPS[state][0]}:{row[2] if row else ''}")
            state = STEPS[state][1]
    marks = "".join(r[1][:1] or "-" for r in rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(marks, marks[1:])))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, sha("\n".join(out))), out


def repairs_by_hand(rows):
    damaged, ids = damage_by_hand(rows)
    convs = defaultdict(list)
    for c, turn, role, text in damaged:
        item = hashlib.md5(hashlib.md5(role.encode()).digest() + hashlib.md5(text.encode()).digest()).digest()
        convs[c].append((turn is not None, turn or 0, role, item, turn, text))
    return {c: repair_by_hand([(turn, role, text) for _, _, role, _, turn, text in sorted(convs[c], key=lambda r: r[:4])])
            for c in ids}


def broken_talks(seed=11):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unit"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Same.", "ends here. \t", "é."]
    rows = []
    for c in range(120):
        n = rng.choice([0, 1, 2, 3, 5, 8, 13])
        for t in range(n):
            turn = None if rng.random() < 0.03 else t + (3 if rng.random() < 0.05 else 0)
            rows.append((c, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    for c in range(200, 230):
        rows += [(c, t, ["system", "user", "assistant"][t if t < 2 else 2 - t % 2], f"turn {t}.") for t in range(7)]
    rows += [(300, t, ["user", "assistant"][rng.random() < 0.5], f"long {rng.randint(0, 400)}.") for t in range(900)]
    rows += [(None, t, "user", "nobody.") for t in range(3)] + [(301, 1, "user", "x" * 100_000)] + [(302, None, "user", "a.")] * 3
    return rows


@pytest.mark.parametrize("chunk", [3, 64, 4096])
def test_repair(spark, talk, monkeypatch, chunk):
    monkeypatch.setattr(conversation_repair.chunks, "__defaults__", (chunk,))
    rows = broken_talks()
    folder = talk(rows)
    want = repairs_by_hand(rows)
    got = queries.op11_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: w[0] for c, w in want.items()}
    if chunk == 64:
        table = spark.read.parquet(f"{folder}/conversations.parquet")
        lines = defaultdict(list)
        for r in sorted(conversation_repair.repaired(conversation_repair.damaged(table), table.select("conv_id").distinct()
                                                     .withColumnRenamed("conv_id", "conv")).collect(),
                        key=lambda r: r["place"]):
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert lines == {c: w[1] for c, w in want.items() if w[1]}
        empty = table.limit(0)
        assert conversation_repair.audit(conversation_repair.damaged(empty), empty.select(F.col("conv_id").alias("conv"))).count() == 0


def test_repair_of_driver_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()} == {
        c: w[0] for c, w in repairs_by_hand(rows).items()}


def test_ropes():
    rng = random.Random(1)
    for _ in range(300):
        words = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 4))) for _ in range(8)]
        a, b = conversation_repair.Rope(), conversation_repair.Rope()
        for w in words:
            a = a + conversation_repair.Rope(w)
        for w in reversed(words if rng.random() < 0.5 else words[:-1] + [words[-1][:1]]):
            b = conversation_repair.Rope(w) + b
        assert (a < b, b < a, a.hash == b.hash) == (str(a) < str(b), str(b) < str(a), str(a) == str(b))
