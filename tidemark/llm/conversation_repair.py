"""Cheapest repair of conversations: a min-plus product over grammar-compressed turns.

Each row becomes one of nine symbols, by role and fault.  Re-Pair replaces frequent pairs
of symbols by rules, counted over the sequences of all conversations.  A rule has one 4 x 4
min-plus matrix over the states of the role grammar: entry (p, q) is the least cost to lead
from p to q over the rule's rows, with the edits as a rope of its parts' ropes.  Matrices
are made bottom-up, once per rule, and shared by all conversations that use it.

Sequences are cut from the whole table in order and in chunks, so a conversation with very
many rows is compressed and multiplied by many tasks.  Only the text hash, which must see a
conversation's texts one after the other, streams them through one task, a row at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, store
from .ordered import digest_of

CHUNK = 4096
ROUNDS = 16
TOP_PAIRS = 64
BROADCAST_ROWS = 100_000
CACHE = 20_000
BLANKS = " \t\n\x0b\x0c\r"
# States: nothing yet, after system, after user, after assistant; the first and last may end.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NEXT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
MOVE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDING = {0: 0, 1: 2, 2: 1, 3: 0}
REROLE, DELETE, INSERT, OPEN = 1, 2, 5, 5
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
GONE = 8
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ENTRY = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
CHUNK_ROW = "conv {conv}, part int, no int, codes binary"
_HASH, _MOD = 1_000_003, 2**61 - 1


class Rope:
    """A string as a tree, with a hash of its content; compared without being spelt out."""

    __slots__ = ("n", "hash", "power", "left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is not None:
            self.n = left.n + right.n
            self.power = left.power * right.power % _MOD
            self.hash = (left.hash * right.power + right.hash) % _MOD
        else:
            self.n, self.power, self.hash = len(text), pow(_HASH, len(text), _MOD), 0
            for c in text:
                self.hash = (self.hash * _HASH + ord(c)) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not other.n:
            return self
        return Rope(left=self, right=other) if self.n else other

    def __lt__(self, other: Rope) -> bool:
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a.n == b.n and a.hash == b.hash:
                continue
            if a.left is not None and (a.n >= b.n or b.left is None):
                mine += [a.right, a.left]
                theirs.append(b)
            elif b.left is not None:
                theirs += [b.right, b.left]
                mine.append(a)
            else:
                k = min(a.n, b.n)
                if a.text[:k] != b.text[:k]:
                    return a.text < b.text
                mine += [Rope(a.text[k:])] if a.n > k else []
                theirs += [Rope(b.text[k:])] if b.n > k else []
        return bool(theirs)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                parts.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(parts)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] < b[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least sums; of equal ones the least edits.  No entry's edits begin another's, as the
    edits of a row end with the row's own letter, so the least parts make the least whole."""
    out: Matrix = {}
    for (p, m), (cost, rope) in a.items():
        for q in range(4):
            step = b.get((m, q))
            if step is not None:
                new = (cost + step[0], rope + step[1])
                if _better(new, out.get((p, q))):
                    out[p, q] = new
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """Insertions before a row, then the row: kept, given another role, or deleted."""
    out: Matrix = {}
    for p in range(4):
        state = p
        for inserts in range(3):
            cost = INSERT * inserts
            ways = [(state, DELETE, "D")]
            if symbol != GONE:
                extra = OPEN if symbol // 4 == TRUNCATED else 0
                ways.append((MOVE[state][1], REROLE + extra, "R"))
                if (state, symbol % 4) in NEXT:
                    ways.append((NEXT[state, symbol % 4], extra, "K"))
            for q, own, letter in ways:
                new = (cost + own, Rope("I" * inserts + letter))
                if _better(new, out.get((p, q))):
                    out[p, q] = new
            state = MOVE[state][1]
    return out


class Grammar:
    """Re-Pair rules in rounds; symbol 9 + i is the i-th rule."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.size = GONE + 1

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({pair: self.size + i for i, pair in enumerate(pairs)})
        self.size += len(pairs)

    def encode(self, codes: bytes) -> list[int]:
        now = [c if c < GONE else GONE for c in codes]
        for rules in self.rounds:
            out, i, n = [], 0, len(now)
            while i < n:
                rule = rules.get((now[i], now[i + 1])) if i + 1 < n else None
                out.append(now[i] if rule is None else rule)
                i += 1 if rule is None else 2
            now = out
        return now

    def matrices(self) -> list[Matrix]:
        """Bottom-up: a rule's parts stand before it."""
        made = [symbol_matrix(s) for s in range(GONE + 1)]
        for rules in self.rounds:
            made += [product(made[a], made[b]) for a, b in rules]
        return made


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, top: int = TOP_PAIRS) -> Grammar:
    """Rules for the most frequent pairs over (codes, n): sequences and how often each occurs.

    In each round, pairs are taken by frequency as long as they share no symbol.  Any grammar
    gives the same repairs; it settles how much of the work is shared.
    """
    grammar = Grammar()
    for _ in range(rounds):
        def pairs(batches, grammar=grammar):
            for batch in batches:
                count: dict = {}
                for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    now = grammar.encode(codes)
                    for pair in zip(now, now[1:]):
                        count[pair] = count.get(pair, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in count], pa.int32()), pa.array([p[1] for p in count], pa.int32()),
                     pa.array(list(count.values()), pa.int64())], names=["a", "b", "n"])
        best = (sequences.mapInArrow(pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
                .filter("n > 1").orderBy(F.col("n").desc(), "a", "b").limit(top).collect())
        used: set = set()
        chosen = []
        for r in best:
            if not used & {r["a"], r["b"]}:
                used |= {r["a"], r["b"]}
                chosen.append((r["a"], r["b"]))
        if not chosen:
            break
        grammar.add(chosen)
    return grammar


def damaged(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with planted faults; a row in twenty each is dropped, emptied,
    cut of its stops, repeated, or given to the user, by checksum of ``conv:turn``."""
    conv, turn = F.col(conv_col), F.col(turn_col)

    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    role, text = plain(role_col), plain(text_col)
    rows = convs.select(
        conv.alias("conv"), turn.alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.expr("array_repeat(1, times)"))).drop("times")


def _last(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, item, n, code, again): distinct rows, how often each stands, its code
    at its first place and at all others.

    ``rows`` has conv, turn, role, text.  A code is four times the fault plus the role.
    """
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(_last(F.col("text")) == "", BLANK).when(
        _last(F.col("text")).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    slim = rows.select("conv", "turn", "role", digest_of(F.col("role"), F.col("text")).alias("item"),
                       role.alias("who"), fault.alias("fault"))
    once = slim.groupBy("conv", "turn", "role", "item", "who", "fault").agg(F.count(F.lit(1)).alias("n"))
    once = store(once)
    first = store(once.groupBy("conv", "item").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("places"))
                  .filter("places > 1").select(F.col("conv").alias("_c"), F.col("item").alias("_i"), "first"))
    met = join_sized(once, first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("item") == F.col("_i")),
                     "left", BROADCAST_ROWS)
    seen = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    blank = F.col("fault") == BLANK
    return met.select("conv", "turn", "role", "item", "n",
                      (F.when(seen & ~blank, DUPLICATE).otherwise(F.col("fault")) * 4 + F.col("who")).alias("code"),
                      (F.when(blank, BLANK).otherwise(DUPLICATE) * 4 + F.col("who")).alias("again"))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv, part, no, codes), stored: each conversation's codes in order, in pieces."""
    spark = rows.sparkSession
    order = ("conv", "turn", "role", "item")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = coded(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "n", "code", "again")
    kind = rows.schema["conv"].dataType.simpleString()

    def cut(batches):
        part = TaskContext.get().partitionId()
        started, last, no, codes, out = False, None, 0, bytearray(), []

        def table():
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], conv_type), pa.array([part] * len(out), pa.int32()),
                 pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())],
                names=["conv", "part", "no", "codes"])
            out.clear()
            return made
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, n, code, again in zip(*(c.to_pylist() for c in batch.columns)):
                if started and conv != last:
                    if codes:
                        out.append((last, no, bytes(codes)))
                    no, codes = 0, bytearray()
                started, last = True, conv
                codes.append(code)
                left = n - 1
                while left or len(codes) >= size:
                    take = min(left, size - len(codes))
                    codes += bytes([again]) * take
                    left -= take
                    if len(codes) >= size:
                        out.append((conv, no, bytes(codes)))
                        no, codes = no + 1, bytearray()
                        if len(out) * size > 1 << 22:
                            yield table()
            if len(out) > 1000:
                yield table()
        if started:
            if codes:
                out.append((last, no, bytes(codes)))
            if out:
                yield table()
    return store(placed.mapInArrow(cut, CHUNK_ROW.format(conv=kind)))


SOLVED = f"conv {{conv}}, part int, no int, first int, last int, faults array<bigint>, entries {ENTRY}"


def solve(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Chunks with their matrix, their fault counts (by fault; then wrong neighbours) and edge roles."""
    kind = pieces.schema["conv"].dataType.simpleString()

    def one(codes: bytes, made: list[Matrix]):
        whole: Matrix | None = None
        for symbol in grammar.encode(codes):
            whole = made[symbol] if whole is None else product(whole, made[symbol])
        counts = [0] * 4
        for c in codes:
            counts[c // 4] += 1
        counts[FINE] = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:]))
        return (codes[0] % 4, codes[-1] % 4, counts,
                [{"p": p, "q": q, "cost": cost, "audit": str(rope)} for (p, q), (cost, rope) in whole.items()])

    def run(batches):
        made = grammar.matrices()
        known: dict = {}
        for batch in batches:
            rows = []
            for codes in batch.column(3).to_pylist():
                if codes not in known:
                    if len(known) > CACHE:
                        known.clear()
                    known[codes] = one(codes, made)
                rows.append(known[codes])
            entry = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], entry)],
                names=["conv", "part", "no", "first", "last", "faults", "entries"])
    return pieces.mapInArrow(run, SOLVED.format(conv=kind))


class _Conversation:
    """One conversation while its chunks, then its texts, stream by."""

    def __init__(self, conv):
        self.conv = conv
        self.best = {0: (0, Rope())}
        self.faults = [0] * 4
        self.role = None
        self.audit = None
        self.at = self.state = self.count = self.places = 0
        self.low = self.high = None
        self.sha = hashlib.sha256()

    def chunk(self, first, last, faults, entries):
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        if self.role is not None and (self.role, first) not in LEGAL:
            self.faults[FINE] += 1
        self.role = last
        new: dict = {}
        for e in entries:
            if e["p"] in self.best:
                cost, rope = self.best[e["p"]]
                step = (cost + e["cost"], rope + Rope(e["audit"]))
                if _better(step, new.get(e["q"])):
                    new[e["q"]] = step
        self.best = new

    def settle(self):
        end = None
        for state, (cost, rope) in self.best.items():
            step = (cost + INSERT * ENDING[state], rope + Rope("I" * ENDING[state]))
            end = step if _better(step, end) else end
        self.cost, self.audit = end[0], str(end[1])

    def _put(self, role, text):
        self.sha.update(f"{chr(10) if self.places else ''}{role}:{text}".encode())
        self.places += 1
        return self.conv, self.places, role, text

    def inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            role, self.state = MOVE[self.state]
            self.at += 1
            yield self._put(role, "")

    def row(self, turn, role, text):
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.count = turn, self.count + 1
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]]
            yield self._put(role, text)
        elif letter == "R":
            role, self.state = MOVE[self.state]
            yield self._put(role, text)

    def report(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.count
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.faults[FINE],
                self.cost, self.audit, self.sha.hexdigest())


REPORT = ("conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string, repaired_sha256 string")
REPAIRED = "conv_id {conv}, place bigint, role string, text string"


def _streamed(rows: DataFrame, ids: DataFrame, with_rows: bool) -> DataFrame:
    pieces = chunks(rows)
    grammar = learn_grammar(store(pieces.groupBy("codes").agg(F.count(F.lit(1)).alias("n"))))
    solved = solve(pieces, grammar).withColumn("kind", F.lit(0))
    texts = rows.select("conv", "turn", "role", "text", digest_of(F.col("role"), F.col("text")).alias("item"),
                        F.lit(1).alias("kind"))
    both = (solved.unionByName(texts, allowMissingColumns=True)
            .unionByName(ids.select("conv", F.lit(2).alias("kind")), allowMissingColumns=True)
            .repartition("conv").sortWithinPartitions("conv", "kind", "part", "no", "turn", "role", "item")
            .select("conv", "kind", "first", "last", "faults", "entries", "turn", "role", "text"))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        now, started, out = None, False, []
        names = ("conv_id", "place", "role", "text") if with_rows else tuple(
            c.split(" ")[0] for c in REPORT.split(", "))

        def table():
            types = ([conv_type, pa.int64(), pa.string(), pa.string()] if with_rows else
                     [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()])
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        def finish():
            if now.audit is None:
                now.settle()
            made = list(now.inserted())
            out.extend(made if with_rows else [now.report()])
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, what, first, last, faults, entries, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != now.conv:
                    if started:
                        finish()
                    started, now = True, _Conversation(conv)
                if what == 0:
                    now.chunk(first, last, faults, entries)
                elif what == 1:
                    if now.audit is None:
                        now.settle()
                    made = list(now.row(turn, role, text))
                    if with_rows:
                        out += made
            if out:
                yield table()
        if started:
            finish()
            if out:
                yield table()
    return both.mapInArrow(run, (REPAIRED if with_rows else REPORT).format(conv=kind))


def audit(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    ``rows`` has conv, turn, role, text (role and text without NULL); ``ids`` lists every
    conv once.  Rows go by turn, NULL first, then by role and by a digest of (role, text).
    Blank rows and rows whose role and text came before must be deleted; a role that does
    not begin with s, u or a fits nowhere (so an empty one can't be kept).  Edits: Keep 0,
    Rerole 1, Delete 2, Insert 5; a truncated row that stays adds 5.  Of equally cheap
    edits those whose initials come first in ASCII are taken.  A conv without rows has
    zeros, empty edits and the hash of the empty string; NULL is a conv like any other.
    """
    return _streamed(rows, ids, False)


def repaired(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations."""
    return _streamed(rows, ids, True)
