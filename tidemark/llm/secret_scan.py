"""Secrets: fixed patterns, then strings that look random by their characters.

Two first-order Markov models of characters, one of labelled random strings and one of the
corpus's ordinary identifiers, give every long token a log-likelihood ratio.  Tokens far on
the random side are reported besides the patterns' spans.  Built-in functions only.
"""

from __future__ import annotations

from functools import lru_cache
from math import log
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import digest, find_spans, sha256, uncovered

# Fixed patterns of the base spans; the value is the group named.
ASSIGN = ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
ASSIGN_MIN, ACCESS_MIN = 12, 18

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
SIDE = len(ALPHABET) + 1
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
# Labelled random strings: so many of each alphabet, drawn by a seeded generator.
RANDOM_STRINGS, RANDOM_LENGTHS, RANDOM_SEED = 2000, (16, 64), 5
RANDOM_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
MIN_RATIO = 10.0
SMOOTHING = 0.5
START = "\u0002"


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    return (find_spans(text, ASSIGN, "assign", lambda v: F.length(v) >= ASSIGN_MIN, group=2),
            find_spans(text, ACCESS, "access", lambda v: F.length(v) >= ACCESS_MIN),
            find_spans(text, HEX, "hex"))


def _pairs(token: Column) -> Column:
    """Every character of a token after the one before it."""
    return F.regexp_extract_all(F.concat(F.lit(START), token), F.lit("(?s)(?=(..))"), F.lit(1))


@lru_cache(maxsize=1)
def random_strings() -> tuple[str, ...]:
    rng = Random(RANDOM_SEED)
    return tuple("".join(rng.choices(a, k=rng.randint(*RANDOM_LENGTHS)))
                 for a in RANDOM_ALPHABETS for _ in range(RANDOM_STRINGS))


def identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token): ordinary identifiers of 8 or more characters in all texts, each once.

    Counting an identifier once keeps copies and frequent words from ruling the model.
    Tokens with digits in two places, as in most secrets, are not taken for ordinary, nor
    are those with a run that the fixed patterns take.
    """
    return (docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token")
            .filter(~F.col("token").rlike(HEX) & ~F.col("token").rlike(ACCESS) & ~F.col("token").rlike("[0-9][^0-9]+[0-9]")))


def ratios(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log ratio (random over ordinary) of every pair of characters, ``SIDE`` x ``SIDE``.

    All zero where there is no ordinary identifier.
    """
    known = F.lit(ALPHABET)
    # At most one row for each pair of known characters; all others count as one.
    found = (identifiers(docs, text_col).select(F.explode(_pairs(F.col("token"))).alias("pair"))
             .select(F.instr(known, F.substring("pair", 1, 1)).alias("a"), F.instr(known, F.substring("pair", 2, 1)).alias("b"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect())
    if not found:
        return [0.0] * (SIDE * SIDE)
    ordinary, random = ([SMOOTHING] * (SIDE * SIDE) for _ in range(2))
    for r in found:
        ordinary[r["a"] * SIDE + r["b"]] += r["n"]
    for token in random_strings():
        last = 0
        for c in token:
            code = ALPHABET.find(c) + 1
            random[last * SIDE + code] += 1
            last = code
    share = []
    for counts in (random, ordinary):
        rows = [sum(counts[i:i + SIDE]) for i in range(0, SIDE * SIDE, SIDE)]
        share.append([n / rows[i // SIDE] for i, n in enumerate(counts)])
    return [log(r / o) for r, o in zip(*share)]


def log_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the pairs' log ratios, in one walk over the characters."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    values = F.lit(table).cast("array<double>")
    return F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
                       lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.get(values, a["last"] * SIDE + c)).alias("sum")),
                       lambda a: a["sum"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         min_ratio: float = MIN_RATIO) -> DataFrame:
    """(id, assign, access, hex, markov): arrays of spans (kind, start, end, value) per row.

    A row for every row; a NULL text counts as empty and has no span.  ``markov`` holds
    tokens of 16 or more characters whose log ratio is at least ``min_ratio`` and that lie
    within no other span; a token of which a pattern takes only a part is reported whole.
    """
    table = ratios(docs, text_col)
    text = F.col("text")
    kinds = base_spans(text)
    spans = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .select("id", "text", *[k.alias(n) for k, n in zip(kinds, ("assign", "access", "hex"))]))
    found = find_spans(text, TOKEN, "markov", lambda v: log_ratio(v, table) >= min_ratio)
    return (spans.withColumn("markov", found)
            .withColumn("markov", uncovered(F.col("markov"), F.concat("assign", "access", "hex"))).drop("text"))


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans, and all spans by start, then kind."""
    def by_start(*kinds: str) -> Column:
        rank = [F.transform(k, lambda s, n=n: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"),
                                                       s["kind"].alias("kind"), s["end"].alias("end")))
                for n, k in enumerate(kinds)]
        return digest(F.array_sort(F.concat(*rank)))
    return found.select(
        "id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        sha256(by_start("assign", "access", "hex")).alias("base_sha256"),
        by_start("assign", "access", "hex", "markov").alias("spans"))
