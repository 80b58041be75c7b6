"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.  The
exponent is the smallest in [0, 1] that keeps the entropy at its target and no source
above the repetition limit.  A source's budget is spent in whole passes over a permutation
of its blocks, then in a part of one more pass: blocks in permuted order, and documents in
permuted order within the block where the budget ends.

Only one row per source decides about a document, so no text is shuffled.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, store, text_key, words_of

SEED = 11
ENTROPY = 0.5
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 1 << 20
MAX_BLOCKS = 1 << 16
PROBES = 15
ROUNDS = 9
SOURCES_BROADCAST = 50_000


def exponent(totals: DataFrame, ratio: float, entropy: float, max_epochs: float) -> float:
    """Smallest exponent that meets both limits; ``totals`` has a column tokens > 0.

    ``entropy`` is the target's place between that of the shares (0) and that of equal
    weights (1); ``ratio`` is the budget over all tokens.  Both conditions hold from some
    exponent on, so the interval is cut again and again, at ``PROBES`` points in one
    aggregation.  At 1 the weights are the shares: a budget that repeats those more than
    ``max_epochs`` times can't meet the limit, and 1 is returned.
    """
    share = F.col("tokens") / F.col("_all")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    placed = totals.withColumn("_all", F.lit(int(total)).cast("bigint"))
    facts = placed.agg(F.count(F.lit(1)).alias("n"), (-F.sum(share * F.log(share))).alias("h")).first()
    if not facts["n"]:
        return 1.0
    target = facts["h"] + entropy * (log(facts["n"]) - facts["h"])
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (PROBES + 1) for i in range(PROBES + 1)]
        a = F.explode(F.lit(points).cast("array<double>"))
        got = {r["a"]: r for r in placed.select(share.alias("s"), a.alias("a")).groupBy("a").agg(
            F.sum(F.pow("s", "a")).alias("z"), F.sum(F.pow("s", "a") * F.log("s")).alias("e"),
            F.max(F.pow("s", F.col("a") - 1)).alias("r")).collect()}
        step = high
        for a in reversed(points):
            z, e, r = got[a]["z"], got[a]["e"], got[a]["r"]
            fits = (log(z) - a * e / z <= target + 1e-12
                    and ratio * r / z <= max_epochs * (1 + 1e-12))
            if not fits:
                low, high = a, step
                break
            step = a
        else:
            return 0.0
    return high


def _doc_order(epoch: Column, doc_id: Column, key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, doc_id, key)


def _block_order(epoch: Column, source: Column, doc_id: Column, key: Column, blocks: Column,
                 seed: int) -> Column:
    """Place of a document's block: documents are dealt to blocks by hash."""
    block = F.pmod(F.xxhash64(F.lit(seed + 1), doc_id, key), blocks)
    return F.xxhash64(F.lit(seed + 2), epoch, source, block)


def source_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", budget: float | None = None,
                entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS,
                seed: int = SEED) -> DataFrame:
    """A row per source with words: source, tokens, weight, budget, passes, blocks, and where
    the last, partial pass ends (edge, cutoff).

    ``budget`` counts words in all; by default as many as the documents have.  NULL is a
    source of its own.  Sources without a word have no weight and no row.
    """
    first = F.lit(-1)
    rows = store(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                             F.col(source_col).alias("source"),
                             F.size(words_of(F.col(text_col))).cast("bigint").alias("n"))
                 .filter("n > 0"))
    totals = store(rows.groupBy("source").agg(F.sum("n").alias("tokens")))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(everything if budget is None else budget)
    alpha = exponent(totals, budget / max(everything, 1), entropy, max_epochs)
    power = F.pow(F.col("tokens") / F.lit(max(everything, 1)), F.lit(alpha))
    norm = totals.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(norm)
    spent = weight * F.lit(budget)
    plan = (totals.select("source", "tokens", weight.alias("weight"), spent.alias("budget"),
                          F.floor(spent / F.col("tokens") + 1e-9).cast("bigint").alias("passes"),
                          F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
                          .cast("bigint").alias("blocks"))
            .withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("tokens"), F.lit(0.0))))
    plan = store(plan.withColumn("alpha", F.lit(alpha)))
    keys = plan.select(F.col("source").alias("_source"), "blocks", "rest")
    dealt = (join_sized(rows, keys, F.col("source").eqNullSafe(F.col("_source")), "inner", SOURCES_BROADCAST)
             .withColumn("block", _block_order(first, F.col("source"), F.col("id"), F.col("key"), F.col("blocks"), seed)))
    blocks = dealt.groupBy("source", "block", "rest").agg(F.sum("n").alias("n"))
    # At most MAX_BLOCKS rows a source.
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    edges = store(blocks.withColumn("upto", upto)
                  .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
                  .select(F.col("source").alias("_source"), F.col("block").alias("edge"),
                          (F.col("rest") - F.col("upto") + F.col("n")).alias("left")))
    inside = (join_sized(dealt.select("source", "block", "id", "key", "n"), edges,
                         F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("edge")),
                         "inner", SOURCES_BROADCAST)
              .select("source", "edge", "left", "n",
                      _doc_order(first, F.col("id"), F.col("key"), seed).alias("order"))
              .groupBy("source", "edge", "left", "order").agg(F.sum("n").alias("n")))
    # One block of each source.
    upto = F.sum("n").over(Window.partitionBy("source", "edge").orderBy("order"))
    ends = (inside.withColumn("upto", upto).groupBy("source", "edge")
            .agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("order"))).alias("cutoff"))
            .withColumnRenamed("source", "_source"))
    return store(plan.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def schedule(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with a row for each pass that takes the document.

    ``epoch`` counts passes from 0; within a pass, ``block_order`` then ``doc_order`` is
    the order of training, sources interleaved.  Documents without words, NULL texts among
    them, are in no pass.  Repeated rows are taken alike, and count as often as they occur.
    The three names replace columns of ``docs`` that are called so.
    """
    ends = plan.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"),
                       F.col("blocks").alias("__blocks"), F.col("edge").alias("__edge"),
                       F.col("cutoff").alias("__cutoff"))
    first, key = F.lit(-1), text_key(text_col)
    own, source = F.col(id_col), F.col(source_col)
    block = _block_order(first, source, own, key, F.col("__blocks"), seed)
    order = _doc_order(first, own, key, seed)
    partial = (block < F.col("__edge")) | ((block == F.col("__edge")) & (order <= F.col("__cutoff")))
    more = F.when(F.coalesce(partial, F.lit(False)), 1).otherwise(0)
    names = [c for c in docs.columns if c not in ("epoch", "block_order", "doc_order")]
    passes = (join_sized(docs, ends, source.eqNullSafe(F.col("__source")), "inner", SOURCES_BROADCAST)
              .filter(F.size(words_of(F.col(text_col))) > 0)
              .withColumn("__copies", (F.col("__passes") + more).cast("int")).filter("__copies > 0")
              .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))))
    epoch = F.col("__epoch")
    return passes.select(
        *names, epoch.alias("epoch"),
        _block_order(epoch, source, own, key, F.col("__blocks"), seed).alias("block_order"),
        _doc_order(epoch, own, key, seed).alias("doc_order"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **limits) -> DataFrame:
    """Plan and schedule in one step."""
    plan = source_plan(docs, id_col, text_col, source_col, **limits)
    return schedule(docs, plan, id_col, text_col, source_col)
