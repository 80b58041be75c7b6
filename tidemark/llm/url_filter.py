"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides train the models: one of variable order for accepted URLs, one
for rejected ones.  An order's estimate is smoothed with the next lower one by the share
of new characters seen in its context.  The rest is judged by the difference of the two
log-likelihoods by character, against a threshold calibrated on rule-decided URLs that the
models have not seen.  Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_remainder, join_sized, lower_ascii, store

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))
ORDER = 3
ALPHABET = 256
BINS = 100
BIN_LIMIT = 1000
HELD_OUT = 5
BROADCAST_ROWS = 300_000
CLASSES = ("allow", "block")
START, END = "\u0002", "\u0003"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Empty for NULL and without ``://``.
    """
    return F.coalesce(lower_ascii(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty where the host is absent."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else NULL.

    A rule ``host/path`` fits the host and its subdomains where the URL's path starts with
    the rule's.  Of equally long rules the first listed wins.  Rules are a list in code.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _windows(order: int) -> Column:
    """Every character of a URL and its end, each after the ``order`` before it."""
    padded = F.concat(F.lit(START * order), F.col("url"), F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def _tail(gram: str, size: int) -> Column:
    return F.substring(gram, -size, size)


def character_ratios(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, ratio): log of accepted over rejected probability of a window's last character.

    ``windows`` has a row per window with its counts n_allow and n_block, zeros included.
    For each class, p(x | c) = (n(cx) + t(c) p(x | c')) / (n(c) + t(c)), where t counts the
    characters seen after the context c and c' is c without its first character.
    """
    below = None
    for k in range(order + 1):
        grams = windows.groupBy(_tail("window", k + 1).alias("gram")).agg(
            *[F.sum(f"n_{c}").alias(f"n_{c}") for c in CLASSES])
        grams = store(grams)
        contexts = grams.groupBy(F.substring("gram", 1, k).alias("context")).agg(
            *[F.sum(f"n_{c}").alias(f"all_{c}") for c in CLASSES],
            *[F.sum((F.col(f"n_{c}") > 0).cast("bigint")).alias(f"t_{c}") for c in CLASSES])
        rows = join_sized(grams.withColumn("context", F.substring("gram", 1, k)), store(contexts),
                          "context", "inner", BROADCAST_ROWS)
        if below is None:
            for c in CLASSES:
                rows = rows.withColumn(f"q_{c}", F.lit(1.0 / ALPHABET))
        else:
            rows = join_sized(rows.withColumn("lower", _tail("gram", k)), below, "lower", "inner", BROADCAST_ROWS)
        p = [F.when(F.col(f"all_{c}") > 0, (F.col(f"n_{c}") + F.col(f"t_{c}") * F.col(f"q_{c}"))
                    / (F.col(f"all_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")).alias(f"q_{c}")
             for c in CLASSES]
        below = store(rows.select(F.col("gram").alias("lower"), *p))
    return below.select(F.col("lower").alias("window"), F.log(F.col("q_allow") / F.col("q_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """Least score by which a URL is accepted: where the two classes' error rates add up to
    the least on ``scored`` (label, score), nearest to 0 on ties.

    Without rejected URLs everything is accepted, else without accepted ones nothing.
    At most ``2 * BIN_LIMIT + 1`` bins are ordered, and one row reaches the driver.
    """
    low, high = F.lit(-BIN_LIMIT), F.lit(BIN_LIMIT)
    place = F.least(high, F.greatest(low, F.floor(F.col("score") * BINS).cast("int")))
    bins = scored.groupBy(place.alias("bin")).agg(*[
        F.sum((F.col("label") == c).cast("double")).alias(c) for c in CLASSES])
    one = Window.partitionBy(F.lit(1))
    before = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    missed = F.coalesce(F.sum("allow").over(before), F.lit(0.0)) / F.sum("allow").over(one)
    passed = 1 - F.coalesce(F.sum("block").over(before), F.lit(0.0)) / F.sum("block").over(one)
    # No URL lies between two bins: any limit there does as well, so that nearest to 0.
    gap = F.coalesce(F.lag("bin").over(one.orderBy("bin")) + 1, low)
    bin_ = F.least("bin", F.greatest(gap, F.lit(0))).alias("bin")
    best = (bins.select(bin_, (missed + passed).alias("error"), F.sum("allow").over(one).alias("a"),
                        F.sum("block").over(one).alias("b"))
            .agg(F.min(F.struct(F.round("error", 9).alias("error"), F.abs("bin").alias("far"), "bin")).alias("best"),
                 F.max("a").alias("a"), F.max("b").alias("b")).first())
    if not best["b"]:
        return float("-inf")
    if not best["a"]:
        return float("inf")
    return best["best"]["bin"] / BINS


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row.

    ``score`` is the mean log ratio by character, of all URLs; it decides where no rule
    does.  A NULL URL is judged as an empty one.  Equal URLs count once in training.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    urls = store(slim.groupBy("url").agg(F.count(F.lit(1)).alias("rows"))
                 .withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
                 .withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
                 .select("url", "host", "path", F.col("hit.verdict").alias("label"), F.col("hit.rule").alias("rule"),
                         is_remainder("url", HELD_OUT, 0).alias("held")))
    spread = urls.select("url", "label", "held", F.explode(_windows(order)).alias("window"))
    known = F.when(~F.col("held"), F.col("label"))
    counts = store(spread.groupBy("window").agg(*[
        F.sum(F.when(known == c, 1).otherwise(0)).alias(f"n_{c}") for c in CLASSES]))
    ratios = store(character_ratios(counts, order))
    scores = (join_sized(spread.select("url", "window"), ratios, "window", "inner", BROADCAST_ROWS)
              .groupBy("url").agg(F.avg("ratio").alias("score")))
    judged = store(urls.join(scores, "url"))
    limit = threshold(judged.filter("held AND label IS NOT NULL").select("label", "score"))
    verdict = F.coalesce("label", F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block"))
    named = judged.select("url", "host", "path", "rule", verdict.alias("verdict"), "score")
    return slim.join(named, "url").select("id", "host", "path", "rule", "verdict", "score")
