"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

The patterns' values are the protected entities.  A term that stands near an entity
discloses it as far as it tells that the entity is meant: pointwise mutual information over
the entity's own information, from document counts of the whole corpus.  The chance of the
entity given the term is smoothed towards the entity's own, so that entities met once count
as well; a term must make its entity more likely than not.  Terms at or above the
threshold are generalised to a prefix if that discloses less, else removed, wherever they
occur.  A document is a distinct text, so copies are no evidence.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, store, text_key
from .spans import apart, digest, find_spans, sha256

# Fixed patterns of the base spans, in a form that never tries a place twice: possessive
# repeats, and starts only where a run of the first class begins (or a match has ended).
EMAIL = ("(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         "(?:\\.[A-Za-z0-9-]++)++")
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "[\\p{L}\\p{N}]{2,}+"

CONTEXT = 80
SMOOTHING = 0.1
DISCLOSURE = 0.9
LIKELY = 0.5
PREFIX = 3
BROADCAST_ROWS = 100_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 1, F.try_element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]).cast("array<int>"), d.cast("int") + 1))
        .otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda p: p.cast("double") <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    return {"email": find_spans(text, EMAIL, "email"),
            "ip": find_spans(text, IP, "ip", _ip),
            "card": find_spans(text, CARD, "card", _luhn),
            "phone": find_spans(text, PHONE, "phone", lambda v: F.length(_digits(v)).between(9, 15))}


def _entity(span: Column) -> Column:
    """One name for all spellings of a value."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(
        span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _prefix(term: Column) -> Column:
    return F.concat(F.substring(term, 1, PREFIX), F.lit("*"))


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) with each text once, and the stored keys of texts that stand in several rows.

    Only texts of such keys are shuffled, one of them for each task at most.
    """
    again = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .select("key", F.lit(True).alias("copied")))
    marked = join_sized(rows.select("key", "text"), again, "key", "left", BROADCAST_ROWS)
    first = marked.filter("copied").groupBy("key").agg(F.first("text").alias("text"))
    return marked.filter("copied IS NULL").select("key", "text").unionByName(first), again


def near_terms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, docs, of_entity) of terms near an entity, and their places (key, entity, term).

    Near is within ``CONTEXT`` code points of one of its spans, words cut by that limit
    left out.  ``docs`` counts documents with the pair, ``of_entity`` those with the entity.
    """
    one = (found.select("key", F.explode(F.concat(*KINDS)).alias("s"), "text")
           .select("key", _entity(F.col("s")).alias("entity"),
                   F.substring("text", F.greatest(F.col("s.start") - CONTEXT, F.lit(0)) + 1,
                               F.least(F.col("s.start"), F.lit(CONTEXT))).alias("before"),
                   F.substring("text", F.col("s.end") + 1, F.lit(CONTEXT)).alias("after"),
                   (F.col("s.start") > CONTEXT).alias("cut")))
    whole = F.when(F.col("cut"), F.regexp_replace("before", "^[\\p{L}\\p{N}]+", "")).otherwise(F.col("before"))
    tail = F.when(F.length("after") == CONTEXT, F.regexp_replace("after", "[\\p{L}\\p{N}]+$", "")).otherwise(F.col("after"))
    near = F.concat_ws(" ", whole, tail)
    one = store(one.select("key", "entity", _terms(near).alias("terms")))
    places = one.select("key", "entity", F.explode("terms").alias("term")).distinct()
    joint = places.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("docs"))
    each = one.select("key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    return joint.join(each, "entity"), places


def _told(docs: Column, of_term: Column, of_entity: Column, n: Column) -> Column:
    """(share, chance): the part of the entity's information that the term gives, and the
    smoothed chance of the entity given the term."""
    chance = (docs + SMOOTHING * of_entity / n) / (of_term + F.lit(SMOOTHING))
    return F.struct((F.lit(1.0) + F.log(chance) / F.log(n / of_entity)).alias("share"), chance.alias("chance"))


def disclosing_terms(found: DataFrame, texts: DataFrame, n_texts: int, threshold: float = DISCLOSURE,
                     likely: float = LIKELY) -> DataFrame:
    """(key, term, action) for every document that holds a term which discloses an entity.

    ``found`` has key, text and the base spans, ``texts`` each distinct text once.  A prefix
    stands for all terms that begin with it: its counts are the sums of theirs.  Texts are
    searched only for terms that more documents hold than have them near an entity.
    """
    pairs, places = near_terms(found)
    # No more prefixes than triples of characters, so this side is broadcast as a rule.
    prefixes = store(pairs.select(_prefix(F.col("term")).alias("prefix")).distinct())
    every = (texts.select(F.explode(_terms(F.col("text"))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("of_term")).withColumn("prefix", _prefix(F.col("term"))))
    counts = store(join_sized(every, prefixes, "prefix", "left_semi", BROADCAST_ROWS).select("term", "of_term"))
    n = F.lit(float(max(n_texts, 1)))

    def risky(t: Column) -> Column:
        return (t["share"] >= threshold) & (t["chance"] >= likely)
    known = pairs.filter(F.col("of_entity") < n)
    own = (known.join(counts, "term")
           .withColumn("told", _told(F.col("docs"), F.col("of_term"), F.col("of_entity"), n))
           .filter(risky(F.col("told"))).select("term", "of_term").distinct().withColumn("prefix", _prefix(F.col("term"))))
    of_prefix = counts.groupBy(_prefix(F.col("term")).alias("prefix")).agg(F.sum("of_term").alias("of_prefix"))
    wide = (known.groupBy("entity", "of_entity", _prefix(F.col("term")).alias("prefix")).agg(F.sum("docs").alias("docs"))
            .join(own.select("prefix").distinct(), "prefix", "left_semi").join(of_prefix, "prefix")
            .filter(risky(_told(F.col("docs"), F.col("of_prefix"), F.col("of_entity"), n)))
            .select("prefix", F.lit(True).alias("told")).distinct())
    told = store(own.join(wide, "prefix", "left").select(
        "term", "of_term", F.when(F.col("told"), "remove").otherwise("generalise").alias("action")))
    here = join_sized(places.select("key", "term").distinct(), told, "term", "inner", BROADCAST_ROWS)
    held = here.groupBy("term").agg(F.count(F.lit(1)).alias("near"), F.first("of_term").alias("of_term"),
                                    F.first("action").alias("action"))
    abroad = store(held.filter("of_term > near").select("term", "action"))
    spread = texts.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    there = join_sized(spread, abroad, "term", "inner", BROADCAST_ROWS)
    return here.select("key", "term", "action").unionByName(there)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = DISCLOSURE) -> DataFrame:
    """(id, text, email, ip, card, phone, term, clean) for every row.

    The kinds hold arrays of spans (kind, start, end, value); a term's value is its action.
    ``clean`` is the text with base spans replaced by their kind in brackets, terms
    generalised to prefix and ``*`` or removed.  Terms within a base span are left to it.
    A NULL text counts as empty.  Rows of one text count as one document and get equal spans.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("*", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    texts, again = distinct_texts(rows)
    n_texts = rows.count() if again.isEmpty() else rows.select("key").distinct().count()
    placed = disclosing_terms(found, texts, n_texts, threshold)
    hits = store(placed.groupBy("key").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
                 .withColumnRenamed("key", "_key"))
    marked = join_sized(found, hits, F.col("key") == F.col("_key"), "left", BROADCAST_ROWS // 10)
    names = F.transform("terms", lambda t: t["term"])
    # Only a row's own terms are looked for, not all words; terms need no escapes.
    whole = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])(?:"), F.array_join(names, "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    spans = find_spans(F.col("text"), whole, "term", lambda v: F.array_contains(names, F.lower(v)))
    actions = F.map_from_entries("terms")
    acted = F.transform(apart(spans, F.concat(*KINDS)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.element_at(actions, F.lower(s["value"])).alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    out = marked.withColumn("term", F.when(F.col("terms").isNotNull(), acted).otherwise(none))
    return out.withColumn("clean", _cleaned()).select("id", "text", *KINDS, "term", "clean")


def _cleaned() -> Column:
    """Text rebuilt from the parts between the spans; of overlapping spans the first counts."""
    spans = F.array_sort(F.transform(F.concat(*KINDS, "term"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        own = F.substring("text", s["start"] + 1, s["end"] - s["start"])
        new = F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(
            s["value"] == "generalise", F.concat(F.substring(own, 1, PREFIX), F.lit("*"))).otherwise("")
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, new)).alias("parts"))).otherwise(acc)
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), empty.alias("parts")), step)
    rest = F.substring("text", done["at"] + 1, F.length("text"))
    return F.concat(F.array_join(done["parts"], ""), rest)


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans, by kind, then start."""
    base = F.concat(*KINDS)
    return found.select(
        "id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        sha256(digest(base)).alias("base_sha256"), digest(F.concat(base, "term")).alias("spans"),
        F.size("term").cast("bigint").alias("n_term"))
