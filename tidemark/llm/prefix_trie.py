"""Trie of conversations by their leading turns, built from burst containers.

A container holds the suffixes below one trie head.  A container with more suffixes than
the limit bursts: its head stays and the suffixes go on by their next turn into smaller
ones.  Counting every prefix once tells where all bursts end.  What remains is sorted,
deepest turns first, and swept into nodes; a sweep keeps two levels of one container, so
its memory is bounded by the limit however long the conversations are.  Suffixes that no
other conversation shares are chains and need no sweep.  Heads are few, at most one in
``limit`` rows, and get their sums from the containers along one member's path each.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_sized, store
from .ordered import EMPTY, digest_of, number

LIMIT = 128
BROADCAST_ROWS = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("key binary, parent binary, conv_id {conv}, depth bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def turn_rows(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, item, bytes): the turns of each conversation, numbered from 1.

    By turn, NULL first; turns of one number by role, then by a digest of the text.
    NULL role or text counts as empty.  ``item`` names (role, text).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = convs.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                        digest_of(role, text).alias("item"), F.octet_length(text).cast("bigint").alias("bytes"))
    return number(rows, ["turn", "role", "item"]).select("conv", "at", "item", "bytes")


def _shared(conv: Column) -> Column:
    """How many leading turns a conversation takes over: 0 to 8; none for a NULL id."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 9, F.lit(0))


def with_shared_starts(turns: DataFrame) -> DataFrame:
    """(conv, at, item, bytes) of conversations whose first turns are those of another one.

    Conversation c takes the first h turns of c - c % 5, then its own after its first h.
    """
    def base(c: Column) -> Column:
        return c - c % 5
    conv = F.col("conv")
    starts = store(turns.filter((conv % 5 == 0) & (F.col("at") <= 8)))
    have = store(starts.groupBy("conv").agg(F.max("at").alias("have")).withColumnRenamed("conv", "base"))
    ids = turns.select("conv").distinct()
    taken = (starts.withColumn("c", F.explode(F.sequence(conv - 4, conv + 4)))
             .filter((base(F.col("c")) == conv) & (_shared(F.col("c")) >= F.col("at")))
             .select(F.col("c").alias("conv"), "at", "item", "bytes").join(ids, "conv", "left_semi"))
    own = turns.withColumn("h", _shared(conv)).filter("at > h").withColumn("base", base(conv))
    own = join_sized(own, have, "base", "left", BROADCAST_ROWS)
    moved = own.select("conv", (F.col("at") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0)))).alias("at"),
                       "item", "bytes")
    return taken.unionByName(moved)


def _sweep(conv_type: pa.DataType):
    """Sorted container rows -> nodes that two or more conversations share."""
    names = ("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    kinds = (pa.binary(), pa.binary(), conv_type, *[pa.int64()] * 5, pa.string())

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        box = level = node = None
        below: dict = {}
        above: dict = {}
        out: list = []

        def close():
            key, parent, conv, depth, n, size, ends, sha = node
            children, leaves, saved = below.pop(key, (0, 0, 0))
            leaves, saved = leaves or 1, saved + (n - 1) * size
            c, l, s = above.get(parent, (0, 0, 0))
            above[parent] = (c + 1, l + leaves, s + saved)
            if n > 1:
                out.append((key, parent, conv, depth, n, children, leaves, saved, sha.hexdigest()))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("box", "depth", "key", "parent", "conv", "bytes", "last")]
            for b, depth, key, parent, conv, size, last in zip(*columns):
                if node is None or key != node[0] or b != box:
                    if node is not None:
                        close()
                    if b != box:
                        box, level, below, above = b, depth, {}, {}
                    elif depth != level:
                        level, below, above = depth, above, {}
                    node = [key, parent, conv, depth, 0, size, 0, hashlib.sha256()]
                node[4] += 1
                node[2] = conv if node[2] is None else node[2]
                if last:
                    node[7].update(b"," * (node[6] > 0) + str("" if conv is None else conv).encode())
                    node[6] += 1
            if len(out) > 10_000:
                yield table(out)
                out.clear()
        if node is not None:
            close()
        if out:
            yield table(out)
    return run


def _end_digests(batches):
    """(key, conv) sorted -> (key, sha256 of the comma-joined conversations)."""
    last = sha = None
    for batch in batches:
        keys, shas = [], []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                if sha is not None:
                    keys.append(last)
                    shas.append(sha.hexdigest())
                last, sha, first = key, hashlib.sha256(), True
            sha.update((b"" if first else b",") + str("" if conv is None else conv).encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])


def trie(turns: DataFrame, members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie over (conv, at, item, bytes); ``members`` lists every conv once.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) per node, the root included where there is a member.  ``conv_id`` is the
    smallest member, NULL only if it is alone.  ``saved_tokens`` sums (n_convs - 1) times
    the bytes of the node's last turn over the subtree.  Equal results at any ``limit``.
    An empty table has no node.
    """
    kind = members.schema["conv"].dataType.simpleString()
    steps = number(turns.select("conv", "at", "item", "bytes").withColumnRenamed("at", "turn"), ["turn"])
    length = store(members.join(steps.groupBy("conv").agg(F.max("at").alias("length")).withColumnRenamed("conv", "_c"),
                                F.col("conv").eqNullSafe(F.col("_c")), "left")
                   .select("conv", F.coalesce("length", F.lit(0)).alias("length")))
    root = length.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(EMPTY).alias("key"),
                         F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("bytes"),
                         (F.col("length") == 0).alias("last"))
    ends = length.withColumnsRenamed({"conv": "_c", "length": "_n"})
    lasts = steps.join(ends, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_n")), "left").select(
        "conv", F.col("at").alias("depth"), "key", F.col("before").alias("parent"), "bytes",
        F.col("_n").isNotNull().alias("last"))
    rows = store(root.unionByName(lasts))
    shared = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = store(join_sized(rows, shared, "key", "left", BROADCAST_ROWS).withColumn("n", F.coalesce("n", F.lit(1))))
    inside = (F.col("n") > 1) & (F.col("n") <= limit)

    # Chains: all below a conversation's last shared turn is its own.
    alone = rows.filter("n = 1")
    chains = alone.select(
        "key", "parent", F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary"), 256))
        .otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))

    # Containers: the shared suffixes below a head, and the first step of each chain.
    tops = (rows.groupBy("conv").agg(F.min(F.when(inside, F.struct("depth", "key"))).alias("top"),
                                     F.min(F.when(F.col("n") == 1, F.col("depth"))).alias("tip"))
            .filter("top IS NOT NULL").select(F.col("conv").alias("_c"), F.col("top.key").alias("box"), "tip"))
    held = (rows.join(tops, F.col("conv").eqNullSafe(F.col("_c")))
            .filter(inside | (F.col("depth") == F.col("tip")))
            .select("box", "depth", "key", "parent", "conv", "bytes", "last"))
    order = ["box", F.col("depth").desc(), "key", F.col("conv").asc_nulls_last()]
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    swept = store(held.repartition("box").sortWithinPartitions(*order)
                  .mapInArrow(_sweep(conv_type), NODE.format(conv=kind)))

    # Heads: what hangs below each directly, then sums along one member's path.
    head_rows = rows.filter(F.col("n") > limit)
    heads = (head_rows.groupBy("key").agg(F.min("conv").alias("conv_id"), F.first("depth").alias("depth"),
                                          F.first("parent").alias("parent"), F.first("bytes").alias("bytes"),
                                          F.first("n").alias("n_convs")))
    heads = store(heads)
    hung = (alone.select("parent", F.lit(1).alias("leaves"), F.lit(0).alias("saved"))
            .unionByName(swept.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
            .unionByName(heads.select("parent", F.lit(0).alias("leaves"), F.lit(0).alias("saved"))))
    below = (join_sized(hung, heads.select(F.col("key").alias("parent")), "parent", "left_semi", BROADCAST_ROWS)
             .groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"),
                                    F.sum("saved").alias("saved")).withColumnRenamed("parent", "key"))
    last = head_rows.filter("last").select("key", "conv")
    digests = (last.repartition("key").sortWithinPartitions("key", F.col("conv").asc_nulls_last())
               .mapInArrow(_end_digests, "key binary, sha string"))
    own = store(heads.join(below, "key", "left").join(digests, "key", "left").select(
        "key", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256")))
    given = own.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "leaves", "saved")
    paths = join_sized(head_rows.select("conv", "depth", "key"), store(given.select("_c").distinct()),
                       F.col("conv").eqNullSafe(F.col("_c")), "left_semi", BROADCAST_ROWS)
    path = Window.partitionBy("conv").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = (paths.join(given, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
              .select("key", F.sum(F.coalesce("leaves", F.lit(0))).over(path).alias("leaves"),
                      F.sum(F.coalesce("saved", F.lit(0))).over(path).alias("saved"))
              .groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    top = own.drop("leaves", "saved").join(summed, "key").select(swept.columns)

    nodes = chains.unionByName(swept).unionByName(top)
    names = store(swept.unionByName(top).select(F.col("key").alias("parent"), F.col("conv_id").alias("of_parent")))
    joined = join_sized(nodes, names, "parent", "left", BROADCAST_ROWS)
    up = F.when(F.col("depth") > 0, F.coalesce("of_parent", F.col("conv_id")))
    return joined.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), up.alias("parent_conv_id"),
        *[F.col(c).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        "ends_sha256")


def conversation_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The trie of conversations as they are; other columns of ``convs`` are not read."""
    turns = turn_rows(convs, conv_col, turn_col, role_col, text_col)
    return trie(turns, turns.select("conv").distinct(), limit)
