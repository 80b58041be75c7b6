"""Rows of each conversation numbered in order, with a fingerprint of every prefix.

Rows are sorted over the whole table, so a conversation with a large share of all rows is
spread over many tasks.  What a task's first conversation takes over from the tasks before
is one pair of numbers; at most two conversations of a task lie in others as well.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

PRIME = 2**127 - 1
# Any large base will do; all runs must agree on it.
BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15 % PRIME
EMPTY = bytes(16)


def digest_of(*texts: Column) -> Column:
    """16 bytes that tell tuples of texts apart."""
    return F.unhex(F.md5(F.concat(*[F.unhex(F.md5(t.cast("binary"))) for t in texts])))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (1, 2, ... within ``conv``), ``key`` and ``before``, stored.

    ``key`` names the sequence of ``item`` (16 bytes) up to the row, ``before`` that without
    the row: a polynomial over the items modulo a prime of 127 bits.  Rows that agree in
    ``conv`` and ``order`` keep any order among themselves.  NULL ``conv`` is one conversation.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order)

    def local(batches):
        part, first, last, at, total, power = TaskContext.get().partitionId(), True, None, 0, 0, 1
        for batch in batches:
            ats, before, keys = [], [], []
            for conv, item in zip(batch.column("conv").to_pylist(), batch.column("item").to_pylist()):
                if first or conv != last:
                    first, last, at, total, power = False, conv, 0, 0, 1
                before.append(total.to_bytes(16, "big"))
                at, power = at + 1, power * BASE % PRIME
                total = (total + int.from_bytes(item, "big") * power) % PRIME
                ats.append(at)
                keys.append(total.to_bytes(16, "big"))
            extra = [pa.array([part] * len(ats), pa.int32()), pa.array(ats, pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(before, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra],
                                             names=[*batch.schema.names, "part", "at", "key", "before"])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = store(placed.mapInArrow(local, f"{own}, part int, at bigint, key binary, before binary"))
    ends = made.groupBy("conv", "part").agg(F.max(F.struct("at", "key")).alias("end"))
    split = (ends.groupBy("conv").agg(F.count(F.lit(1)).alias("parts"),
                                      F.collect_list(F.struct("part", "end")).alias("ends"))
             .filter("parts > 1").select("conv", "ends").collect())
    # At most two rows of a task: the conversations at its edges.
    carried: dict = defaultdict(dict)
    for row in split:
        n = total = 0
        for part, end in sorted((e["part"], e["end"]) for e in row["ends"]):
            carried[part][row["conv"]] = (n, total)
            total = (total + pow(BASE, n, PRIME) * int.from_bytes(end["key"], "big")) % PRIME
            n += end["at"]
    if not split:
        return made.drop("part")
    carried = dict(carried)

    def whole(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            part = cols.pop("part").to_pylist()
            if any(p in carried for p in set(part)):
                conv = cols["conv"].to_pylist()
                offsets = [carried.get(p, {}).get(c, (0, 0)) for p, c in zip(part, conv)]
                factor: dict = {}
                for name in ("key", "before"):
                    out = []
                    for v, (n, total) in zip(cols[name].to_pylist(), offsets):
                        if n:
                            f = factor.get(n) or factor.setdefault(n, pow(BASE, n, PRIME))
                            v = ((total + f * int.from_bytes(v, "big")) % PRIME).to_bytes(16, "big")
                        out.append(v)
                    cols[name] = pa.array(out, pa.binary())
                cols["at"] = pa.array([a + n for a, (n, _) in zip(cols["at"].to_pylist(), offsets)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return store(made.mapInArrow(whole, f"{own}, at bigint, key binary, before binary"))
