"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that stays together.  Groups go, largest
first, to the least-loaded shard.  Only the multiset of group sizes decides how
many groups of a size a shard gets, so the driver schedules the *histogram* of
group sizes (distinct sizes number at most sqrt(2 x all bytes)) through a heap,
and the groups of one size are then dealt to the shards by rank in Spark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, attach, bucket, materialize, pick, ranked

#: Bytes a document takes besides its text.
OVERHEAD = 8


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int], list[int]]]:
    """Longest-processing-time schedule of ``(size, count)`` pairs.

    Returns, per size, the shards that take groups of it and the running count
    of groups up to and including each.  Once no two loads lie further apart
    than one group, a full round gives every shard exactly one, so the whole
    rounds of a size are dealt at once and the heap takes the rest; loads are
    those of dealing one group after another.
    """
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size, left in sorted(sizes, reverse=True):
        got = [0] * n_shards
        top = max(load for load, _ in heap)
        while left:
            if left >= n_shards and top - heap[0][0] <= size:
                rounds, left = divmod(left, n_shards)
                heap = [(load + rounds * size, s) for load, s in heap]
                heapq.heapify(heap)
                top += rounds * size
                got = [g + rounds for g in got]
                continue
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
            top = max(top, load + size)
            got[s] += 1
            left -= 1
        takers = [s for s in range(n_shards) if got[s]]
        ends, total = [], 0
        for s in takers:
            total += got[s]
            ends.append(total)
        out.append((size, takers, ends))
    return out


def assign_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """A shard and a slot in it for every row of ``docs`` (doc_id, text).

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot.  A null text
    counts as an empty one and shares its group.  Rows that repeat a doc_id are
    rows of their own.  Null doc_ids are dealt like any other.  An empty table
    gives an empty result; other columns are left aside.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    d = materialize(pick(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    ).withColumn("_part", bucket(SALTS, "doc_id")), "shard-docs")
    # A hot group is summed in sub-groups first and never meets in one task.
    parts = d.groupBy("key", "_part").agg(F.sum("size").alias("bytes"))
    groups = materialize(parts.groupBy("key").agg(F.sum("bytes").alias("bytes")), "shard-groups")
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    plan = spark.createDataFrame(schedule(sizes, n_shards), "bytes long, takers array<int>, ends array<long>")
    numbered = ranked(groups, ["bytes"], ["key"], "rank")
    dealt = attach(numbered, plan, ["bytes"], ["key"])
    nth = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    shards = dealt.select("key", F.element_at("takers", nth + 1).alias("shard"))
    pairs = d.select("key", "_part").distinct().join(shards, "key")
    placed = d.join(pairs, ["key", "_part"]).select("doc_id", "size", "text_crc32", "shard", "key")
    return ranked(placed, ["shard"], ["doc_id", "key"], "slot").drop("key")


def op1_sharding(docs: DataFrame) -> DataFrame:
    """Every row of ``documents`` in one of 24 shards, equal texts together (null and empty texts are groups too)."""
    return assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))
