"""Sharding by longest-processing-time scheduling: groups that must stay together, by falling size, each to the least-loaded shard through a heap.

Rows of one group (here: equal texts) go to one shard. A group's size is the sum of its rows' sizes. To keep what the driver
schedules bounded, only groups of over 1/HEAVY of all bytes (so fewer than HEAVY of them, whatever the corpus) are scheduled one by
one; the others are bundled by a hash of their key into at most BUNDLES bundles, which are scheduled like groups, so their groups
stay together too. A group larger than a shard's fair share cannot stay whole while sizes stay near equal: with `split_over` its rows
are dealt over as many parts as that takes by their number, whatever their doc_ids, and its parts are scheduled as groups.

Defined cases: a null text has no bytes, its size is 1 and its checksum 0; all null texts are one group, all empty texts another;
repeated rows are rows of their own with slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ranked, written

HEAVY = 8_000
BUNDLES = 16_384


def schedule(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """LPT: the largest first, each to the least-loaded shard; ties by key and shard number."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        out[key] = k
        heapq.heappush(heap, (load + size, k))
    return out


def assign_shards(docs: DataFrame, shards: int = 8, split_over: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. split_over: the share of a shard's fair size from which a group is split."""
    spark = docs.sparkSession
    utf8 = F.encode(F.col("text"), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.length(utf8), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(utf8), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(utf8), F.lit("null")).alias("_group"),
    )
    # The number is written with the row, so it stays the same whatever is computed again.
    rows = written(rows.withColumn("_number", F.monotonically_increasing_id()))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = max(1, int(total / shards * split_over))
    groups = written(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    huge = {r[0]: math.ceil(r[1] / whole) for r in groups.where(F.col("_bytes") > whole).collect()}  # fewer than shards / split_over
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("string"))
    heavy = groups.where((F.col("_bytes") * HEAVY > F.lit(int(total))) & (F.col("_bytes") <= whole)).select("_group", F.lit(True).alias("_heavy"))
    light = groups.where(F.col("_bytes") * HEAVY <= F.lit(int(total))).groupBy(bundle.alias("k")).agg(F.sum("_bytes").alias("b"))
    part = F.lit(None).cast("string")
    for key, n in huge.items():
        part = F.when(F.col("_group") == key, F.concat(F.lit(f"{key}/"), F.pmod(F.xxhash64("_number"), F.lit(n)).cast("string"))).otherwise(part)
    sizes = [(r[1], r[0]) for r in groups.where((F.col("_bytes") * HEAVY > F.lit(int(total))) & (F.col("_bytes") <= whole)).select("_group", "_bytes").collect()]
    sizes += [(r[1], r[0]) for r in light.collect()]
    if huge:
        sizes += [(r[1], r[0]) for r in rows.where(F.col("_group").isin(list(huge))).groupBy(part.alias("k")).agg(F.sum("size")).collect()]
    plan = spark.createDataFrame(list(schedule(sizes, shards).items()), "_unit string, shard int")
    # The plan has at most HEAVY + BUNDLES + a few rows, and so have the heavy groups.
    unit = F.coalesce(part, F.when(F.col("_heavy"), F.col("_group")), bundle)
    placed = rows.join(F.broadcast(heavy), "_group", "left").withColumn("_unit", unit).join(F.broadcast(plan), "_unit")
    return ranked(placed.select("doc_id", "size", "text_crc32", "shard", "_group", "_number"), ["shard"], ["doc_id", "_group", "_number"], count, "slot").drop("_group", "_number").withColumn("slot", F.col("slot").cast("long"))
