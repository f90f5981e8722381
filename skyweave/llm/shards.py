"""Sharding by minimax contiguous partition.

Equal texts form an atomic group; groups stand in the order of a hash of the text. The groups are cut into
contiguous shards such that the largest shard is as small as any such cut can make it. The smallest feasible
capacity is found by binary search with a greedy check on cumulative sizes. The driver holds only the group
ends near possible cuts: a coarse set of ends brackets the capacity, which narrows where ends are fetched next.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, save, table

LAW = "bytes"


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut positions (cumulative sizes) of the greedy contiguous partition at these group ends, or None if over `shards` are needed."""
    cuts, at = [], 0
    while at < ends[-1]:
        k = bisect_right(ends, at + capacity) - 1
        if k < 0 or ends[k] <= at or len(cuts) == shards:
            return None
        at = ends[k]
        cuts.append(at)
    return cuts


def smallest_capacity(ends: list[int], shards: int, low: int, high: int) -> int:
    """The smallest capacity in [low, high] that is feasible at these ends; high must be."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, shards) else (mid + 1, high)
    return low


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts at these ends with no shard above the capacity, each as near as that allows to an even share of what is left.

    latest[m] is the least position from which m shards still reach the end, by a greedy run backwards.
    """
    total, starts = ends[-1], [0, *ends]
    latest = [total]
    for _ in range(shards):
        latest.append(starts[bisect_left(starts, latest[-1] - capacity)] if latest[-1] > capacity else 0)
    cuts, at = [], 0
    for m in range(shards, 0, -1):
        if at == total:
            break
        lo, hi = max(bisect_left(ends, latest[m - 1]), bisect_right(ends, at)), bisect_right(ends, at + capacity)
        k = bisect_left(ends, at + (total - at) / m, lo, hi)
        near = [i for i in (k - 1, k) if lo <= i < hi]
        at = ends[min(near, key=lambda i: abs(ends[i] - at - (total - at) / m))]
        cuts.append(at)
    return cuts


def minimax_cuts(fetch, total: int, largest: int, shards: int, resolution: int = 1 << 14) -> list[int]:
    """The cut positions of the minimax contiguous partition of groups that are known through fetch(lo, hi, width).

    fetch returns, for the group ends in (lo, hi], the greatest end of each interval of `width` (1: all of them), and `total` is the
    last end. Known ends only ever give too high a capacity, so C* is at most the capacity `high` found with them; it is at least
    `low`. The k-th cut of a greedy run with a capacity in [low, high] lies in (k * (low - largest), k * high], or, better, between
    the run of `low` that stops at the end before each step's reach and k * high: ends are fetched there, at a width that bounds
    their number, until all of them are known.
    """
    if not total:
        return []
    low = max(-(-total // shards), largest)
    width = max(1, total // resolution)
    known = {total, *fetch(0, total, width)}
    while True:
        ends = sorted(known)
        # Greedy with this capacity succeeds at any known set of ends: every step reaches at least the last known end.
        high = max(low, max(b - a for a, b in zip([0, *ends], ends)) + low)
        high = smallest_capacity(ends, shards, low, high) if greedy(ends, high, shards) else total
        if width == 1 or high == low:
            return even_cuts(ends, high, shards)
        zones, slow = [], 0
        for k in range(1, shards + 1):
            # No greedy run with at least `low` falls behind this one, which takes each step to the last known end in reach.
            slow = ends[j] if (j := bisect_right(ends, slow + low) - 1) >= 0 and ends[j] > slow else slow
            zones.append((slow, min(total, k * high)))
        merged: list[list[int]] = []
        for a, b in sorted(z for z in zones if z[0] < z[1]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        width = max(1, min(width // 16, sum(b - a for a, b in merged) // resolution))
        for a, b in merged:
            known |= set(fetch(a, b, width))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row a document: doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, shard, slot (its place in the shard, from 0).

    Law `bytes`: sizes are as near equal as contiguous cuts between groups of equal texts allow, which keeps such a group whole; a
    group above the mean has a shard as large as itself at least. Null and empty texts are one group. Repeated doc_ids: each row
    has a slot. Empty table: no rows. Equal texts are told by two 64-bit hashes of different seeds. Rows are moved once, by ranges of (hash, doc_id), without their texts, so a large group is
    spread over tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))
    rows, _ = save(rows)
    order = ["h", "g", "doc_id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, sizes = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if not len(b):
                continue
            upto = np.cumsum(b.column("size").to_numpy()) + sizes
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(np.arange(row, row + len(b))), pa.array(upto)], names=[*b.schema.names, "part", "row", "upto"])
            row, sizes = row + len(b), int(upto[-1])

    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, "doc_id bigint, size bigint, text_crc32 bigint, h bigint, g bigint, part int, row bigint, upto bigint")
    placed, _ = save(placed)
    # One row for each task that wrote: where its rows and sizes begin.
    parts = sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect())
    first_row = dict(zip([r.part for r in parts], accumulate([r.n for r in parts], initial=0)))
    first_size = dict(zip([r.part for r in parts], accumulate([r.s for r in parts], initial=0)))
    total = sum(r.s for r in parts)
    offset = lambda of: _lookup(of, F.col("part"))
    placed = placed.withColumn("row", F.col("row") + offset(first_row)).withColumn("upto", F.col("upto") + offset(first_size))
    groups, _ = save(placed.groupBy("h", "g").agg(F.max("upto").alias("upto"), F.sum("size").alias("size")).select("upto", "size"))
    largest = groups.agg(F.max("size")).first()[0] or 0

    def fetch(lo: int, hi: int, width: int) -> list[int]:
        near = groups.where((F.col("upto") > lo) & (F.col("upto") <= hi)).select("upto")
        if width > 1:
            near = near.groupBy(F.floor((F.col("upto") - 1) / F.lit(width))).agg(F.max("upto").alias("upto"))
        return [r.upto for r in near.select("upto").collect()]

    cuts = minimax_cuts(fetch, total, largest, shards)
    # The shard of a row is the number of cuts before it; its slot counts from the first row after the cut.
    shard_of = F.lit(0)
    for c in cuts[:-1]:
        shard_of = shard_of + (F.col("upto") > c).cast("int")
    out = placed.withColumn("shard", shard_of.cast("int"))
    begins = {r.shard: r.row for r in out.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    return out.withColumn("slot", F.col("row") - _lookup(begins, F.col("shard"))).select("doc_id", "size", "text_crc32", "shard", "slot")


def _lookup(of: dict[int, int], key: Column) -> Column:
    """A small map as an expression."""
    if not of:
        return F.lit(0).cast("long")
    base = min(of)
    return F.element_at(F.array(*[F.lit(of.get(i, 0)).cast("long") for i in range(base, max(of) + 1)]), (key - base + 1).cast("int"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
