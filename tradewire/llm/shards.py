"""Sharding by longest-processing-time scheduling: sorted by size, each group goes to the least-loaded shard of a heap.

Rows of equal texts are one group and stay together; every group is scheduled. Groups of one size are alike, so the driver
deals runs: (size, how many groups have it), the largest size first. Of a run it needs only how many groups each shard
takes. That is what the heap would give, group by group: the part of a run that certainly goes everywhere is counted in
one step, the rest goes through the heap. There are no more than sqrt(2 x total bytes) different sizes, 14 million for
100 TB, and no more runs.

Groups stand sorted by size in a stored table, so a group's number within its size is its place less that of the first
one. It is looked up in its run's counts: the runs are broadcast only up to `few` numbers, and joined otherwise. Verdicts
go back to the rows with hot texts apart. Slots come from counts by (shard, cell), summed in order, plus a row number
within the cell, where cells are dealt by the number of a stored row, so no task holds a whole shard or a hot text. All
on the JVM.

Defined results: the size of a null text is 16; null texts are one group, apart from empty ones; equal rows get slots of
their own; a null id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewire.llm.common import documents, dropped, hot_join, partitions, stored

SHARDS = 40
OVERHEAD = 16
#: Numbers in a broadcast table of runs.
FEW = 4_000_000


def run_counts(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size go to each shard, each item to the least loaded (ties to the lower shard)."""
    taken = [0] * len(loads)
    if count > len(loads):
        # With a water line all items go to shards whose load before is under it: the highest line that needs no more items.
        low, high = min(loads), max(loads) + size * count
        need = lambda line: [max(0, -(-(line - x) // size)) for x in loads]
        while low < high:
            line = (low + high + 1) // 2
            low, high = (line, high) if sum(need(line)) <= count else (low, line - 1)
        taken = need(low)
    heap = [(x + size * n, k) for k, (x, n) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, k = heap[0]
        taken[k] += 1
        heapq.heapreplace(heap, (load + size, k))
    return taken


def schedule(runs: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For runs of (size, count), the largest size first: running counts by shard, 0 first."""
    loads, out = [0] * shards, []
    for size, count in runs:
        ends = [0]
        for k, n in enumerate(run_counts(loads, size, count)):
            loads[k] += size * n
            ends.append(ends[-1] + n)
        out.append(ends)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    parts = partitions(docs, text_col=text_col)
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"), F.monotonically_increasing_id().alias("row"),
    ))
    by_text = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # Sorted by size; the number of a stored row has its partition above bit 33 and its place there below.
    groups = stored(by_text.repartitionByRange(parts, F.desc("bytes"), "g1", "g2").sortWithinPartitions(F.desc("bytes"), "g1", "g2").withColumn("at", F.monotonically_increasing_id()))
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).collect()  # under sqrt(2 x total bytes) rows
    runs = [(r["bytes"], r["n"]) for r in sizes]
    ends = schedule(runs, shards)
    starts = [0]
    for _, n in runs:
        starts.append(starts[-1] + n)
    dealt = spark.createDataFrame([(b, s, e) for (b, _), s, e in zip(runs, starts, ends, strict=False)], "bytes long, start long, ends array<long>")
    dealt = F.broadcast(dealt) if len(runs) * (shards + 3) <= few else dealt
    part = F.shiftright("at", 33)
    before = groups.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m"))  # a row for each partition
    before = F.broadcast(before.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before")))
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("start")
    placed = groups.withColumn("part", part).join(before, "part").join(dealt, "bytes").withColumn("number", number)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("number"))) - 1
    total = rows.count()
    known = hot_join(rows, placed.select("g1", "g2", shard.alias("shard")), ["g1", "g2"], groups.select("g1", "g2", "n"), total)
    # Cells cut a shard for numbering.
    known = stored(known.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(parts))))
    counts = known.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1
    for t in (rows, groups):
        dropped(t)
    return known.withColumn("place", place).join(first, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
