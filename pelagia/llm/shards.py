"""Longest-processing-time scheduling of document groups onto shards.

Equal texts form a group that stays together. Groups go, largest first, each to
the least-loaded shard, through a heap. The schedule only needs to know how many
groups of each total size there are: the distinct totals of a corpus of B bytes
number under sqrt(2 B), as they are distinct whole numbers that add up to B at
most (14 million at 100 TB), so two arrays of them fit the driver, and groups of
one size are interchangeable. The plan itself is written band by band, ``BAND``
sizes at a time. Within a size the heap takes runs of equal groups at
once, and whole rounds over all shards once the loads differ by less than one group.

What is done per document or per group is DataFrame operations: a hash of each
text, a sum per group, and ranks within (size, bucket) plus offsets, so no task
holds all groups of a common size, all copies of a text or all of a shard.

Defined cases: null is the empty text, and both form one group; repeated rows
and repeated or null ids keep a row and a slot each; an empty table gives an
empty table; other columns are ignored. With fewer groups than shards the last
shards stay empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import new_path, whole, written

SHARDS = 8
#: Rows that a ranking task sees, about.
BUCKET = 10_000


PLAN = "total long, upto array<long>"
#: Sizes in a band of the plan.
BAND = 1 << 18


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int, heap: list[tuple[int, int]] | None = None) -> np.ndarray:
    """(classes, shards): how many of each size class, given largest first, each shard gets. ``heap``: the shards'
    loads, which the next band goes on with."""
    heap = [(0, j) for j in range(shards)] if heap is None else heap
    out = np.zeros((len(sizes), shards), np.int64)
    for row, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        got = out[row]
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] < size:
                # each shard gets one before any gets two, whole rounds long
                rounds = left // shards
                got += rounds
                heap[:] = [(load + rounds * size, j) for load, j in heap]
                left -= rounds * shards
                continue
            load, j = heap[0]
            # it stays the least-loaded (ties: the lowest number) for n groups
            second, k = min(heap[1:], default=(load + size * left, j))
            rounds, rest = divmod(second - load, size)
            n = min(left, rounds + (rest > 0 or j < k))
            got[j] += n
            left -= n
            heapq.heapreplace(heap, (load + n * size, j))
    return out


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bucket: int = BUCKET, band: int = BAND) -> DataFrame:
    """Per row: id, size (UTF-8 bytes + 1), text_crc32, law ("bytes"), shard, slot (gapless from 0 in each
    shard), grown_shard (null: this law moves any document when the number of shards changes)."""
    spark = docs.sparkSession
    text = whole(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("crc"),
            F.unhex(F.md5(text)).alias("key"),
        ),
        "rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("total")), "groups")
    classes = groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("total")).toArrow()
    if not classes.num_rows:
        return rows.select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    totals, counts, heap, path = classes["total"].to_numpy(), classes["n"].to_numpy(), [(0, j) for j in range(shards)], new_path(spark, "plan")
    for at in range(0, len(totals), band):
        some = totals[at : at + band]
        upto = np.cumsum(schedule(some, counts[at : at + band], shards, heap), axis=1)
        ends = pa.ListArray.from_arrays(np.arange(0, upto.size + 1, shards, dtype=np.int32), upto.ravel())
        spark.createDataFrame(pa.table({"total": some, "upto": ends}), PLAN).write.mode("append").parquet(path)
    plan = spark.read.schema(PLAN).parquet(path)

    def ranked(df: DataFrame, of: str, buckets: int, by: list) -> DataFrame:
        """df with "rank": its rows' numbers from 0 within each value of ``of``."""
        cut = df.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
        ahead = cut.groupBy(of, "bucket").agg(F.count(F.lit(1)).alias("n"))
        ahead = ahead.select(of, "bucket", (F.sum("n").over(Window.partitionBy(of).orderBy("bucket")) - F.col("n")).alias("ahead"))
        inside = cut.withColumn("at", F.row_number().over(Window.partitionBy(of, "bucket").orderBy(*by)) - 1)
        return inside.join(ahead, [of, "bucket"]).withColumn("rank", F.col("ahead") + F.col("at")).drop("ahead", "at", "bucket")

    n_groups, n_rows = int(counts.sum()), rows.count()
    placed = ranked(groups, "total", -(-n_groups // bucket), ["key"]).join(plan, "total")
    placed = written(placed.select("key", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).cast("int").alias("shard")), "placed")
    dealt = written(rows.join(placed.hint("merge"), "key"), "dealt")
    slots = ranked(dealt, "shard", -(-n_rows // (bucket * shards)), ["id", "key"])
    return slots.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("rank").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
