"""Sharding: two-pass external shuffle into equal shards.

Pass one scatters whole records into memory-sized buckets by a seeded hash of
each row's place in its file, so neither a hot id nor a hot text can fill one
bucket.  Pass two gives every bucket a Fisher-Yates permutation of its slots
(Spark's ``shuffle`` of the slot numbers), places each record by it and writes
the records.  The buckets laid end to end are one shuffled order of the whole
table, cut into shards whose row counts differ by at most one.

All work is DataFrame operations: records are never gathered in arrays (only
a bucket's slot numbers are), so a bucket costs its sort buffers and four bytes
a row.  The permutations are written before use, so a retried task places the
records exactly as the lost one did.

Defined results: a null text counts 0 bytes; equal rows and repeated ids are
separate records; an empty table gives an empty result; texts of any length
are written whole; every input column is written as it came, whatever its
name, and a new column whose name is taken gets underscores appended.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tabscore.llm.common import F, Window, col, free_name, located, materialise
from tabscore.session import scratch_path

RECORD_BYTES = 16
BUCKET_BYTES = 32 * 1024 * 1024


def buckets_for(n_bytes: int, shards: int, bucket_bytes: int) -> int:
    """At least one bucket per shard, and as many more as keep a bucket near ``bucket_bytes``."""
    return max(shards, math.ceil(n_bytes / bucket_bytes))


#: Buckets whose sizes are summed together on the way to the running total.
GROUP = 1024


def permutations(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, start, perm): where the bucket begins in the shuffled order, and its shuffled slots.

    One narrow count per bucket (no text is read).  The running total has two
    levels: over groups of ``GROUP`` buckets, then within each group.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.withColumn("grp", F.call_function("div", F.col("bucket"), F.lit(GROUP))), "shard-sizes")
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("grp").agg(F.sum("n").alias("n")).select(
        "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("grp", "bucket", "n", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start"))
    starts = starts.join(groups, "grp").select("bucket", "n", (F.col("base") + F.col("start")).alias("start"))
    spread = starts.repartition(max(1, math.ceil(buckets / 4)), "bucket")
    slots = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    return materialise(spread.select("bucket", "start", F.shuffle(slots, F.lit(seed)).alias("perm")), "shard-perms")


def shuffle_into_shards(docs: DataFrame, shards: int = 40, text: str = "text", seed: int = 17,
                        bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> tuple[DataFrame, str, str]:
    """Write ``docs`` shuffled into ``shards``; returns the written table and its shard and slot column names.

    The table is partitioned by shard; within a shard, slots run from 0
    without gaps and each file is sorted by slot.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    shard, slot = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    path = path or scratch_path(spark, "shards")
    size = F.octet_length(F.coalesce(col(text), F.lit(""))).cast("long") + RECORD_BYTES
    # a record travels as one value, so that no column of it can meet one of the shuffle's own
    rows = located(docs, [F.struct(*[col(c).alias(c) for c in docs.columns]).alias("record"), size.alias("size")],
                   "shard-docs")
    n, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = buckets_for(n_bytes, shards, bucket_bytes)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("file"), F.col("pos")), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    perms = permutations(rows, buckets, seed)

    # a partition is one bucket: a task sorts a bucket of bounded size, however large the table
    scattered = rows.select("record", "file", "pos", "bucket").repartitionById(buckets, "bucket")
    place = Window.partitionBy("bucket").orderBy("file", "pos")
    numbered = scattered.select("record", "bucket", F.row_number().over(place).alias("rn"))
    placed = numbered.join(perms.repartitionById(buckets, "bucket"), "bucket").select(
        "record", (F.col("start") + F.get("perm", F.col("rn") - 1)).alias("position"))
    total = F.lit(max(n, 1))
    placed = placed.withColumn("shard", F.call_function("div", F.col("position") * F.lit(shards), total))
    first = F.call_function("div", F.col("shard") * total + F.lit(shards - 1), F.lit(shards))
    out = placed.select(*[F.col("record").getField(c).alias(c) for c in docs.columns],
                        F.col("shard").cast("int").alias(shard), (F.col("position") - first).alias(slot))
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    schema = out.schema
    return spark.read.schema(schema).parquet(path), shard, slot
