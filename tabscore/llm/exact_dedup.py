"""Exact dedup: stateful streaming deduplication on disk-backed keyed state that never expires.

Documents arrive as a feed (one narrow row each: stable identifier, digest of
the normalised text, locator of the full text).  A Structured Streaming query
keeps, per digest, the identifier and locator of the row that stays and the
group's size, in a RocksDB state store without watermark.  A digest met more
than once is a hit; for hits the full texts are read again and compared byte
for byte, so a digest collision never merges two texts.

All work is DataFrame operations.  The stream's aggregation combines within
each task first, so a text held by a third of all rows costs one state update
per task.

Defined results: null text counts as empty; texts are equal when identical
after lower-casing A-Z; the largest id stays, a null id ranks lowest, and of
rows repeating one id the one stored last (by locator) stays, so exactly one
row of each group is kept.  An empty table gives an empty result.  Ids are
integers (or cast to them).  Columns beyond id and text are not read by
``dedup`` and are returned as they came by ``keep_first_class``, whatever their
names; texts of any length are taken whole.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tabscore.llm.common import (BROADCAST_BYTES, F, T, col, is_file_scan, located, materialise, small, without_rows)
from tabscore.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWEST = -(2**63)

FEED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("file", T.LongType()),
    T.StructField("pos", T.LongType()),
])

#: The state lives in RocksDB on the executors' disks, its snapshots and change logs in the checkpoint folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # stores of an ended query are closed soon, before later work needs their memory
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    # many small stores: no disk space set aside in advance for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is empty.  Pure ASCII texts take the fast path of ``lower``."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, ASCII_UPPER, ASCII_UPPER.lower()))


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the start of a query, put back afterwards (a started query keeps its own copy)."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ingest(docs: DataFrame, feed: str, ident: str = "doc_id", text: str = "text",
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Append one feed row per document; returns the normalised texts with locators (for later reads of full texts)."""
    body = normalised(col(text))
    rows = located(docs, [col(ident).cast("long").alias("doc_id"), body.alias("body")], "dedup-docs")
    rows.select("doc_id", digest(F.col("body")).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"),
                "file", "pos").write.mode("append").parquet(feed)
    return rows


def run_state(spark: SparkSession, feed: str, work: str, max_files: int | None = None) -> None:
    """Bring the keyed state up to date with everything in ``feed`` and append the changed keys to ``work``.

    Calling it again after more files were ingested continues from the
    checkpoint.  A batch's changes are written under its own number, so a
    replayed batch overwrites itself.
    """
    reader = spark.readStream.schema(FEED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    best = F.struct(F.coalesce("doc_id", F.lit(LOWEST)).alias("rank"), F.col("file"), F.col("pos"))
    state = reader.parquet(feed).groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(work, "changes", f"batch={batch_id}"))

    with settings(spark, STATE_CONF):
        query = (state.writeStream.outputMode("update").foreachBatch(save).trigger(availableNow=True)
                 .option("checkpointLocation", os.path.join(work, "checkpoint")).start())
    query.awaitTermination()


CHANGES = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("best", T.StructType([T.StructField("rank", T.LongType()), T.StructField("file", T.LongType()),
                                        T.StructField("pos", T.LongType())])),
    T.StructField("n", T.LongType()),
    T.StructField("batch", T.LongType()),
])


def current_state(spark: SparkSession, work: str) -> DataFrame:
    """The newest (digest, best, n) of every key."""
    changes = spark.read.schema(CHANGES).parquet(os.path.join(work, "changes"))
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "best", "n")).alias("s"))
    return last.select("digest", F.col("s.best").alias("best"), F.col("s.n").alias("n"))


def bodies(rows: DataFrame, digests: DataFrame, digest: Callable[[Column], Column],
           limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row whose digest is in ``digests``, with its whole normalised text."""
    side, _ = small(digests, 64, limit)
    return rows.select(digest(F.col("body")).alias("digest"), "body", "file", "pos").join(side, "digest", "left_semi")


def collisions(rows: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of ``hits`` shared by different texts.

    The group-by key holds the full text: rows fall together only when every
    byte agrees.  Copies meet within each task before the shuffle.
    """
    full = bodies(rows, hits.select("digest"), digest).groupBy("digest", "body").agg(F.count("*").alias("c"))
    return full.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text",
          digest: Callable[[Column], Column] = sha256, max_files: int | None = None
          ) -> tuple[DataFrame, DataFrame]:
    """Deduplicate ``docs``: (rows, verdicts).

    ``rows`` has the normalised texts with locators; ``verdicts`` has one row per document:
    doc_id, keep_id, group_size, kept, digest, file, pos.
    """
    spark = docs.sparkSession
    work = scratch_path(spark, "dedup")
    feed = os.path.join(work, "feed")
    rows = ingest(docs, feed, ident, text, digest)
    run_state(spark, feed, work, max_files)
    return rows, verdicts(spark, rows, feed, work, digest)


def verdicts(spark: SparkSession, rows: DataFrame, feed: str, work: str,
             digest: Callable[[Column], Column] = sha256) -> DataFrame:
    fed = spark.read.schema(FEED).parquet(feed)
    if fed.isEmpty():
        hits = spark.createDataFrame([], CHANGES).select("digest", "best", "n")
    else:
        hits = materialise(current_state(spark, work).where("n > 1"), "dedup-hits")
    clash = materialise(collisions(rows, hits, digest), "dedup-collisions")
    collided = not clash.isEmpty()
    whole = hits.join(clash, "digest", "left_anti") if collided else hits
    plain = fed.join(clash, "digest", "left_anti") if collided else fed
    out = plain.join(whole, "digest", "left").select(
        "doc_id", F.col("best"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "digest", "file", "pos")
    if collided:
        # the digest alone does not tell these texts apart: group them by their bytes
        full = bodies(rows, clash, digest).join(fed.select("file", "pos", "doc_id"), ["file", "pos"])
        best = F.struct(F.coalesce("doc_id", F.lit(LOWEST)).alias("rank"), F.col("file"), F.col("pos"))
        groups = full.groupBy("digest", "body").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
        out = out.unionByName(full.join(groups, ["digest", "body"]).select(
            "doc_id", "best", "group_size", "digest", "file", "pos"))
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("best.rank"), F.lit(LOWEST)))
    stays = F.col("best").isNull() | ((F.col("best.file") == F.col("file")) & (F.col("best.pos") == F.col("pos")))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", stays.alias("kept"),
                      F.lower(F.hex("digest")).alias("digest"), "file", "pos")


def keep_first_class(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (the pipeline's stage)."""
    if not is_file_scan(docs):
        docs = materialise(docs, "dedup-docs")    # once, so that both sides see the same files
    _, found = dedup(docs, ident, text)
    return without_rows(docs, materialise(found.where(~F.col("kept")).select("file", "pos"), "dedup-dropped"), "dedup-docs")
