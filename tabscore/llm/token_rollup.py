"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A batch of changes is a set of signed rows: an insert adds a document's count,
a delete takes it away, a revision does both (old version out, new one in).
A batch is summed to one row per group before it is published, once, under its
own number; a replayed batch finds its number there and counts once.  The
totals are the sums over all committed batches; a group left without
documents is not listed.

Each sum combines within every task, so a source with a third of all rows
costs one row per task.

Defined results: null and empty texts count 0 tokens and one document; null
sources and languages are groups of their own; repeated rows each count; texts
of any length are counted whole; an empty table gives empty totals; only the
four named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from tabscore.llm import bpe
from tabscore.llm.common import F, T, col, materialise
from tabscore.sources.publish import publish_folder

KEYS = ["source", "lang", "tokenizer"]
BATCH = T.StructType([T.StructField(k, T.StringType()) for k in KEYS]
                     + [T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])

Counter = Callable[[Column], Column]


def word_counter(between: str) -> Counter:
    """Counts the runs of text between matches of a pattern."""
    return lambda text: F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")).cast("long")


def bpe_counter(spark: SparkSession, path: str | None = None) -> Counter:
    """Counts the tokens of a byte-pair vocabulary, as ``bpe.encode`` makes them."""
    return lambda text: F.coalesce(F.call_function(
        "div", F.octet_length(bpe.encode_column(spark, path or bpe.default_path(), text)), F.lit(4)), F.lit(0)).cast("long")


#: Tokenizer versions that need no vocabulary: white-space words, and runs of letters and digits of any script.
VERSIONS: dict[str, Counter] = {"words-v1": word_counter("[ \\t\\r\\n]+"), "words-v2": word_counter(r"[^\p{L}\p{N}]+")}


def counted(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source",
            lang: str = "lang", counters: Mapping[str, Counter] = VERSIONS) -> DataFrame:
    """(doc_id, source, lang, counts by version) of every document, written once: later joins move no text."""
    counts = [count(col(text)).alias(version) for version, count in counters.items()]
    return materialise(docs.select(col(ident).alias("doc_id"), col(source).alias("source"), col(lang).alias("lang"),
                                   F.struct(*counts).alias("counts")), "token-counts")


def signed(rows: DataFrame, version: str, sign: int) -> DataFrame:
    """Change rows of counted documents under a tokenizer version: sign 1 inserts, -1 deletes."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"),
                       (F.col("counts")[version] * sign).alias("tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    return signed(rows, old, -1).unionByName(signed(rows, new, 1))


def commit(changes: DataFrame, path: str, batch: int) -> bool:
    """Publish a batch's group sums under its number; False, and nothing changes, if that number is committed.

    The sums are written aside and appear by one rename, whole or not at all:
    a job that dies on the way, or runs twice, leaves the totals right.
    """
    summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    written = os.path.join(path, "_claims", f"_claim-{uuid.uuid4().hex}")
    summed.write.parquet(written)
    return publish_folder(changes.sparkSession, written, os.path.join(path, f"batch={int(batch)}"))


def totals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(BATCH).parquet(path)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
        "docs <> 0 OR tokens <> 0")
