"""From raw documents to token ids in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents.  Every stage's result is written as
Parquet and read again, so a lost executor or a failed stage costs that stage
only.  The first four return the columns of ``documents``; the last returns
each document's token ids.

1. ``quality``: documents the quality classifier rejects go.
2. ``exact_dedup``: of equal texts the row with the largest id stays.
3. ``near_dedup``: one document of each class of near copies stays.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``encode``: doc_id, lang, source, n_tokens, token_ids and decoded_ok
   (decoding the ids gives the text back).

Null and empty texts pass through every stage as empty texts; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tabscore.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_class(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), any_case=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", "n_tokens", "token_ids",
                       (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("decoded_ok"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: No twin: the classifier's fit, the similarity join and the tokenizer are beyond SQL; tests compare them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
