"""Quality rules with cross-document line frequency.

Method: one pass over the whole texts measures each document (words, symbols,
repeated lines, words in repeated windows) and hashes its normalised lines.
A line's frequency on a host is the number of *different texts* of the host
that hold it (copies of one text count once: dropping copies is the business
of a dedup, and a page is not boilerplate for having been crawled often).
Lines above the host's limit are removed wherever they occur on the host, and
a document is rejected when the base rules fail it or when it is depleted:
what is left has too few words, or too small a share of them.

The limit is ``MAX_SHARE`` of the host's different texts, and never under
``MIN_TEXTS``: it grows with the host, so a larger crawl of the same sites is
judged like a smaller one.

Plan.  The measuring pass is Arrow batches in, a narrow row a document out
(counts, the line hashes and the lines' word counts), written once.  Copies
collapse in their task before their lines are spread out; lines are counted
with partial sums, so a line that a third of all documents hold sends one row
a task.  The lines above the limits are few (each stands for many texts) and
are broadcast while they measure below the bound, else joined by shuffle,
where Spark splits a hot line's partition.  Nothing but counts reaches the
driver.

Normalised line: A-Z lower-cased, runs of digits as ``0``, words joined by one
space.  Lines are compared by a 64-bit hash within a host.

Defined results: words are runs of anything but the six ASCII white-space
characters; null texts have no words and fail the base rules, as do empty
ones; a null host is a host of its own; repeated rows are measured one by one
and count as one text; texts of any length are taken whole; an empty table
gives an empty result; columns beyond the three named ones are not read by
``judged`` and are returned as they came by ``cleaned``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tabscore.llm.common import F, T, col, free_name, located, materialise, python_workers, small

#: Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

#: A line is removed when more than this share of its host's texts hold it, and more than MIN_TEXTS of them.
MAX_SHARE, MIN_TEXTS = 0.001, 10
#: A document is depleted when fewer words are left than MIN_WORDS, or less than this share of its words.
MIN_LEFT_SHARE = 0.5
#: Bytes of one (host, line) in a broadcast table, for the size check.
LINE_BYTES = 96


def _schema(doc_id: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    fields = [("file", long), ("pos", long), ("doc_id", doc_id), ("host", text), ("text_hash", long), ("n_words", long),
              ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long),
              ("lines", T.ArrayType(long)), ("line_words", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` (a power of two) words that occur twice or more.

    Exact, by doubling: windows are numbered from the numbers of their two
    halves.  Where no window of some length repeats, no longer one can.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) == n:
        return 0
    length = 1
    while length < window:
        key = ids[:-length] * (int(ids.max()) + 1) + ids[length:]
        ids, distinct = pd.factorize(key)
        if len(distinct) == len(ids):
            return 0
        length *= 2
    starts = np.bincount(ids)[ids] > 1
    covered = np.zeros(n + 1, dtype=np.int64)
    covered[:len(starts)] += starts
    covered[window:window + len(starts)] -= starts
    return int(np.count_nonzero(np.cumsum(covered[:n])))


_DIGITS = re.compile(rb"[0-9]+")


def line_key(words: list[bytes]) -> int:
    """64-bit hash of the normalised line that has these words."""
    line = _DIGITS.sub(b"0", b" ".join(words).lower())
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def measure_text(text: bytes) -> tuple[int, int, int, int, int, list[int | None], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words per line) of a UTF-8 text.

    A line without words has no hash.
    """
    words = text.split()
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    word_chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    keys, counts, seen, dup = [], [], set(), 0
    for line in text.split(b"\n"):
        own = line.split()
        counts.append(len(own))
        keys.append(line_key(own) if own else None)
        if own:
            dup += line in seen
            seen.add(line)
    return len(words), word_chars, n_symbols, dup, repeated_words(words), keys, counts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = [measure_text(t.as_py() or b"") for t in texts]
        columns = list(zip(*found)) if found else [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in range(5)] + [pa.array(c, type=k) for c, k in zip(columns, kinds)],
            names=_schema(T.LongType()).names)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One narrow row per row of ``docs``: its place, id, host, base counts and line hashes; written."""
    python_workers(docs.sparkSession)
    body = col(text).cast("string")
    rows = located(docs, [col(doc_id).alias("doc_id"), col(host).cast("string").alias("host"),
                          F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_hash"), body.alias("text")], "line-docs")
    out = rows.select("file", "pos", "doc_id", "host", "text_hash", "text").mapInArrow(
        _measure, _schema(rows.schema["doc_id"].dataType))
    return materialise(out, "line-measured")


def frequent_lines(rows: DataFrame, max_share: float = MAX_SHARE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(host, line, texts): the lines that too many different texts of a host hold; ``rows`` from ``measured``."""
    texts = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    texts = materialise(texts.select("host", F.array_distinct("lines").alias("lines")), "line-texts")
    limits = texts.groupBy("host").agg(
        F.greatest(F.lit(min_texts), F.floor(F.count("*") * F.lit(max_share))).alias("limit"))
    count = (texts.select("host", F.explode("lines").alias("line")).where("line IS NOT NULL").groupBy("host", "line")
             .agg(F.count("*").alias("texts")).where(F.col("texts") > min_texts))
    limits, _ = small(materialise(limits.withColumnRenamed("host", "limit_host"), "line-limits"), LINE_BYTES)
    return count.join(limits, F.col("host").eqNullSafe(F.col("limit_host")) & (F.col("texts") > F.col("limit"))).select(
        "host", "line", "texts")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           max_share: float = MAX_SHARE, min_texts: int = MIN_TEXTS,
           min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """One row per document: its place, id, base counts, words left, its removed lines (numbered from 0), verdicts."""
    rows = measured(docs, doc_id, text, host)
    often, _ = small(materialise(frequent_lines(rows, max_share, min_texts), "line-frequent"), LINE_BYTES)
    often = often.select(F.col("host").alias("often_host"), F.col("line").alias("often_line"))
    spread = rows.select("file", "pos", "host", "line_words", F.posexplode("lines").alias("at", "line"))
    hits = spread.select("file", "pos", "host", "at", "line", F.get("line_words", F.col("at")).alias("n")).join(
        often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("line") == F.col("often_line")))
    lost = hits.groupBy("file", "pos").agg(F.sum("n").cast("long").alias("words_removed"),
                                           F.sort_array(F.collect_list("at")).alias("removed"))
    out = rows.drop("lines", "line_words", "text_hash").join(lost, ["file", "pos"], "left")
    left = F.col("n_words") - F.coalesce("words_removed", F.lit(0))
    out = out.withColumns({"words_left": left, "removed": F.coalesce("removed", F.array().cast("array<int>"))})
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    depleted = (F.col("words_left") < MIN_WORDS) | (F.col("words_left") < min_left_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("words_removed")


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` without rejected rows, and without the removed lines in the texts that stay."""
    if text not in docs.columns:
        raise ValueError(f"no column {text!r}")
    taken = list(docs.columns)
    names = {}
    for name in ("file", "pos", "removed"):
        names[name] = free_name(taken, f"_{name}")
        taken.append(names[name])
    rows = located(docs, [col(c) for c in docs.columns], "line-docs", names["file"], names["pos"])
    found = materialise(judged(docs, doc_id, text, host, **limits).where("kept").select(
        F.col("file").alias("f"), F.col("pos").alias("p"), F.col("removed").alias(names["removed"])), "line-kept")
    rows = rows.join(found, (col(names["file"]) == F.col("f")) & (col(names["pos"]) == F.col("p")))

    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(r) else _without_lines(t, set(r)) for t, r in zip(texts, removed)],
                         dtype=object)

    left = F.pandas_udf(without, "string")(col(text), col(names["removed"]))
    return rows.select([left.alias(c) if c == text else col(c) for c in docs.columns])


def _without_lines(text: str, removed: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in removed)
