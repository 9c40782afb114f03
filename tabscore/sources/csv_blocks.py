"""CSV files with quoted line breaks, read by many tasks.

Spark's ``multiLine`` reader gives a whole file to one task, since the start
of a record cannot be told from the middle of a file.  It can with one number
a block: a line break is inside a quoted field exactly when an odd number of
quotes precedes it in the file.  So

1. a narrow pass counts the quotes of each block of each file; the sum over
   the blocks before it (one row a block) says whether a block begins inside
   a field;
2. a second pass cuts every block into records from its true first record.
   What a record has in other blocks leaves as fragments, at most two a block,
   which are put together by file and order;
3. the records, as strings, are parsed by Spark's own ``from_csv``.

Blocks are the splits of Spark's text source, so ``spark.sql.files.maxPartitionBytes``
sets the parallelism within a file.  The rows are those of the ``multiLine``
reader for files whose fields double the quotes inside them (RFC 4180), in
UTF-8, with ``\\n`` or ``\\r\\n`` between records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.session import ship_package

WHOLE, HEAD, MIDDLE, TAIL = range(4)
PIECES = "file string, start long, kind int, text string"


class _Cutter:
    """Cuts the lines of one block, as they come, into whole records and the fragments at its ends."""

    def __init__(self, file: str, start: int, inside: bool, header: bool):
        self.file, self.start, self.odd = file, start, inside
        self.open: list[str] = []
        self.head = inside                       # the lines so far belong to a record of an earlier block
        self.skip = header and start == 0
        self.out: list[tuple] = []

    def add(self, lines: pa.Array) -> Iterator[pa.Array]:
        """Yields arrays of whole records that are lines of the file; others are in ``out``."""
        quotes = np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))
        odd = (quotes + self.odd) % 2 == 1       # after each line
        before = np.concatenate([[self.odd], odd[:-1]])
        alone = ~odd & ~before
        at = 0
        for k in np.flatnonzero(~alone).tolist() + [len(lines)]:
            if k > at:
                yield self._lines(lines.slice(at, k - at))
            if k == len(lines):
                break
            self.open.append(lines[k].as_py())
            if not odd[k]:
                self._close()
            at = k + 1
        self.odd = bool(odd[-1])

    def _lines(self, lines: pa.Array) -> pa.Array:
        if self.skip:
            self.skip, lines = False, lines.slice(1)
        return lines

    def _close(self) -> None:
        text, self.open = "\n".join(self.open), []
        if self.head:
            self.out.append((self.file, self.start, HEAD, text))
        elif self.skip:
            self.skip = False
        else:
            self.out.append((self.file, self.start, WHOLE, text))
        self.head = False

    def end(self) -> None:
        if self.open:
            self.out.append((self.file, self.start, MIDDLE if self.head else TAIL, "\n".join(self.open)))


def _pieces(header: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "start", "kind", "text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            file, start = batch.column("file"), batch.column("start").to_numpy()
            # rows of a block stand together, in the order of the file
            code = file.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                now = (file[lo].as_py(), int(start[lo]))
                if now != key:
                    if block is not None:
                        block.end()
                        if block.out:
                            yield batch_of(block.out)
                    block, key = _Cutter(*now, bool(batch.column("inside")[lo].as_py()), header), now
                for lines in block.add(batch.column("value").slice(lo, hi - lo)):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
                                                      pa.array(np.full(n, WHOLE, dtype=np.int32)), lines], ["file", "start", "kind", "text"])
                if block.out:
                    yield batch_of(block.out)
                    block.out = []
        if block is not None:
            block.end()
            if block.out:
                yield batch_of(block.out)

    return run


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(text): every record of the files below ``path`` as one string, without headers and blank lines."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(F.col("file").alias("b_file"), F.col("start").alias("b_start"),
                           (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # one row a block, joined where the lines are: a shuffle would lose their order
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the files were split otherwise in the second pass"))
                   ).otherwise(F.col("inside"))
    placed = lines.join(F.broadcast(blocks), (F.col("file") == F.col("b_file")) & (F.col("start") == F.col("b_start")), "left")
    pieces = placed.select("file", "start", known.alias("inside"), "value").mapInArrow(_pieces(header), PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("text")
    # a record over several blocks: its tail in one, perhaps middles, its head in the last
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = parts.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("p"))
    joined = joined.select(F.array_join(F.col("p.text"), "\n").alias("text"))
    records = whole.unionByName(joined)
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return records.select(text.alias("text")).where(F.trim("text") != "")


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
                    options: dict[str, str] | None = None) -> DataFrame:
    """The rows of CSV files whose quoted fields may hold line breaks; columns by position, as ``schema`` has them."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = csv_records(spark, path, header).select(F.from_csv("text", ddl, options or {}).alias("r"))
    return parsed.select("r.*")
