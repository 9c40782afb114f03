"""File and table sources and sinks.

Reading: the format follows the path extension (case-insensitive; ``.parquet``
→ Parquet, ``.json``/``.jsonl`` → JSON, ``.orc`` → ORC, anything else → CSV
with a header).  CSV types are inferred only when no schema is given, since
inference costs an extra pass over the files.  A path beats a table name; with
neither the call fails.

Writing mirrors reading and honours the extension on every path.  The mode
is explicit (default overwrite; ``replace_partitions`` replaces only the
partitions that are written, so that a day's job can run again).  With no destination the DataFrame is
returned untouched: no hidden ``show()``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from tabscore.sources.csv_blocks import read_csv_blocks

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".json": "json",
           ".jsonl": "json", ".orc": "orc"}


def format_for_path(path: str) -> str:
    """By extension: Parquet without one, CSV for one that is not known; the same for reading and writing."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    return FORMATS.get(ext, "csv") if ext else "parquet"


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None,
              fmt: str | None = None, header: bool = True, multi_line: bool = True,
              null_value: str = "") -> DataFrame:
    """Read by extension (Parquet without one, as ``write_file`` writes).

    CSV: quotes inside a field are doubled, and quoted fields may hold line
    breaks; with a schema such files are read by many tasks
    (:mod:`tabscore.sources.csv_blocks`).  ``multi_line=False`` reads files
    known to have no such breaks line by line.  Without a schema types are
    inferred, which takes a file as one task's work: give large files one.
    ``null_value`` is the text of a missing cell; with the default an empty
    string is one too (give the writer and the reader another to tell them
    apart).
    """
    fmt = fmt or format_for_path(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options = {"quote": '"', "escape": '"', "nullValue": null_value, "emptyValue": ""}
        if schema is not None and multi_line:
            return read_csv_blocks(spark, path, schema, header, options)
        reader = reader.options(header=header, multiLine=multi_line, **options)
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All columns of a catalog table (``db.table``); pruning happens downstream."""
    return spark.table(table)


def load_input(spark: SparkSession, path: str | None = None, table: str | None = None,
               schema: StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """Path first, then table; neither is an error."""
    if path:
        return read_file(spark, path, schema, fmt)
    if table:
        return read_table(spark, table)
    raise ValueError("an input path or a table name is required")


def _writer(df: DataFrame, mode: str, partition_by: list[str] | None) -> DataFrameWriter:
    """``replace_partitions`` overwrites the partitions that ``df`` has rows of and leaves the others."""
    if mode == "replace_partitions":
        if not partition_by:
            raise ValueError("replace_partitions needs partition_by")
        return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer = df.write.mode(mode)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_file(df: DataFrame, path: str, mode: str = "overwrite", fmt: str | None = None,
               partition_by: list[str] | None = None, header: bool = True, null_value: str = "") -> None:
    """Write by extension (Parquet without one); CSV as :func:`read_file` reads it."""
    fmt = fmt or format_for_path(path)
    writer = _writer(df, mode, partition_by)
    if fmt == "csv":
        writer = writer.options(header=header, quote='"', escape='"', nullValue=null_value, emptyValue='""',
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def write_table(df: DataFrame, table: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    if mode == "replace_partitions" and df.sparkSession.catalog.tableExists(table):
        # into the table as it is, by its own partition columns and column order
        columns = df.sparkSession.table(table).columns
        df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)
        return
    _writer(df, mode, partition_by).saveAsTable(table)


def write_bucketed(df: DataFrame, table: str, key: str | list[str], buckets: int,
                   mode: str = "overwrite") -> None:
    """Save as a table bucketed (and sorted) by ``key``.

    Two tables bucketed by the same key into the same number of buckets join
    without an exchange on either side (e.g. documents and their labels,
    evaluated again and again): the shuffle is paid once, at write time.
    """
    keys = [key] if isinstance(key, str) else list(key)
    (df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
       .saveAsTable(table))


def write_output(df: DataFrame, path: str | None = None, table: str | None = None,
                 mode: str = "overwrite", fmt: str | None = None,
                 partition_by: list[str] | None = None) -> DataFrame:
    """File first, then table, else nothing; returns ``df``."""
    if path:
        write_file(df, path, mode, fmt, partition_by)
    elif table:
        write_table(df, table, mode, partition_by)
    return df


def rows_frame(spark: SparkSession, rows, columns) -> DataFrame:
    """A small in-memory table from rows and column names (development use)."""
    return spark.createDataFrame(rows, columns)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows, lazily (``show`` is left to the caller)."""
    return df.limit(n)
