"""Helpers shared by the operators: tables, written intermediates, row identity, name clashes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tabscore.session import scratch_path, ship_package

#: A side of a join is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows per Arrow batch: whole texts travel, so a batch is kept small and a Python worker's memory with it.
BATCH_ROWS = 1000


def python_workers(spark: SparkSession) -> None:
    """Prepare the session for Python on the executors: the package shipped, batches of bounded size."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads committed files, so a lost executor
    costs a re-read, never a recomputation that could come out differently.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores appended until no column (case-insensitively) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(quoted(name))


def is_file_scan(df: DataFrame) -> bool:
    """True for a projection or filter of one file scan (each output row is one row of a file)."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def located(df: DataFrame, columns: list[Column], name: str = "located", file: str = "file",
            pos: str = "pos") -> DataFrame:
    """``columns`` of ``df`` and a stable locator of each row: file (64-bit hash of its path) and position in it.

    The locator depends on the stored files alone, not on partitioning or
    retries, and tells apart rows that are equal in every column.  A frame
    that is not a plain Parquet scan is written once to the shared folder.
    ``file`` and ``pos`` name the locator's columns; no other column of
    ``df`` is added or looked at, so none can clash with them.
    """
    for attempt in range(2):
        if is_file_scan(df):
            try:
                meta = df.metadataColumn("_metadata")
                out = df.select(*columns, F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(pos))
                out.schema
                return out
            except Exception:
                if attempt:
                    raise
        df = materialise(df, name)
    raise RuntimeError("a written Parquet copy must be a plain scan")


def without_rows(df: DataFrame, dropped: DataFrame, name: str = "located") -> DataFrame:
    """``df`` without the rows at the places in ``dropped`` (file, pos), its columns as they were."""
    taken = list(df.columns)
    names = []
    for wanted in ("_row_file", "_row_pos", "_drop_file", "_drop_pos"):
        names.append(free_name(taken, wanted))
        taken.append(names[-1])
    side, _ = small(dropped.select(F.col("file").alias(names[2]), F.col("pos").alias(names[3])), 24)
    rows = located(df, [col(c) for c in df.columns], name, names[0], names[1])
    at = (col(names[0]) == col(names[2])) & (col(names[1]) == col(names[3]))
    return rows.join(side, at, "left_anti").select([col(c) for c in df.columns])


def measured_bytes(df: DataFrame, row_bytes: int) -> tuple[int, int]:
    """(rows, bytes) of ``df``: ``row_bytes`` a row for what every row takes, and its strings and arrays as they are."""
    wide = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            wide = wide + F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            wide = wide + F.when(c.isNull(), 0).otherwise(F.size(c).cast("long") * 8)
    n, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    return n, n_bytes + n * row_bytes


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` hinted for broadcast when its measured size is below ``limit``; else as it is.

    ``df`` should be a written table: it is measured here and read again by
    the join.  Above the limit the join is Spark's shuffled one.
    """
    fits = measured_bytes(df, row_bytes)[1] <= limit
    return (F.broadcast(df) if fits else df), fits


#: Rows of one key from which it is joined apart from the others.
HOT_ROWS = 4096


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``groups`` (written; one row a key, ``size`` counting its rows), no key in one task.

    Keys with more than ``hot_rows`` rows are few, at most one for so many
    rows; they are joined where their rows are, by broadcast while they
    measure below the bound.  The others are joined by shuffle.
    """
    hot = groups.where(F.col(size) > hot_rows)
    n, n_bytes = measured_bytes(hot, 64)
    if n == 0 or n_bytes > BROADCAST_BYTES:
        return rows.join(groups, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= hot_rows), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def drop_rows(docs: DataFrame, dropped: DataFrame, key: str, row_bytes: int = 16) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped`` (one column, named ``key``); null keys match null keys."""
    side, _ = small(dropped, row_bytes)
    mark = free_name(docs.columns, "_dropped_key")
    side = side.select(F.col(key).alias(mark))
    return docs.join(side, col(key).eqNullSafe(F.col(mark)), "left_anti")


def _with_low(rows: DataFrame, low: DataFrame, large: bool) -> DataFrame:
    """``rows`` with the smallest neighbour ``m`` of their ``u``; with ``large`` stars, their centres apart."""
    return join_counted(rows, low, "u", "n", HOT_ROWS) if large else rows.join(low, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs) as (node, root), root the smallest node.

    Alternating large-star and small-star steps: each is one minimum per node
    and one join, both spread over the cluster (the centre of a star is joined
    where its edges are, not in one task), and each round is written to the
    shared folder.  Only counts and a checksum reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialise(e, "cc-edges")
    sign = None
    for _ in range(max_rounds):
        # large star: every larger neighbour points to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = (low.agg(F.max("n")).first()[0] or 0) > HOT_ROWS
        if large:
            low = materialise(low, "cc-low")
        big = _with_low(both, low, large).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        big = big.where("u <> v").distinct()
        if large:
            big = materialise(big, "cc-big")
        # small star: a node and its smaller neighbours point to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if large:
            low = materialise(low, "cc-low")
        e2 = _with_low(big, low, large).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e2 = materialise(e2, "cc-edges")
        now = e2.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        e = e2
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null and blank texts give an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def crc_mod(ident: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


__all__ = ["BROADCAST_BYTES", "table", "materialise", "free_name", "quoted", "col", "located", "without_rows", "join_counted",
           "small", "drop_rows", "components", "words", "crc_mod", "python_workers", "F", "T", "Window"]
