"""Column profiles: describe, value counts, head, observed row counts.

``describe`` gives pandas' statistics (count, mean, sample std, min,
25/50/75% with linear interpolation, max) in long form.  One aggregate gives
the moments and a KLL sketch of each column, of fixed size whatever the
number of rows, merged like a sum.  With ``exact=False`` the quantiles are
the sketch's.  With ``exact=True`` the sketch only says where they are: a
second pass counts the values before, in and after these brackets and so has
the exact ranks (no sort, no per-value maps in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.operators.selection import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
QUANTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _moments(df: DataFrame, columns: Sequence[str]):
    aggs = []
    for i, c in enumerate(columns):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    return aggs


#: Size of the sketches, and the rank error (as a share of the rows) that is allowed for: the published bound of
#: this size is below 0.0015, so a quantile outside its bracket is rare, and then only costs a further pass.
SKETCH_K, RANK_ERROR = 4096, 0.004


def _sketched(df: DataFrame, columns: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """The moments of each column, and ``q<i>``: its values near the given ranks (shares of the rows)."""
    aggs = _moments(df, columns)
    for i, c in enumerate(columns):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs.append(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"k{i}"))
    wide = df.agg(*aggs)
    at = F.array(*[F.lit(float(r)) for r in ranks])
    for i in range(len(columns)):
        wide = wide.withColumn(f"q{i}", F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"k{i}"), at)))
    return wide.drop(*[f"k{i}" for i in range(len(columns))])


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
             digits: int | None = 6) -> DataFrame:
    """Long form: column_name, statistic, value (double)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    if not exact:
        wide = _sketched(df, columns, QUANTILES)
        rows = []
        for i, c in enumerate(columns):
            vals = [F.col(f"n{i}").cast("double"), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"lo{i}"),
                    F.col(f"q{i}")[0], F.col(f"q{i}")[1], F.col(f"q{i}")[2], F.col(f"hi{i}")]
            for stat, v in zip(STATISTICS, vals):
                v = F.round(v, digits) if digits is not None else v
                rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(stat).alias("statistic"),
                                     v.alias("value")))
        return wide.select(F.inline(F.array(*rows)))

    near = [min(max(q + e, 0.0), 1.0) for q in QUANTILES for e in (-RANK_ERROR, RANK_ERROR)]
    row = _sketched(df, columns, near).first()
    stats = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    brackets = {(c, q): (row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1])
                for i, c in enumerate(columns) if row[f"n{i}"] for j, q in enumerate(QUANTILES)}
    qv = exact_quantiles(df, columns, QUANTILES, stats, brackets)
    out = []
    for i, c in enumerate(columns):
        vals = [float(row[f"n{i}"]), row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"],
                qv[(c, 0.25)], qv[(c, 0.5)], qv[(c, 0.75)], row[f"hi{i}"]]
        for stat, v in zip(STATISTICS, vals):
            if v is not None and digits is not None:
                v = float(v)
            out.append((c, stat, v))
    schema = "column_name string, statistic string, value double"
    result = spark.createDataFrame(out, schema)
    if digits is not None:
        result = result.withColumn("value", F.round("value", digits))
    return result


def describe_wide(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
                  digits: int | None = 6) -> DataFrame:
    """pandas layout: one row per statistic (count, mean, …, max), one column per input column.

    A pivot of the long form, which holds 8 rows per column (bounded).
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    long = describe(df, columns, exact=exact, digits=digits)
    order = F.array_position(F.array(*[F.lit(s) for s in STATISTICS]), F.col("statistic"))
    return (long.groupBy("statistic").pivot("column_name", columns).agg(F.first("value"))
                .withColumn("_order", order).orderBy("_order").drop("_order"))


def value_counts(df: DataFrame, column: str, count_col: str = "count", sort: bool = True) -> DataFrame:
    """Non-NULL values and their counts, most frequent first (ties by value).

    The group-by aggregates map-side first, so a value held by a third of the
    rows costs one partial row per task, not a hot reducer.  ``sort=False``
    skips the ordering (a range shuffle over the distinct values), for
    high-cardinality columns whose counts are written, not read in order.
    """
    counts = (df.where(F.col(column).isNotNull())
                .groupBy(column).agg(F.count(F.lit(1)).alias(count_col)))
    return counts.orderBy(F.col(count_col).desc(), F.col(column).asc()) if sort else counts


def head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by ``order_by`` (a top-n per task, then one small merge)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter filled in by whatever action runs next (no extra pass)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def null_count(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` is NULL (or NaN for floats): the not-null assertion."""
    c = F.col(column)
    dt = df.schema[column].dataType
    bad = c.isNull() | F.isnan(c) if isinstance(dt, (T.DoubleType, T.FloatType)) else c.isNull()
    return df.agg(F.count_if(bad).alias("null_rows"), F.count(F.lit(1)).alias("rows"))
