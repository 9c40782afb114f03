"""The newest row of each key, by hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.naming import free_name


def latest_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                   order: Sequence[str]) -> DataFrame:
    """keys + the ``values`` of the row with the greatest ``order`` per key.

    The order comes first: the greatest value of each order column is one
    hash aggregate over narrow rows (numbers and times have buffers of fixed
    size, strings and structs have not and would be sorted), and a join with
    it leaves the rows that hold it.  What is then left of a key, one row but
    for full ties, gives the values.  NULLs rank lowest.
    """
    rows = df.select(*dict.fromkeys([*keys, *values, *order]))
    best = free_name(rows.columns, "_best")
    names = {k: free_name([*rows.columns, best], f"_key_{i}") for i, k in enumerate(keys)}
    for column in order:
        top = rows.groupBy(*keys).agg(F.max(column).alias(best)).select(
            *[F.col(k).alias(names[k]) for k in keys], best)
        same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys] + [F.col(column).eqNullSafe(F.col(best))]
        rows = rows.join(top, reduce(lambda a, b: a & b, same)).drop(best, *names.values())
    last = rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias(best))
    return last.select(*keys, *[F.col(best).getField(v).alias(v) for v in values])
