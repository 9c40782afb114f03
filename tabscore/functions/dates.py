"""Date predicates that keep the last day and still reach the Parquet scan.

``start <= day(c) <= end`` is written as ``c >= start AND c < end + 1 day``
with literals of the column's own type (date, timestamp or timestamp_ntz),
so Spark pushes both bounds into the scan.  Casting the column to DATE would
block the pushdown; comparing a timestamp with a bare date string would drop
everything after midnight of the last day.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_day(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    text = str(d)
    try:
        return _dt.date.fromisoformat(text)
    except ValueError:
        return _dt.datetime.fromisoformat(text).date()   # raises on anything else


def _typed(day: _dt.date, type_name: str) -> Column:
    text = F.lit(day.isoformat())
    if type_name == "date":
        return F.to_date(text)
    if type_name == "timestamp_ntz":
        return F.to_timestamp_ntz(text)
    if type_name == "timestamp":
        return F.to_timestamp(text)
    raise ValueError(f"not a date/timestamp type: {type_name}")


def day_window(df: DataFrame, column: str, start, end) -> Column:
    """``start <= day(column) <= end`` (inclusive, like SQL BETWEEN on dates)."""
    t = df.schema[column].dataType.simpleString()
    lo, hi = as_day(start), as_day(end) + _dt.timedelta(days=1)
    return (F.col(column) >= _typed(lo, t)) & (F.col(column) < _typed(hi, t))


def on_day(df: DataFrame, column: str, day) -> Column:
    """``day(column) = day``."""
    return day_window(df, column, day, day)
