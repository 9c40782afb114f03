"""Length features derived from whole texts (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_count(text: str | Column) -> Column:
    """Number of newline-separated pieces of the whole text (empty pieces count); NULL stays NULL."""
    t = _col(text)
    return F.when(t.isNull(), F.lit(None)).otherwise(F.size(F.split(t, "\n", -1))).cast("bigint")


def char_count(text: str | Column) -> Column:
    """Characters (code points) of the whole text."""
    return F.length(_col(text)).cast("bigint")
