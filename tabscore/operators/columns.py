"""Column selection helpers: feature projection, label alias, append, drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The declared features, in declared order."""
    return df.select(*features)


def align_features(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """Frame whose columns carry the model's feature names.

    When none of the declared names exist, the non-label columns are taken in
    order as the features (the positional fallback); the counts must agree.
    """
    if not set(features).isdisjoint(df.columns):
        return df
    rest = df.drop(label).columns
    if len(rest) != len(features):
        raise ValueError(f"{len(rest)} non-label columns for {len(features)} features")
    keep = [label] if label in df.columns else []
    return df.select(*[F.col(c).alias(f) for c, f in zip(rest, features)], *keep)


def label_as(column: str, alias: str = "target") -> Column:
    return F.col(column).alias(alias)


def append_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column; refuse to shadow an existing one."""
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    return df.withColumn(name, value)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.drop(*names)
