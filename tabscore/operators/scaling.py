"""Standardisation with population statistics.

Fit is one aggregate (mean and population std per feature, NaN treated as
missing); the driver receives one row.  A zero std is stored as 1, so the
transform is plain ``(x - mean) / scale`` with literals.  MLlib's
``StandardScaler`` is not used: it divides by the sample std.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalerParams:
    """Fitted means and population stds per feature; ``scales`` maps a zero std to 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    n: int

    @property
    def scales(self) -> tuple[float, ...]:
        return tuple(1.0 if (s is None or s == 0.0) else s for s in self.stds)


def _clean(name: str):
    c = F.col(name).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One-row aggregate: n_<i>, mean_<i>, std_<i> for each feature."""
    aggs = []
    for i, name in enumerate(features):
        aggs += [F.count(_clean(name)).alias(f"n_{i}"), F.avg(_clean(name)).alias(f"mean_{i}"),
                 F.stddev_pop(_clean(name)).alias(f"std_{i}")]
    return df.agg(*aggs)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> ScalerParams:
    row = scaler_stats(df, features).first()
    k = len(features)
    return ScalerParams(tuple(features), tuple(row[f"mean_{i}"] for i in range(k)),
                        tuple(row[f"std_{i}"] for i in range(k)),
                        max((row[f"n_{i}"] for i in range(k)), default=0))


def scaler_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form of the fit: feature, n, mean, std, scale (lazy, one aggregate)."""
    stats = scaler_stats(df, features)
    rows = [F.struct(F.lit(name).alias("feature"), F.col(f"n_{i}").alias("n"),
                     F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
                     F.when(F.col(f"std_{i}") == 0, F.lit(1.0)).otherwise(F.col(f"std_{i}")).alias("scale"))
            for i, name in enumerate(features)]
    return stats.select(F.inline(F.array(*rows)))


def transform(df: DataFrame, params: ScalerParams, suffix: str = "") -> DataFrame:
    """Scale each feature with the fitted literals (replace, or add with a suffix)."""
    cols = {}
    for name, m, s in zip(params.features, params.means, params.scales):
        cols[name + suffix] = (F.col(name).cast("double") - F.lit(float(m))) / F.lit(float(s))
    return df.withColumns(cols)
