"""Linear models as native column expressions.

A fitted standardise-then-logistic model is five short vectors.  Scoring it is
``sum_i w_i * (x_i - m_i) / s_i + b``; written as a Column it stays inside
whole-stage codegen, keeps predicate pushdown and column pruning, and needs
no Python worker.  The sum is always built in feature order, left to right,
so any engine evaluating the same text gets the same doubles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """Parameters of ``label = (w . (x - mean) / scale + b) > cut``."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float = 0.0
    means: tuple[float, ...] | None = None
    scales: tuple[float, ...] | None = None
    name: str = "model"
    version: str = "v1"
    metadata: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        n = len(self.features)
        object.__setattr__(self, "features", tuple(self.features))
        object.__setattr__(self, "coefficients", tuple(float(c) for c in self.coefficients))
        object.__setattr__(self, "intercept", float(self.intercept))
        means = (0.0,) * n if self.means is None else tuple(float(m) for m in self.means)
        scales = (1.0,) * n if self.scales is None else tuple(float(s) for s in self.scales)
        object.__setattr__(self, "means", means)
        object.__setattr__(self, "scales", scales)
        if not (len(self.coefficients) == len(means) == len(scales) == n):
            raise ValueError("features, coefficients, means and scales must have the same length")
        if not all(map(math.isfinite, (*self.coefficients, self.intercept, *means, *scales))):
            raise ValueError("model parameters must be finite numbers")
        if any(s == 0.0 for s in scales):
            raise ValueError("scales must be non-zero (a zero std is stored as 1)")

    def with_scaler(self, means: Sequence[float], scales: Sequence[float]) -> "LinearModel":
        return LinearModel(self.features, self.coefficients, self.intercept,
                           tuple(means), tuple(scales), self.name, self.version, self.metadata)

    def renamed(self, name: str, version: str | None = None) -> "LinearModel":
        return LinearModel(self.features, self.coefficients, self.intercept, self.means,
                           self.scales, name, version or self.version, self.metadata)


def _lit(x: float) -> Column:
    return F.lit(float(x))


def standardised(model: LinearModel, i: int, source: Column | None = None) -> Column:
    """``(x - mean) / scale``; a zero mean or unit scale is left out.

    Leaving them out changes no value (``x - 0.0`` and ``x / 1.0`` are exact
    in IEEE arithmetic, also for -0.0 and NaN) and keeps the generated code
    small for wide models without a scaler.
    """
    x = F.col(model.features[i]) if source is None else source
    x = x.cast("double")
    if model.means[i] != 0.0:
        x = x - _lit(model.means[i])
    if model.scales[i] != 1.0:
        x = x / _lit(model.scales[i])
    return x


def margin(model: LinearModel, inputs: dict[str, Column] | None = None) -> Column:
    """Decision value ``sum_i ((x_i - m_i) / s_i) * w_i + b`` (left-to-right)."""
    inputs = inputs or {}
    total = None
    for i, name in enumerate(model.features):
        term = standardised(model, i, inputs.get(name)) * _lit(model.coefficients[i])
        total = term if total is None else total + term
    if total is None:
        return _lit(model.intercept)
    return total + _lit(model.intercept)


def probability(m: Column) -> Column:
    """Logistic function of a margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def logit(threshold: float) -> float:
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")
    return math.log(threshold / (1.0 - threshold))


def predicted_label(m: Column, threshold: float = 0.5) -> Column:
    """``probability > threshold`` evaluated on the margin (no exp per row).

    At 0.5 this is ``margin > 0``, which is how the estimator's own predict
    decides; other cuts compare with ``log(t / (1 - t))``.
    """
    cut = 0.0 if threshold == 0.5 else logit(threshold)
    return m > F.lit(cut)


def sql_double(x: float) -> str:
    """Exact DuckDB/ANSI literal for a double."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def vector_inputs(column: str, features: Sequence[str]) -> dict[str, Column]:
    """Feature i read from element i of an array column."""
    return {name: F.col(column)[i] for i, name in enumerate(features)}


def sql_margin(model: LinearModel, qualifier: str = "", exprs: dict[str, str] | None = None) -> str:
    """DuckDB text of :func:`margin`, same association order."""
    exprs = exprs or {}
    total = None
    for i, name in enumerate(model.features):
        x = exprs.get(name, f"{qualifier}{name}")
        term = (f"((({x} - {sql_double(model.means[i])}) / "
                f"{sql_double(model.scales[i])}) * {sql_double(model.coefficients[i])})")
        total = term if total is None else f"({total} + {term})"
    if total is None:
        return sql_double(model.intercept)
    return f"({total} + {sql_double(model.intercept)})"
