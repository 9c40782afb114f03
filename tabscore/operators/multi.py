"""Several models in one pass.

Models are short parameter vectors known to the driver, so K models become K
margin expressions on the same row: no join, no shuffle.  The long form (one
row per input row and model) is an ``inline`` of an array of K structs, a
narrow generate; the ensemble is an in-row mean.  The per-model status table
is one global aggregate with K sums (partial per task, one final row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.linear import LinearModel, margin, predicted_label, probability
from tabscore.operators.validate import InputSchema, invalid_row

#: Models scored by one expression; more are scored in groups of this many, one pass each.
MODELS_PER_PASS = 256


def _guarded(bad, value, kind: str, on_invalid: str):
    """``value`` where the row is valid; else an error or NULL by the policy."""
    if on_invalid == "error":
        return F.when(bad, F.raise_error(F.lit("NULL or NaN in the model's features")).cast(kind)).otherwise(value)
    if on_invalid in ("null", "skip"):
        return F.when(~bad, value)
    raise ValueError("on_invalid must be one of ('error', 'skip', 'null')")


def _needed(models: Sequence[LinearModel]) -> list[str]:
    seen: list[str] = []
    for m in models:
        for f in m.features:
            if f not in seen:
                seen.append(f)
    return seen


def score_many(df: DataFrame, models: Sequence[LinearModel], keep: Sequence[str],
               threshold: float = 0.5, digits: int | None = 6, on_invalid: str = "error") -> DataFrame:
    """keep-columns + model_name, model_version, prediction, probability per model.

    A row with a NULL or NaN in a model's features is invalid for that model:
    an error, a NULL prediction and probability, or no row ("skip").
    """
    if not models:
        raise ValueError("no models given")
    if len(models) > MODELS_PER_PASS:
        parts = [score_many(df, models[i:i + MODELS_PER_PASS], keep, threshold, digits, on_invalid)
                 for i in range(0, len(models), MODELS_PER_PASS)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    InputSchema.from_feature_columns(_needed(models)).validate(df)
    entries = []
    for m in models:
        mg = margin(m)
        p = probability(mg)
        bad = invalid_row(df, m.features)
        label = predicted_label(mg, threshold).cast("double")
        entries.append(F.struct(
            F.lit(m.name).alias("model_name"), F.lit(m.version).alias("model_version"),
            _guarded(bad, label, "double", on_invalid).alias("prediction"),
            _guarded(bad, F.round(p, digits) if digits is not None else p, "double", on_invalid).alias("probability")))
    out = df.select(*keep, F.inline(F.array(*entries)))
    return out.where(F.col("prediction").isNotNull()) if on_invalid == "skip" else out


def score_ensemble(df: DataFrame, models: Sequence[LinearModel], keep: Sequence[str],
                   threshold: float = 0.5, digits: int | None = 6, on_invalid: str = "error") -> DataFrame:
    """keep-columns + mean probability over the models and its label (invalid rows as in ``score_many``)."""
    InputSchema.from_feature_columns(_needed(models)).validate(df)
    total = None
    for m in models:
        p = probability(margin(m))
        total = p if total is None else total + p
    mean = total / F.lit(float(len(models)))
    bad = invalid_row(df, _needed(models))
    out = df.select(*keep, _guarded(bad, F.round(mean, digits) if digits is not None else mean, "double",
                                    on_invalid).alias("probability"),
                    _guarded(bad, (mean > F.lit(threshold)).cast("double"), "double", on_invalid).alias("prediction"))
    return out.where(F.col("prediction").isNotNull()) if on_invalid == "skip" else out


def model_status(df: DataFrame, models: Sequence[LinearModel], requested: Sequence[str],
                 threshold: float = 0.5) -> DataFrame:
    """model_name, status, rows, positives for every requested model name.

    A name with no model gets ``error: unknown model`` and NULL counts; the
    others are scored.  One unknown model does not stop the rest.  Rows with
    a NULL or NaN in a model's features are not counted as positives, and the
    model's status names their number.
    """
    known = {m.name: m for m in models}
    usable = [known[n] for n in requested if n in known]
    missing_cols = {m.name: [f for f in m.features if f not in df.columns] for m in usable}
    ok = [m for m in usable if not missing_cols[m.name]]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, m in enumerate(ok):
        bad = invalid_row(df, m.features)
        aggs.append(F.count_if(~bad & predicted_label(margin(m), threshold)).alias(f"p{i}"))
        aggs.append(F.count_if(bad).alias(f"b{i}"))
    counts = df.agg(*aggs)
    rows = []
    for name in requested:
        if name not in known:
            status, n, pos = "error: unknown model", F.lit(None), F.lit(None)
        elif missing_cols[name]:
            status, n, pos = f"error: missing columns {missing_cols[name]}", F.lit(None), F.lit(None)
        else:
            i = ok.index(known[name])
            n, pos = F.col("n"), F.coalesce(F.col(f"p{i}"), F.lit(0))
            status = F.when(F.col(f"b{i}") == 0, "ok").otherwise(
                F.concat(F.lit("error: "), F.col(f"b{i}").cast("string"), F.lit(" invalid rows")))
        if isinstance(status, str):
            status = F.lit(status)
        rows.append(F.struct(F.lit(name).alias("model_name"), status.alias("status"),
                             n.cast("bigint").alias("rows"), pos.cast("bigint").alias("positives")))
    return counts.select(F.inline(F.array(*rows)))
