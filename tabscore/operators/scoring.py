"""Batch scoring with native column expressions.

``score`` appends ``prediction`` to every input row and keeps all input
columns; one row out per row in, no shuffle, no Python.  The same function
accepts a streaming DataFrame unchanged.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.naming import free_name
from tabscore.functions.linear import LinearModel, margin, predicted_label, probability, vector_inputs
from tabscore.operators.validate import InputSchema, guard_prediction


def _check_output_free(df: DataFrame, *names: str) -> None:
    clash = [n for n in names if n and n in df.columns]
    if clash:
        raise ValueError(f"input already has column(s) {clash}; choose another output name")


def score(df: DataFrame, model: LinearModel, *, threshold: float = 0.5,
          output: str = "prediction", prediction_type: str = "double",
          classes: tuple | None = None, on_invalid: str = "error", validate: bool = True) -> DataFrame:
    """Input columns + ``prediction``.

    The prediction is 1/0 cast to ``prediction_type``, or, with
    ``classes=(negative, positive)``, the class labels themselves (strings or
    integers keep their type).
    """
    if validate:
        InputSchema.from_feature_columns(model.features).validate(df)
    _check_output_free(df, output)
    positive = predicted_label(margin(model), threshold)
    if classes is not None:
        neg, pos = classes
        pred = F.when(positive, F.lit(pos)).otherwise(F.lit(neg))
    else:
        pred = positive.cast(prediction_type)
    df, pred = guard_prediction(df, model.features, pred, on_invalid)
    return df.withColumn(output, pred)


def score_vector(df: DataFrame, model: LinearModel, vector_col: str, *, threshold: float = 0.5,
                 output: str = "prediction", probability_col: str | None = "probability",
                 digits: int | None = 6, on_invalid: str = "error") -> DataFrame:
    """Score a model whose features are the elements of one array column.

    Element i feeds feature i; the margin is the same native expression as
    for named columns (no explode, no Python).  A row whose array is NULL,
    too short, or holds a NULL/NaN element is invalid.
    """
    from pyspark.sql.types import ArrayType
    if vector_col not in df.columns or not isinstance(df.schema[vector_col].dataType, ArrayType):
        raise ValueError(f"{vector_col!r} is not an array column")
    _check_output_free(df, output, probability_col)
    v = F.col(vector_col)
    k = len(model.features)
    # The margin once per row, and only for arrays long enough to index.  A
    # NULL element makes it NULL and a NaN element makes it NaN, so validity
    # needs no scan of the array (and no per-row lambda).
    short = v.isNull() | (F.size(v) < k)
    name = free_name(df.columns, "_margin")
    df = df.withColumn(name, F.when(short, F.lit(None).cast("double"))
                       .otherwise(margin(model, vector_inputs(vector_col, model.features))))
    m = F.col(name)
    bad = m.isNull() | F.isnan(m)
    pred = predicted_label(m, threshold).cast("double")
    prob = probability(m)
    if digits is not None:
        prob = F.round(prob, digits)
    if on_invalid == "skip":
        df = df.where(~bad)
    elif on_invalid == "null":
        pred, prob = (F.when(bad, F.lit(None)).otherwise(pred), F.when(bad, F.lit(None)).otherwise(prob))
    elif on_invalid == "error":
        # both guarded: either may be read without the other
        pred, prob = (F.when(bad, F.raise_error(F.lit(f"invalid feature vector in {vector_col}"))).otherwise(v)
                      for v in (pred, prob))
    else:
        raise ValueError("on_invalid must be one of ('error', 'skip', 'null')")
    cols = {output: pred}
    if probability_col:
        cols[probability_col] = prob
    return df.withColumns(cols).drop(name)


def score_columns(model: LinearModel, threshold: float = 0.5,
                  digits: int | None = None) -> dict[str, Column]:
    """margin, probability and label expressions for one model."""
    m = margin(model)
    p = probability(m)
    if digits is not None:
        p = F.round(p, digits)
    return {"margin": m, "probability": p, "label": predicted_label(m, threshold)}


def score_proba(df: DataFrame, model: LinearModel, *, threshold: float = 0.5,
                label_col: str = "predicted_label", probability_col: str = "probability",
                digits: int | None = None, on_invalid: str = "error") -> DataFrame:
    """Input columns + probability and the thresholded label (int 0/1)."""
    InputSchema.from_feature_columns(model.features).validate(df)
    _check_output_free(df, label_col, probability_col)
    cols = score_columns(model, threshold, digits)
    label = cols["label"].cast("int")
    # both guarded: either may be read without the other
    _, prob = guard_prediction(df, model.features, cols["probability"], on_invalid)
    df, label = guard_prediction(df, model.features, label, on_invalid)
    return df.withColumns({probability_col: prob, label_col: label})


def shape_output(df: DataFrame, model: LinearModel, *, id_col: str,
                 threshold: float = 0.5, label_col: str = "predicted_label",
                 probability_col: str | None = "probability",
                 timestamp_col: str | None = "scored_at",
                 run_timestamp: _dt.datetime | None = None,
                 model_col: str | None = None, digits: int | None = 6,
                 on_invalid: str = "error") -> DataFrame:
    """The declared output layout: id, named label, probability, run timestamp.

    The timestamp is a job argument (not ``current_timestamp()``) so that a
    re-run writes identical rows.
    """
    InputSchema.from_feature_columns([id_col, *model.features]).validate(df)
    cols = score_columns(model, threshold, digits)
    df, label = guard_prediction(df, model.features, cols["label"].cast("int"), on_invalid)
    out = [F.col(id_col), label.alias(label_col)]
    if probability_col:
        prob = cols["probability"] if on_invalid != "null" else F.when(label.isNotNull(), cols["probability"])
        out.append(prob.alias(probability_col))
    if timestamp_col:
        ts = run_timestamp or _dt.datetime(1970, 1, 1)
        # wall-clock literal, independent of the Python and session time zones
        out.append(F.to_timestamp_ntz(F.lit(ts.isoformat(sep=" "))).alias(timestamp_col))
    if model_col:
        out.append(F.lit(f"{model.name}:{model.version}").alias(model_col))
    return df.select(*out)


@dataclass(frozen=True)
class OutputLayout:
    """The columns of a scored output, as a job or the command line names them (see :func:`shape_output`)."""

    id_col: str
    label_col: str = "predicted_label"
    probability_col: str | None = "probability"
    timestamp_col: str | None = "scored_at"
    run_timestamp: _dt.datetime | None = None
    model_col: str | None = None
    digits: int | None = 6

    def of(self, df: DataFrame, model: LinearModel, threshold: float = 0.5, on_invalid: str = "error") -> DataFrame:
        return shape_output(df, model, threshold=threshold, on_invalid=on_invalid, **asdict(self))
