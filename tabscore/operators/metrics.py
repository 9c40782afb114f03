"""Binary-classification metrics from one aggregate.

tp, fp, fn, tn are four conditional counts: partial per task, one tiny final
merge.  Positive label is 1; a zero denominator yields 0 (the zero-division
rule of the common metric libraries).  Rows with a NULL label or NULL
prediction are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.linear import LinearModel
from tabscore.operators.columns import align_features
from tabscore.operators.scoring import score


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    # NaN is no label: it is neither 1 nor "not 1"
    valid = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    return df.agg(
        F.count_if(valid).alias("n"),
        F.count_if(valid & (y == 1) & (p == 1)).alias("tp"),
        F.count_if(valid & (y != 1) & (p == 1)).alias("fp"),
        F.count_if(valid & (y == 1) & (p != 1)).alias("fn"),
        F.count_if(valid & (y != 1) & (p != 1)).alias("tn"),
    )


def metrics_from_confusion(conf: DataFrame) -> DataFrame:
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return conf.select(
        "*",
        _safe_div(tp + tn, n).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_metrics(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """One row: n, tp, fp, fn, tn, accuracy, precision, recall, f1."""
    return metrics_from_confusion(confusion(df, label, prediction))


def evaluate(df: DataFrame, model: LinearModel, label: str = "target",
             threshold: float = 0.5, on_invalid: str = "error") -> DataFrame:
    """Score a labelled table and compute the metrics in the same job.

    If none of the model's feature names exist, the non-label columns are
    used in order (see :func:`tabscore.operators.columns.align_features`).
    """
    df = align_features(df, model.features, label)
    scored = score(df, model, threshold=threshold, on_invalid=on_invalid)
    return binary_metrics(scored, label, "prediction")


def metrics_dict(metrics_df: DataFrame) -> dict[str, float]:
    row = metrics_df.first()
    return {k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1")}


def evaluate_many(df: DataFrame, models, label: str = "target", threshold: float = 0.5,
                  on_invalid: str = "error") -> DataFrame:
    """Metrics of several models on one labelled table in one aggregate.

    Every model's prediction is an expression on the same row, so the K
    confusion matrices are 4K conditional counts of a single pass; the
    result has one row per model (model_name, model_version, n, tp, fp, fn,
    tn, accuracy, precision, recall, f1, invalid).  Rows without a label are
    not counted.  A labelled row with a NULL or NaN feature of a model raises,
    or with ``on_invalid="skip"`` is left out for that model and counted in
    its ``invalid``.
    """
    if on_invalid not in ("error", "skip"):
        raise ValueError("on_invalid must be 'error' or 'skip'")
    from tabscore.functions.linear import margin, predicted_label
    from tabscore.operators.validate import invalid_reason, invalid_row
    y = F.col(label).cast("double")
    aggs = []
    for i, m in enumerate(models):
        p = predicted_label(margin(m), threshold)
        labelled, bad = y.isNotNull() & ~F.isnan(y), invalid_row(df, m.features)
        invalid = labelled & bad
        if on_invalid == "error":
            message = F.concat(F.lit(f"invalid feature value ({m.name}: "), invalid_reason(df, m.features), F.lit(")"))
            invalid = F.when(invalid, F.raise_error(message)).otherwise(F.lit(False))
        valid = labelled & ~bad
        aggs += [F.count_if(valid).alias(f"n{i}"),
                 F.count_if(valid & (y == 1) & p).alias(f"tp{i}"),
                 F.count_if(valid & (y != 1) & p).alias(f"fp{i}"),
                 F.count_if(valid & (y == 1) & ~p).alias(f"fn{i}"),
                 F.count_if(valid & (y != 1) & ~p).alias(f"tn{i}"), F.count_if(invalid).alias(f"invalid{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(m.name).alias("model_name"), F.lit(m.version).alias("model_version"),
                     *[F.col(f"{c}{i}").alias(c) for c in ("n", "tp", "fp", "fn", "tn", "invalid")])
            for i, m in enumerate(models)]
    return metrics_from_confusion(wide.select(F.inline(F.array(*rows)))).select(
        "model_name", "model_version", "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "invalid")
