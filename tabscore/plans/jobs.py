"""The jobs a user runs: train a model, score a table, score several models.

Training: project and persist the input once → split (exact or keyed) →
scaler fit on the train side (one aggregate) → logistic fit (distributed
Newton passes over the rows that are held already) → metrics on the held-out side (one aggregate) → run log
rows and a registry row.  The driver only ever holds the fitted vectors and
four counters.

Scoring: read (path beats table) → schema check on the driver → native score
expression → write, with the row count observed during the write instead of
a second pass.  Several models: one pass, long-form output, per-model status.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.functions.dates import on_day
from tabscore.functions.hashing import hash32
from tabscore.functions.linear import LinearModel
from tabscore.functions.naming import free_name
from tabscore.operators import logistic, metrics, profile, sampling, scaling
from tabscore.operators.pyscore import BasePredictor, score_with_predictor
from tabscore.operators.runlog import ArtifactStore, ModelStore, RunLog, generate_version
from tabscore.operators.scoring import OutputLayout, score
from tabscore.operators.validate import ON_INVALID, InputSchema, invalid_row
from tabscore.sources.files import load_input, write_output
from tabscore.sources.sql_extract import training_extract

#: A user's training function: (training rows, features, label) -> a linear model or a predictor.
Fit = Callable[[DataFrame, Sequence[str], str], "LinearModel | BasePredictor"]


@dataclass
class TrainResult:
    """Fitted model (scaler folded in), held-out metrics, scaler and row counts."""

    model: LinearModel | BasePredictor
    metrics: dict[str, float]
    scaler: scaling.ScalerParams | None = None
    sizes: dict[str, int] = field(default_factory=dict)


def train_job(df: DataFrame, features: Sequence[str], label: str, key: str | Sequence[str], *,
              test_fraction: float = 0.2, split_mode: str = "exact", seed=42,
              C: float = 1.0, max_iter: int = 1000, tol: float = 1e-6,
              name: str = "model", version: str | None = None,
              run_log: RunLog | None = None, store: ModelStore | None = None,
              hash_algorithm: str = "md5", on_invalid: str = "error", solver: str = "newton",
              fit: Fit | None = None, artifacts: ArtifactStore | None = None) -> TrainResult:
    """Split, scale, fit, evaluate on the held-out rows, log and register.

    Rows without a label (NULL or NaN) cannot be trained on; rows with a NULL
    or NaN feature are an error, or with ``on_invalid="skip"`` left out before
    the split, so neither side loses rows unseen.  ``sizes`` counts all of
    them: rows_in, rows_unlabelled, rows_invalid, train, test.

    ``fit`` is the user's own training function in place of scaler and
    logistic fit: it gets the training side as a DataFrame, the features and
    the label, and returns a :class:`LinearModel` or a predictor.  Either is
    evaluated on the held-out side like ours; a predictor is saved in
    ``artifacts`` under the name of the model.

    The projected input (key, features, label) is persisted for the job: the
    split's selection rounds, the scaler fit, the fit and the evaluation all
    read it, and an input that is itself a join would otherwise be
    recomputed by each of them.  A lost executor's blocks are recomputed from
    lineage.  ``hash_algorithm="xxhash64"`` makes the split several times
    cheaper per row but Spark-only (md5 splits can be reproduced by other
    engines).
    """
    keys = [key] if isinstance(key, str) else list(key)
    version = version or generate_version()
    cols = list(dict.fromkeys([*keys, *features, label]))
    if on_invalid not in ("error", "skip"):
        raise ValueError("on_invalid must be 'error' or 'skip'")
    projected = df.select(*cols)
    unlabelled = F.col(label).isNull() | F.isnan(F.coalesce(F.col(label).cast("double"), F.lit(0.0)))
    invalid = invalid_row(projected, features)
    # the keys' hash is part of what is held: the split's rounds and both sides read it
    hashed = free_name(cols, "_hash")
    marked = projected.select("*", unlabelled.alias("_unlabelled"), invalid.alias("_invalid"),
                              hash32(keys, seed, hash_algorithm).alias(hashed)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows_in, n_unlabelled, n_invalid = marked.agg(
            F.count("*"), F.count_if("_unlabelled"), F.count_if(~F.col("_unlabelled") & F.col("_invalid"))).first()
        if n_invalid and on_invalid == "error":
            raise ValueError(f"{n_invalid} labelled rows hold a NULL or NaN feature (on_invalid='skip' leaves them out)")
        data = marked.where("NOT _unlabelled AND NOT _invalid").drop("_unlabelled", "_invalid")
        train, test = sampling.split(data, test_fraction, keys, seed, split_mode, hash_algorithm, hashed)
        if fit is not None:
            model, params, n_train = fit(train.drop(hashed), list(features), label), None, train.count()
            scores = metrics.metrics_dict(_evaluated(test.drop(hashed), model, label))
            return _kept(model, scores, None, name, version, n_train, rows_in, n_unlabelled, n_invalid, run_log, store, artifacts,
                         {"model_type": type(model).__name__, "test_size": test_fraction, "split_mode": split_mode})
        params = scaling.fit_scaler(train, features)
        fitted = logistic.fit_logistic(scaling.transform(train, params), features, label,
                                       C=C, max_iter=max_iter, tol=tol, solver=solver, name=name, version=version,
                                       persist=False)
        model = LinearModel(tuple(features), fitted.coefficients, fitted.intercept,
                            params.means, params.scales, name, version, fitted.metadata)
        scores = metrics.metrics_dict(metrics.evaluate(test, model, label))
    finally:
        marked.unpersist()
    return _kept(model, scores, params, name, version, params.n, rows_in, n_unlabelled, n_invalid, run_log, store, artifacts,
                 {"model_type": "LogisticRegression", "max_iter": max_iter, "C": C, "test_size": test_fraction,
                  "split_mode": split_mode, "solver": solver})


def _evaluated(test: DataFrame, model: LinearModel | BasePredictor, label: str) -> DataFrame:
    if isinstance(model, LinearModel):
        return metrics.evaluate(test, model, label)
    return metrics.binary_metrics(score_with_predictor(test, model), label, "prediction")


def _kept(model, scores, scaler, name, version, n_train, rows_in, n_unlabelled, n_invalid, run_log, store, artifacts,
          logged: dict) -> TrainResult:
    """Register the model, log the run in one commit, count the rows."""
    where = None
    if isinstance(model, LinearModel) and store is not None:
        store.save(model.renamed(name, version), scores)
        where = (f"{store.feature_name}/{name}/{version}/model", store.path)
    elif not isinstance(model, LinearModel) and artifacts is not None:
        where = (artifacts.save(name, model), artifacts.path)
    if run_log is not None:
        with run_log.together():
            run_log.log_params(logged)
            run_log.log_metrics(scores)
            if where is not None:
                run_log.log_artifact(*where)
    return TrainResult(model, scores, scaler, {
        "train": n_train, "test": rows_in - n_unlabelled - n_invalid - n_train, "rows_in": rows_in,
        "rows_unlabelled": n_unlabelled, "rows_invalid": n_invalid})


HYPERPARAMETER_DEFAULTS = {"max_iter": 1000, "C": 1.0, "tol": 1e-6}
CONFIG_DEFAULTS = {"test_size": 0.2, "split_mode": "exact", "seed": 42}


def training_settings(config: dict | None) -> dict:
    """Flat settings from ``{"test_size": .., "hyperparameters": {"max_iter": ..}}`` with defaults."""
    config = config or {}
    out = {k: config.get(k, v) for k, v in CONFIG_DEFAULTS.items()}
    hp = config.get("hyperparameters") or {}
    out.update({k: hp.get(k, v) for k, v in HYPERPARAMETER_DEFAULTS.items()})
    return out


def train_from_config(df: DataFrame, features: Sequence[str], label: str, key, config: dict | None = None,
                      **kwargs) -> TrainResult:
    """Settings from the config (defaults filled in); explicit keyword arguments win."""
    s = training_settings(config)
    settings = {"test_fraction": s["test_size"], "split_mode": s["split_mode"], "seed": s["seed"],
                "C": s["C"], "max_iter": s["max_iter"], "tol": s["tol"]}
    settings.update(kwargs)
    return train_job(df, features, label, key, **settings)


def train_from_extract(spark: SparkSession, table: str, features: Sequence[str], target_column: str, date_column: str,
                       start_date, end_date, key: str | Sequence[str], *, sample_fraction: float = 1.0, sample_seed: str | None = None,
                       config: dict | None = None, **kwargs) -> TrainResult:
    """Train on the SQL extract of a table: a date window of labelled rows, sampled by the split's key."""
    keys = [key] if isinstance(key, str) else list(key)
    data = training_extract(spark, table, list(dict.fromkeys([*features, *keys])), target_column, date_column, start_date, end_date,
                            sample_fraction, keys, sample_seed)
    return train_from_config(data, features, "target", keys, config, **kwargs)


def score_job(spark: SparkSession, model: LinearModel, *, input_path: str | None = None,
              table: str | None = None, output_path: str | None = None,
              output_table: str | None = None, schema: InputSchema | None = None,
              on_invalid: str = "error", threshold: float = 0.5, mode: str = "overwrite",
              partition_by: list[str] | None = None, layout: OutputLayout | None = None,
              run_log: RunLog | None = None) -> tuple[DataFrame, int | None]:
    """Returns the scored DataFrame and, when written, its row count.

    ``partition_by`` (for example a date column) lays the output out so that
    readers prune partitions.  Without a ``layout`` the output is the input
    columns and ``prediction``; with one it is the columns it names.
    """
    df = load_input(spark, input_path, table)
    (schema or InputSchema.from_feature_columns(model.features)).validate(df)
    if layout is not None:
        scored = layout.of(df, model, threshold, on_invalid)
    else:
        scored = score(df, model, threshold=threshold, on_invalid=on_invalid, validate=False)
    return scored, _write_counted(scored, output_path, output_table, mode, partition_by, run_log)


def score_day_job(spark: SparkSession, model: LinearModel, *, date_column: str, day, input_path: str | None = None,
                  table: str | None = None, output_path: str | None = None, output_table: str | None = None,
                  on_invalid: str = "error", threshold: float = 0.5,
                  run_log: RunLog | None = None) -> tuple[DataFrame, int | None]:
    """Score one day of a table and replace that day in the output; running it again leaves the same rows.

    The day is a typed predicate on ``date_column``, so of an input that is
    partitioned by it only that partition is read.  The output is partitioned
    by the same column and only the partitions written are replaced.
    """
    df = load_input(spark, input_path, table)
    df = df.where(on_day(df, date_column, day))
    InputSchema.from_feature_columns(model.features).validate(df)
    scored = score(df, model, threshold=threshold, on_invalid=on_invalid, validate=False)
    return scored, _write_counted(scored, output_path, output_table, "replace_partitions", [date_column], run_log)


def _write_counted(scored: DataFrame, path: str | None, table: str | None, mode: str,
                   partition_by: list[str] | None, run_log: RunLog | None) -> int | None:
    """Write a scored table; its row count, observed during the write (None when there is nowhere to write)."""
    if not (path or table):
        return None
    counted, obs = profile.observed(scored)
    write_output(counted, path, table, mode, partition_by=partition_by)
    rows = obs.get["rows"]
    if run_log is not None:
        run_log.log_metrics({"rows_scored": rows})
    return rows


def predictor_score_job(spark: SparkSession, predictor, *, input_path: str | None = None,
                        table: str | None = None, output_path: str | None = None,
                        output_table: str | None = None, columns: Sequence[str] | None = None,
                        on_invalid: str = "error", mode: str = "overwrite",
                        partition_by: list[str] | None = None,
                        run_log: RunLog | None = None) -> tuple[DataFrame, int | None]:
    """:func:`score_job` with a user's Python predictor.

    Input columns come through unchanged and ``on_invalid`` holds whether the
    predictor names its ``features`` or gets whole rows.
    """
    df = load_input(spark, input_path, table)
    scored = score_with_predictor(df, predictor, columns=columns, on_invalid=on_invalid)
    return scored, _write_counted(scored, output_path, output_table, mode, partition_by, run_log)


def score_models_job(spark: SparkSession, store: ModelStore, model_names: Sequence[str], *,
                     keep: Sequence[str], input_path: str | None = None, table: str | None = None,
                     output_path: str | None = None, output_table: str | None = None,
                     threshold: float = 0.5, mode: str = "overwrite", on_invalid: str = "error") -> dict[str, dict]:
    """Score several registered models in one pass; one status per requested name.

    Latest versions are resolved with one aggregate; the long-form output
    (``keep`` columns + model_name, model_version, prediction, probability)
    is written partitioned by model; rows and positives per model are
    observed during that write.  A name without a model, or a model whose
    features are missing from the input, gets ``error: …`` and does not stop
    the others; nor does, with ``on_invalid="error"``, a model that meets a
    NULL or NaN in its features (found by one aggregate before the write, so
    that nothing of that model is written).  With ``skip`` or ``null`` such
    rows are left out or written with a NULL prediction; ``invalid`` is their
    number.
    """
    if on_invalid not in ON_INVALID:
        raise ValueError(f"on_invalid must be one of {ON_INVALID}")
    from pyspark.sql import functions as F
    from tabscore.operators import multi

    df = load_input(spark, input_path, table)
    found = store.load_latest(list(model_names))
    status: dict[str, dict] = {}
    usable = []
    for name in model_names:
        m = found.get(name)
        if m is None:
            status[name] = {"status": "error: unknown model"}
        elif [f for f in m.features if f not in df.columns]:
            status[name] = {"status": f"error: missing columns {[f for f in m.features if f not in df.columns]}"}
        else:
            usable.append(m)
    if on_invalid == "error" and usable:
        bad = df.agg(*[F.count_if(invalid_row(df, m.features)).alias(f"b{i}") for i, m in enumerate(usable)]).first()
        for m, n in zip(usable, bad):
            if n:
                status[m.name] = {"status": f"error: {n} invalid rows", "version": m.version, "invalid": n}
        usable = [m for m, n in zip(usable, bad) if not n]
    if not usable:
        return status
    long = multi.score_many(df, usable, keep, threshold, on_invalid="null")
    counters = []
    for i, m in enumerate(usable):
        this = F.col("model_name") == F.lit(m.name)
        counters += [F.count_if(this).alias(f"rows{i}"),
                     F.count_if(this & (F.col("prediction") == 1.0)).alias(f"pos{i}"),
                     F.count_if(this & F.col("prediction").isNull()).alias(f"bad{i}")]
    from pyspark.sql import Observation
    obs = Observation("models")
    counted = long.observe(obs, *counters)
    if on_invalid == "skip":
        counted = counted.where(F.col("prediction").isNotNull())
    if output_path:
        counted.write.mode(mode).partitionBy("model_name").parquet(output_path)
    elif output_table:
        counted.write.mode(mode).partitionBy("model_name").saveAsTable(output_table)
    else:
        counted.write.format("noop").mode("overwrite").save()
    got = obs.get
    for i, m in enumerate(usable):
        gone = got[f"bad{i}"] if on_invalid == "skip" else 0
        status[m.name] = {"status": "ok", "version": m.version, "rows": got[f"rows{i}"] - gone,
                          "positives": got[f"pos{i}"], "invalid": got[f"bad{i}"]}
    return status
