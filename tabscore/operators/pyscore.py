"""Scoring with a user Python predictor on Arrow batches.

The predictor's ``load()`` runs once, on the driver, and its result is
broadcast; workers never open model storage.  Each Arrow batch is handed to
``predict``, which may return a frame (with the output column) or an
array-like; an array is attached to the input batch after a length check.
A predictor that does not name its features sees whole rows as pandas frames,
but only the output column comes back from it: the input columns of a batch
are passed on as the Arrow arrays they came in, so a NULL stays a NULL, a NaN
a NaN and a bigint a bigint whatever pandas made of them.  Which rows are
valid is decided in the JVM, by the same expressions as in native scoring.
This is the slow path: only the columns the predictor needs should be sent
(pass ``columns``), and filters belong before it, since Catalyst cannot push
them through the Python node.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscore.functions.linear import LinearModel
from tabscore.functions.naming import free_name
from tabscore.operators.validate import InputSchema, guard_prediction
from tabscore.session import ship_package, spark_context


class BasePredictor(ABC):
    """User scoring class: ``load`` once, ``predict`` per batch."""

    input_schema: InputSchema | None = None

    @abstractmethod
    def load(self) -> Any:
        """Return the loaded model state (small; it is broadcast)."""

    @abstractmethod
    def predict(self, state: Any, batch: pd.DataFrame):
        """Return predictions for ``batch`` (frame with the output column, or array)."""


class ArtifactPredictor(BasePredictor):
    """A predictor whose state is saved artifacts, its own or other models': ``state[alias]`` in ``predict``.

    ``wanted`` gives, by alias, an artifact's name or (name, other key parts
    such as ``{"model": "base", "version": "v3"}``).  The driver reads them
    once and broadcasts them; workers open no store.
    """

    def __init__(self, store, **wanted):
        self.store, self.wanted = store, wanted

    def load(self) -> dict[str, Any]:
        out = {}
        for alias, artifact in self.wanted.items():
            name, other = (artifact, {}) if isinstance(artifact, str) else artifact
            out[alias] = self.store.load(name, **other)
        return out

    def __getstate__(self):
        return {**self.__dict__, "store": None}    # what workers get has no session


class LinearPredictor(BasePredictor):
    """NumPy twin of the native expression (same operations, same order)."""

    def __init__(self, model: LinearModel, threshold: float = 0.5):
        self.model = model
        self.threshold = threshold
        self.features = list(model.features)
        self.input_schema = InputSchema.from_feature_columns(model.features)

    def load(self):
        m = self.model
        return {"features": list(m.features), "w": list(m.coefficients), "b": m.intercept,
                "mean": list(m.means), "scale": list(m.scales), "threshold": self.threshold}

    def predict(self, state, batch: pd.DataFrame):
        total = None
        for name, w, mu, s in zip(state["features"], state["w"], state["mean"], state["scale"]):
            x = batch[name].to_numpy(dtype=np.float64)
            term = ((x - mu) / s) * w
            total = term if total is None else total + term
        total = total + state["b"]
        t = state["threshold"]
        cut = 0.0 if t == 0.5 else np.log(t / (1.0 - t))
        return (total > cut).astype(np.float64)


def _output(result, output: str, rows: int) -> pd.Series:
    """The predictions of a batch of ``rows`` rows, from a frame that has them or an array-like."""
    if isinstance(result, pd.DataFrame):
        if output not in result.columns:
            raise ValueError(f"predictor returned a frame without column {output!r}")
        if len(result) != rows:
            raise ValueError("predictor returned a different number of rows")
        return result[output].reset_index(drop=True)
    values = np.asarray(result)
    if values.ndim != 1 or len(values) != rows:
        raise ValueError(f"predictor returned shape {values.shape} for {rows} rows")
    return pd.Series(values)


def _frame(batch: pa.RecordBatch, time_zone: str) -> pd.DataFrame:
    """What the predictor sees; instants as wall-clock times of the session."""
    out = batch.to_pandas()
    for field in batch.schema:
        if pa.types.is_timestamp(field.type) and field.type.tz:
            out[field.name] = out[field.name].dt.tz_convert(time_zone).dt.tz_localize(None)
    return out


MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _state_of(spark, predictor: "BasePredictor", max_broadcast_bytes: int):
    """How a task gets the loaded state: broadcast within the bound, else loaded on the executor."""
    ship_package(spark)
    loaded = predictor.load()
    sc = spark_context(spark)
    if len(cloudpickle.dumps(loaded)) > max_broadcast_bytes:
        if isinstance(predictor, ArtifactPredictor):
            raise ValueError("the artifacts are larger than max_broadcast_bytes, and only the driver can read them")
        return predictor.load
    if sc is None:
        return lambda: loaded    # Spark Connect has no broadcast variables: the (bounded) state rides in the closure
    shared = sc.broadcast(loaded)
    return lambda: shared.value


def score_with_predictor(df: DataFrame, predictor: BasePredictor, *,
                         columns: Sequence[str] | None = None, output: str = "prediction",
                         prediction_type: T.DataType = T.DoubleType(),
                         max_broadcast_bytes: int = MAX_BROADCAST_BYTES, on_invalid: str = "error",
                         required: Sequence[str] | None = None) -> DataFrame:
    """Input (or ``columns``) + ``output`` computed by the predictor per Arrow batch.

    A predictor that names its ``features`` gets those only, and the other
    columns stay in the JVM unchanged (see :func:`score_with_udf`).  One that
    does not gets whole rows; their columns come back unchanged as well.

    ``on_invalid`` is that of native scoring: a row with a NULL or NaN in its
    features raises, goes, or gets a NULL prediction, and the predictor never
    sees it.  For whole rows the features are ``required``: unless given, the
    columns of the predictor's input schema, and without one all columns.

    The loaded state is broadcast when its pickled size is within
    ``max_broadcast_bytes``; a larger state is not shipped from the driver:
    each partition calls ``load()`` once on its executor instead.
    """
    if columns is not None:
        df = df.select(*columns)
    if getattr(predictor, "features", None):
        return score_with_udf(df, predictor, predictor.features, output=output, prediction_type=prediction_type,
                              max_broadcast_bytes=max_broadcast_bytes, on_invalid=on_invalid)
    if predictor.input_schema is not None:
        predictor.input_schema.validate(df)
    if output in df.columns:
        raise ValueError(f"input already has column {output!r}")
    if required is None:
        schema = predictor.input_schema
        required = [c.name for c in schema.columns if c.name in df.columns] if schema is not None else df.columns
    valid = free_name(df.columns, "_valid")
    kept, flag = guard_prediction(df, required, F.lit(True), on_invalid)
    flagged = kept.withColumn(valid, flag)
    state = _state_of(df.sparkSession, predictor, max_broadcast_bytes)
    fields = list(df.schema.fields) + [T.StructField(output, prediction_type, True)]
    time_zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    empty = T.StructType([T.StructField(output, prediction_type, True)])
    arrow_type = to_arrow_schema(empty).field(0).type
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = state()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            rows = pa.RecordBatch.from_arrays(columns, names[:-1])
            fine = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            where = np.flatnonzero(fine == True)  # noqa: E712  NULL marks an invalid row
            out = pa.nulls(len(fine), arrow_type)
            if len(where):
                some = rows if len(where) == len(fine) else rows.take(pa.array(where))
                found = _output(predictor.predict(loaded, _frame(some, time_zone)), output, len(where))
                values = pa.array(found.to_numpy(), from_pandas=found.dtype == object).cast(arrow_type)
                if len(where) == len(fine):
                    out = values
                else:
                    at = np.full(len(fine), -1)
                    at[where] = np.arange(len(where))
                    out = values.take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([*columns, out], names)

    return flagged.mapInArrow(run, schema=T.StructType(fields))


def score_with_udf(df: DataFrame, predictor: BasePredictor, features: Sequence[str], *,
                   output: str = "prediction", prediction_type: T.DataType = T.DoubleType(),
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES, on_invalid: str = "error") -> DataFrame:
    """Input + ``output`` from the predictor, sending only ``features`` to Python.

    A row with a NULL or NaN feature raises, goes, or gets NULL by
    ``on_invalid``, as in native scoring.

    An iterator pandas UDF over ``struct(features)``: the other input columns
    stay in the JVM instead of crossing to Python and back (what
    ``mapInPandas`` does), and the state is fetched once per partition.
    """
    if predictor.input_schema is not None:
        predictor.input_schema.validate(df)
    if output in df.columns:
        raise ValueError(f"input already has column {output!r}")
    state = _state_of(df.sparkSession, predictor, max_broadcast_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        loaded = state()
        for batch in batches:
            yield _output(predictor.predict(loaded, batch), output, len(batch))

    udf = F.pandas_udf(run, returnType=prediction_type)   # iterator-of-series form, from the type hints
    df, prediction = guard_prediction(df, features, udf(F.struct(*[F.col(c) for c in features])), on_invalid)
    return df.withColumn(output, prediction)
