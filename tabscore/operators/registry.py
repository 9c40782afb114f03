"""Model registry and artifact store, kept as Parquet tables.

A version is one folder (``feature_name=../model_name=../version=..``) that
is written aside and published by a rename, so a version is registered once
however many jobs try at the same time.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.functions.linear import LinearModel
from tabscore.operators.latest import latest_per_key
from tabscore.sources.publish import path_part, publish_folder

PARAMETERS = ("features array<string>, coefficients array<double>, intercept double, "
              "means array<double>, scales array<double>")
VERSION_ROW = f"registered_at timestamp_ntz, {PARAMETERS}, metrics map<string,double>"
REGISTRY_SCHEMA = f"{VERSION_ROW}, feature_name string, model_name string, version string"


def _utc_now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _parameters(model: LinearModel) -> tuple:
    return (list(model.features), list(model.coefficients), model.intercept, list(model.means), list(model.scales))


def _model(row) -> LinearModel:
    return LinearModel(tuple(row["features"]), tuple(row["coefficients"]), row["intercept"], tuple(row["means"]),
                       tuple(row["scales"]), row["model_name"], row["version"])


class ModelStore:
    """Fitted linear models as rows of a Parquet table, a folder a version.

    Saving a version is registering it; ``latest`` resolves the version with
    the newest ``registered_at`` (ties by version id).
    """

    def __init__(self, spark: SparkSession, path: str, feature_name: str = "default"):
        self.spark = spark
        self.path = path
        self.feature_name = feature_name

    def save(self, model: LinearModel, metrics: dict[str, float] | None = None,
             registered_at: _dt.datetime | None = None) -> str:
        """Register a version; saving the same parameters again is a no-op (safe retries).

        A version is immutable: different parameters under an existing
        version raise, also when both are saved at the same moment.
        """
        row = (registered_at or _utc_now(), *_parameters(model), {k: float(v) for k, v in (metrics or {}).items()})
        written = f"{self.path}/_claims/_claim-{uuid.uuid4().hex}"
        self.spark.createDataFrame([row], VERSION_ROW).coalesce(1).write.parquet(written)
        names = (("feature_name", self.feature_name), ("model_name", model.name), ("version", model.version))
        final = "/".join([self.path, *(f"{k}={path_part(v)}" for k, v in names)])
        if not publish_folder(self.spark, written, final):
            there = self.load(model.name, model.version)
            if _parameters(there) != _parameters(model):
                raise ValueError(f"version {model.version!r} of {model.name!r} exists with other parameters")
        return model.version

    def table(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.path)

    def _of(self, *model_names: str) -> DataFrame:
        return self.table().where((F.col("feature_name") == self.feature_name) & F.col("model_name").isin(list(model_names)))

    def versions(self, model_name: str | None = None) -> DataFrame:
        rows = self._of(model_name) if model_name else self.table().where(F.col("feature_name") == self.feature_name)
        return rows.select("feature_name", "model_name", "version", "registered_at",
                           F.col("metrics")["accuracy"].alias("accuracy"))

    def load_latest(self, model_names: list[str]) -> dict[str, LinearModel]:
        """Latest version of each named model; absent names are left out."""
        columns = ["version", "features", "coefficients", "intercept", "means", "scales"]
        rows = latest_per_key(self._of(*model_names), ["model_name"], columns, ["registered_at", "version"])
        return {r["model_name"]: _model(r) for r in rows.collect()}    # one row per requested model

    def load(self, model_name: str, version: str = "latest") -> LinearModel:
        try:
            if version == "latest":
                found = self.load_latest([model_name]).get(model_name)
            else:
                row = self._of(model_name).where(F.col("version") == version).first()
                found = None if row is None else _model(row)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":   # else no version was saved yet
                raise
            found = None
        if found is None:
            raise KeyError(f"no model {self.feature_name}/{model_name}/{version}")
        return found


def latest_versions(registry: DataFrame, group: Sequence[str], version: str,
                    registered_at: str, extra: Sequence[str] = ()) -> DataFrame:
    """Per group, the version with the newest ``registered_at`` (ties by version)."""
    return latest_per_key(registry, group, [version, registered_at, *extra], [registered_at, version])


class ModelKey(NamedTuple):
    """Which model version an artifact belongs to; as text ``{feature}/{model}/{version}``."""

    feature: str
    model: str
    version: str

    def __str__(self) -> str:
        return "/".join(self)

    def artifact(self, name: str) -> str:
        """Storage key of one of its artifacts."""
        return f"{self}/{name}"


ARTIFACT_SCHEMA = ("feature_name string, model_name string, version string, name string, "
                   "saved_at timestamp_ntz, payload binary")


class ArtifactStore:
    """Any picklable object under the key of a model version and a name, as table rows.

    ``load`` may name another model or version (ensembles read their members'
    artifacts); a name saved twice returns the later save.  Payloads are
    meant for fitted objects of modest size, not data.
    """

    def __init__(self, spark: SparkSession, path: str, key: ModelKey):
        self.spark, self.path, self.key = spark, path, key

    def save(self, name: str, obj: Any, saved_at: _dt.datetime | None = None) -> str:
        from pyspark import cloudpickle
        row = (*self.key, name, saved_at or _utc_now(), bytearray(cloudpickle.dumps(obj)))
        (self.spark.createDataFrame([row], ARTIFACT_SCHEMA)
             .write.mode("append").partitionBy("feature_name", "model_name").parquet(self.path))
        return self.key.artifact(name)

    def load(self, name: str, **other: str) -> Any:
        """``other``: ``model=`` and ``version=`` of another model's artifact."""
        import pickle
        key = self.key._replace(**other)
        rows = self.spark.read.schema(ARTIFACT_SCHEMA).parquet(self.path).where(F.col("name") == name)
        for column, value in zip(("feature_name", "model_name", "version"), key):
            rows = rows.where(F.col(column) == value)
        row = latest_per_key(rows, ["name"], ["payload"], ["saved_at"]).first()
        if row is None:
            raise KeyError(key.artifact(name))
        return pickle.loads(bytes(row["payload"]))
