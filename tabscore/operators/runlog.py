"""Run log kept as a table of commits, with a compacted snapshot.

A run log row is ``(run_id, kind, key, value, seq, ts)``; ``kind`` is
``param``, ``metric`` or ``artifact``.  A commit is one folder of rows that
were written together; a commit with a key of its own replaces what it wrote
before, so a job or a stream's batch that runs again leaves one copy.  The
current state takes, per (run, kind, key), the value with the greatest
(ts, seq); artifacts keep every row.

``compact`` writes the current state as a snapshot and notes which files it
covers; reading then merges the snapshot with the files that came later, so
the cost follows what was logged since, not the whole log.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.operators.latest import latest_per_key
from tabscore.operators.registry import (ArtifactStore, ModelKey, ModelStore, latest_versions)  # noqa: F401  part of this API
from tabscore.sources.publish import path_part

# The version id format (UTC time, then 8 hex digits).
VERSION_TIME_FORMAT = "%Y%m%d_%H%M%S"
VERSION_SUFFIX_HEX = 8

RUNLOG_SCHEMA = "run_id string, kind string, key string, value string, seq bigint, ts timestamp_ntz"
SNAPSHOT_SCHEMA = "snapshot string, created_at timestamp_ntz, files array<string>"


def generate_version(now: _dt.datetime | None = None) -> str:
    """``YYYYmmdd_HHMMSS_<8 hex>`` in UTC; sorts by creation time."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"{now.strftime(VERSION_TIME_FORMAT)}_{uuid.uuid4().hex[:VERSION_SUFFIX_HEX]}"


def _render(value: Any) -> str:
    if isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, default=str)


@dataclass(frozen=True)
class RunRecord:
    """What a run is: logged as its framework params, each named after its field."""

    profile: str
    version: str
    pipeline_type: str
    commit_hash: str | None = None

    def params(self) -> dict[str, str]:
        return {f"tabscore.{name}": value for name, value in asdict(self).items() if value}


class RunLog:
    """Run log stored as Parquet at ``path``, a folder a commit."""

    def __init__(self, spark: SparkSession, path: str, run_id: str | None = None):
        self.spark = spark
        self.path = path
        self.run_id = run_id or generate_version()
        self._seq = 0
        self._held: list[tuple] | None = None

    # ------------------------------------------------------------ writing

    def _write(self, rows: list[tuple], commit: str) -> None:
        (self.spark.createDataFrame(rows, RUNLOG_SCHEMA).coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path}/commit={path_part(commit)}"))

    def _rows(self, kind: str, items: dict[str, Any], ts: _dt.datetime | None) -> list[tuple]:
        ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        rows = []
        for key, value in items.items():
            self._seq += 1
            rows.append((self.run_id, kind, str(key), _render(value), self._seq, ts))
        return rows

    def _append(self, kind: str, items: dict[str, Any], ts: _dt.datetime | None = None) -> None:
        rows = self._rows(kind, items, ts)
        if self._held is not None:
            self._held += rows
        elif rows:
            self._write(rows, f"{self.run_id}-{uuid.uuid4().hex[:12]}")

    @contextlib.contextmanager
    def together(self, commit: str | None = None) -> Iterator["RunLog"]:
        """Everything logged inside is one commit, written at the end (not at all if the block raises).

        With a ``commit`` key the same block run again replaces its rows.
        """
        if self._held is not None:
            raise RuntimeError("together() is already open")
        self._held = []
        try:
            yield self
            rows = self._held
        finally:
            self._held = None
        if rows:
            self._write(rows, commit or f"{self.run_id}-{uuid.uuid4().hex[:12]}")

    def log_params(self, params: dict[str, Any], ts=None) -> None:
        self._append("param", params, ts)

    def log_metrics(self, metrics: dict[str, float], ts=None) -> None:
        self._append("metric", metrics, ts)

    def log_param(self, name: str, value: Any, ts=None) -> None:
        self.log_params({name: value}, ts)

    def log_metric(self, name: str, value: float, ts=None) -> None:
        self.log_metrics({name: value}, ts)

    def log_artifact(self, path: str, artifact: Any, ts=None) -> None:
        self._append("artifact", {path: str(artifact)}, ts)

    def log_run(self, record: RunRecord) -> None:
        self.log_params(record.params())

    def log_framework_params(self, profile: str, version: str, pipeline_type: str, commit_hash: str | None = None) -> None:
        self.log_run(RunRecord(profile, version, pipeline_type, commit_hash))

    # ------------------------------------------------------------ reading

    def table(self) -> DataFrame:
        """Every row of every commit."""
        return self.spark.read.schema(RUNLOG_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def _snapshot(self):
        """The newest snapshot's (name, covered files), or None."""
        try:
            index = self.spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{self.path}/_snapshots/index")
            return index.orderBy(F.desc("created_at"), F.desc("snapshot")).first()
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def rows(self) -> DataFrame:
        """The rows the current state follows from: the snapshot and what was committed after it."""
        log, snapshot = self.table(), self._snapshot()
        if snapshot is None:
            return log
        later = log.where(~F.col("_metadata.file_path").isin(list(snapshot["files"])))
        kept = self.spark.read.schema(RUNLOG_SCHEMA).parquet(f"{self.path}/_snapshots/data-{snapshot['snapshot']}")
        return kept.unionByName(later)

    def compact(self) -> str:
        """Write a snapshot of the current state; returns its name.

        The files it covers are those listed now: a commit that lands
        meanwhile is read as a later one.  The index row comes last, so a
        compaction that dies leaves the log as it was.  A keyed commit that
        is replaced afterwards has new files and is read again.
        """
        covered = [r[0] for r in self.table().select("_metadata.file_path").distinct().collect()]
        rows = self.rows()
        state = latest_rows(rows.where(F.col("kind") != "artifact")).unionByName(rows.where(F.col("kind") == "artifact"))
        name = generate_version()
        state.write.parquet(f"{self.path}/_snapshots/data-{name}")
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        (self.spark.createDataFrame([(name, now, covered)], SNAPSHOT_SCHEMA).coalesce(1)
             .write.mode("append").parquet(f"{self.path}/_snapshots/index"))
        return name

    def current(self) -> DataFrame:
        return current_view(self.rows())

    def summary(self, run_id: str | None = None) -> dict:
        """``{"params": {...}, "metrics": {...}, "artifacts": [{"path", "artifact"}]}`` of one run.

        Built from the last-write-wins view of that run only (bounded by the
        number of keys one run logged).  Metric values come back as floats.
        """
        run = run_id or self.run_id
        out: dict = {"params": {}, "metrics": {}, "artifacts": []}
        for r in current_view(self.rows().where(F.col("run_id") == run)).orderBy("kind", "key").toLocalIterator():
            if r["kind"] == "artifact":
                out["artifacts"].append({"path": r["key"], "artifact": r["value"]})
            else:
                out[f"{r['kind']}s"][r["key"]] = float(r["value"]) if r["kind"] == "metric" else r["value"]
        return out

    def save_json(self, path: str, run_id: str | None = None) -> None:
        """Write :meth:`summary` as a JSON file on the driver's filesystem."""
        with open(path, "w") as fh:
            json.dump(self.summary(run_id), fh, indent=2, sort_keys=True)


def latest_rows(log: DataFrame) -> DataFrame:
    """The whole rows that hold each key's last value."""
    return latest_per_key(log, ["run_id", "kind", "key"], ["value", "seq", "ts"], ["ts", "seq"])


def current_view(log: DataFrame) -> DataFrame:
    """Params and metrics: last write wins per key; artifacts: every row."""
    state = latest_rows(log.where(F.col("kind") != "artifact")).select("run_id", "kind", "key", "value")
    return state.unionByName(log.where(F.col("kind") == "artifact").select("run_id", "kind", "key", "value"))
