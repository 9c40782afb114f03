"""Session helpers: building a session and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# only for local[...] runs (tests, bench): a cluster keeps its UI
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int, scan_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster, derived from this library's job shapes.

    The data volume sits in narrow scan → expression → write stages (scoring,
    extracts, splits, quarantine), so scan splits set the parallelism: 256 MB
    splits keep a 100 TB input at about 400k tasks.  Shuffles carry aggregate
    partials only (one row per key per task), so a shuffle partition count of
    a few times the core count is plenty; AQE coalesces the rest and splits
    skewed partitions.  Arrow batches bound the Python workers' memory.
    """
    return {
        "spark.sql.files.maxPartitionBytes": str(scan_partition_mb * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.parquet.filterPushdown": "true",
    }


def build_session(master: str | None = None, app: str = "tabscore",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the settings the library relies on.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        settings.update(LOCAL_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spark_context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session (which has none)."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect raises here
        return None


def is_local(spark: SparkSession) -> bool:
    sc = spark_context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return str(master).startswith("local")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabscore`` importable in Python workers (as ``--py-files`` would).

    Python work on executors (``mapInPandas`` scoring) unpickles references
    to this package; a worker only sees what was installed on it or shipped
    with the job.  The package is zipped once per process and added to the
    application once; Spark serves the file to every executor.
    """
    sc = spark_context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    import zipfile
    import tabscore
    package = os.path.dirname(os.path.abspath(tabscore.__file__))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="tabscore-pyfiles-"), "tabscore.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(package):
            for name in names:
                if name.endswith((".py", ".sql")):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Streaming checkpoints, lineage cuts and job outputs that must survive a
    lost executor live here.  A folder of our own is only chosen when the
    setting is unset on a ``local[...]`` master (tests); on a cluster an unset
    value is an error rather than a machine-local folder.
    """
    sc = spark_context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: streaming checkpoints "
                               "and intermediate outputs must survive a lost executor")
        root = tempfile.mkdtemp(prefix="tabscore-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the checkpoint root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
