"""Scoring streams with the batch functions.

* ``score_stream``: a streaming DataFrame of feature rows goes through the
  same :func:`tabscore.operators.scoring.score` as a batch one.
* Request streams carry ``{"request_id": .., "records": [{...}, ...]}`` per
  line.  ``reply`` keeps one output row per request and adds ``prediction``
  inside each record with ``transform`` (no explode, no shuffle);
  ``reply_rows`` is the row form (``posexplode``).  Lines that are not JSON
  or have no ``records`` are routed to ``rejects`` instead of vanishing.

Every query writes with a checkpoint under the session's checkpoint root, so
a restarted driver or lost executor resumes from the last committed batch;
``foreachBatch`` sinks get ``(batch_df, batch_id)`` and must be idempotent
per batch id.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.linear import LinearModel, margin, predicted_label
from tabscore.operators.scoring import score
from tabscore.session import scratch_path, spark_context


def score_stream(stream: DataFrame, model: LinearModel, **kwargs) -> DataFrame:
    """Same contract as batch ``score``: input columns + ``prediction``."""
    return score(stream, model, **kwargs)


def request_schema(record: T.StructType, id_field: str = "request_id") -> T.StructType:
    return T.StructType([
        T.StructField(id_field, T.LongType(), True),
        T.StructField("records", T.ArrayType(record, True), True),
        T.StructField("_corrupt_record", T.StringType(), True),
    ])


def read_requests(spark: SparkSession, path: str, record: T.StructType,
                  id_field: str = "request_id", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(request_schema(record, id_field)).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def parse_requests(messages: DataFrame, record: T.StructType, value_col: str = "value",
                   id_field: str = "request_id") -> DataFrame:
    """Requests from a column of JSON strings (a message bus ``value``, cast to string).

    Same shape as :func:`read_requests`: a line that is not JSON keeps its
    text in ``_corrupt_record`` and has no ``records``, so :func:`rejects`
    routes it instead of dropping it.
    """
    schema = request_schema(record, id_field)
    body = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    raw = F.col(value_col).cast("string")
    parsed = F.from_json(raw, body, {"mode": "PERMISSIVE"})
    ok = parsed.isNotNull() & F.coalesce(F.trim(raw).startswith("{"), F.lit(False))
    return messages.select(
        F.when(ok, parsed[id_field]).alias(id_field),
        F.when(ok, parsed["records"]).alias("records"),
        F.when(~ok, raw).alias("_corrupt_record"))


def replies_as_json(replies: DataFrame, id_field: str = "request_id") -> DataFrame:
    """``key`` = request id, ``value`` = ``{"predictions": [...]}`` (ready for a message sink)."""
    return replies.select(F.col(id_field).cast("string").alias("key"),
                          F.to_json(F.struct(F.col("predictions").alias("predictions"))).alias("value"))


def reply(requests: DataFrame, model: LinearModel, id_field: str = "request_id",
          threshold: float = 0.5) -> DataFrame:
    """request_id + predictions: each record with ``prediction`` appended.

    A record with a NULL or NaN feature gets a NULL prediction: the stream
    and the request's other records go on.
    """
    record_type = requests.schema["records"].dataType.elementType
    names = [f.name for f in record_type.fields]
    missing = [f for f in model.features if f not in names]
    if missing:
        raise ValueError(f"records lack feature fields {missing}")

    def one(r):
        inputs = {f: r[f] for f in model.features}
        m = margin(model, inputs)      # NULL or NaN exactly when a feature is
        pred = F.when(m.isNotNull() & ~F.isnan(m), predicted_label(m, threshold).cast("double"))
        return F.struct(*[r[n].alias(n) for n in names], pred.alias("prediction"))

    good = requests.where(F.col("records").isNotNull())
    return good.select(id_field, F.transform("records", one).alias("predictions"))


def reply_rows(replies: DataFrame, id_field: str = "request_id") -> DataFrame:
    """One row per record: request id, position in the request, record fields + prediction."""
    return (replies.select(id_field, F.posexplode("predictions").alias("pos", "p"))
                   .select(id_field, F.col("pos").cast("bigint").alias("pos"), "p.*"))


def rejects(requests: DataFrame, id_field: str = "request_id") -> DataFrame:
    """Requests without a ``records`` list (including lines that are not JSON)."""
    return requests.where(F.col("records").isNull()).select(
        id_field, F.when(F.col("_corrupt_record").isNotNull(), F.lit("not json"))
                   .otherwise(F.lit("no records")).alias("reason"), "_corrupt_record")


def run_available_now(df: DataFrame, path: str | None = None, fmt: str = "parquet",
                      checkpoint: str | None = None,
                      foreach_batch: Callable[[DataFrame, int], None] | None = None,
                      name: str = "stream") -> str:
    """Process everything available, then stop; returns the output path."""
    spark = df.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if foreach_batch is not None:
        writer = writer.foreachBatch(foreach_batch)
    else:
        path = path or scratch_path(spark, f"{name}-out")
        writer = writer.format(fmt).option("path", path)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return path


def _query_id(batch: DataFrame) -> str | None:
    """The id of the stream that is running this batch (the same after a restart from its checkpoint)."""
    sc = spark_context(batch.sparkSession)
    return sc.getLocalProperty("sql.streaming.queryId") if sc is not None else None


def idempotent_batch_sink(output_path: str, run_log=None, fmt: str = "parquet",
                          query_name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function writing batch N to ``output_path/batch_id=N``.

    A replayed batch (after a driver restart the last uncommitted batch runs
    again) overwrites its own folder instead of appending twice.  The row
    count is observed during the write and, if a run log is given, committed
    to it as ``rows:<query_name>:<batch_id>`` under the batch's own key
    (query id and batch id), so that a replay replaces it as well: outputs
    and log rows stay one to one however often the stream was killed.
    """
    from tabscore.operators.profile import observed

    def sink(batch: DataFrame, batch_id: int) -> None:
        counted, obs = observed(batch)
        counted.write.mode("overwrite").format(fmt).save(f"{output_path}/batch_id={batch_id}")
        if run_log is not None:
            with run_log.together(commit=f"{_query_id(batch) or query_name}-{batch_id}"):
                run_log.log_metrics({f"rows:{query_name}:{batch_id}": obs.get["rows"]})

    return sink


def _stream_path(path: str) -> str:
    """File sources watch folders; a single file becomes a glob that matches only it."""
    if os.path.isfile(path):
        return f"{path[:-1]}[{path[-1]}]"
    return path


def stream_from_table(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                      fmt: str = "parquet") -> DataFrame:
    """A Parquet folder (or file) read as a stream, schema taken from the batch reader."""
    schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(_stream_path(path))

