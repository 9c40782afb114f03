"""Registered queries: each reads the given tables and returns a DataFrame.

Every query has a DuckDB twin in ``oracle.ORACLE`` (same column names, same
arithmetic order, doubles rounded to 6 places where exp/avg/std occur),
except ``random_sample``, a Bernoulli draw that only Spark can repeat.

Fixed values: the models below are given parameters, as a registry would
hand them out; their features are columns of the test tables.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.linear import LinearModel
from tabscore.operators import metrics, multi, profile, runlog, sampling, scaling, scoring, validate
from tabscore.operators.pyscore import LinearPredictor, score_with_predictor, score_with_udf
from tabscore.plans import jobs
from tabscore.session import scratch_path
from tabscore.sources import files, sql_extract
from tabscore.streaming import scoring as streaming

# ------------------------------------------------------------------ fixed values
EVENTS_MODEL = LinearModel(("value", "user_id"), (1.3, -0.45), -0.2,
                           (50.0, 75.0), (50.0, 43.0), "events_a", "v1")
EVENTS_MODEL_B = LinearModel(("value", "user_id"), (-0.8, 0.6), 0.35,
                             (48.0, 70.0), (45.0, 40.0), "events_b", "v3")
EVENTS_MODEL_C = LinearModel(("value",), (2.1,), -1.1, (30.0,), (25.0,), "events_c", "v2")
DOC_MODEL = LinearModel(("n_chars",), (1.5,), 0.8, (2000.0,), (1000.0,), "doc_quality", "v1")
DOC_TEXT_MODEL = LinearModel(("n_chars", "n_lines"), (1.2, -0.7), 0.9, (2000.0, 40.0), (1500.0, 30.0),
                             "doc_text", "v1")
DOC_MODEL_B = LinearModel(("n_chars",), (-0.9,), 1.4, (2500.0,), (800.0,), "doc_short", "v2")
DOC_NEVER = LinearModel(("n_chars",), (0.1,), -50.0, (2000.0,), (1000.0,), "doc_never", "v1")
LINEITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_MODEL = LinearModel(LINEITEM_FEATURES, (0.9, -0.35, 1.8, -0.6), 0.15,
                             (25.5, 38000.0, 0.05, 0.04), (14.4, 23000.0, 0.032, 0.026),
                             "lineitem_risk", "v1")
# a 64-weight model over embeddings.embedding, generated by a rule
EMBED_DIM = 64
EMBED_MODEL = LinearModel(tuple(f"e{i}" for i in range(EMBED_DIM)),
                          tuple(((i * 37) % 17 - 8) / 10.0 for i in range(EMBED_DIM)), -0.1,
                          name="embedding_linear", version="v1")
THRESHOLD = 0.7
RUN_TS = _dt.datetime(2024, 2, 1, 12, 0, 0)
SPLIT_FRACTION = 0.2
SPLIT_SEED = 42
SAMPLE_FRACTION = 0.25
SAMPLE_SEED = 7
TRAIN_WINDOW = ("1996-01-01", "1997-12-31")
ORDER_DONE = "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN NULL ELSE 0 END"
SCORING_DAY = "1997-03-15"
STATUS_REQUEST = ("events_a", "events_b", "no_such_model", "events_c")
REQUEST_SIZE = 8
# error events carry no value (NULL); readings above 250 are treated as a failed sensor (NaN)
INVALID_VALUE = ("CASE WHEN event_type = 'error' THEN NULL "
                 "WHEN value > 250.0 THEN CAST('NaN' AS DOUBLE) ELSE value END")
REPORT_SPEC = [("event_id", "int64"), ("value", "float64"), ("user_id", "int32"),
               ("score", "float64"), ("ts", "datetime64[ns]"), ("props", "object", False),
               ("label", None, False)]
# -------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Register the table as a temp view with a library prefix; return its name."""
    vname = f"tabscore_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(vname)
    return vname


def events_with_invalid(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("value", F.expr(INVALID_VALUE))


def labelled_documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


class WholeRowPredictor(LinearPredictor):
    """The same model as a predictor that does not say which columns it reads; its schema says which must be there."""

    def __init__(self, model: LinearModel):
        super().__init__(model)
        del self.features


# ---------------------------------------------------------------- queries


def q_training_extract(spark, sf_dir):
    t = view(spark, sf_dir, "lineitem")
    return sql_extract.training_extract(spark, t, LINEITEM_FEATURES, "l_linenumber", "l_shipdate",
                                        TRAIN_WINDOW[0], TRAIN_WINDOW[1], SAMPLE_FRACTION,
                                        ["l_orderkey", "l_linenumber"])


def q_scoring_extract(spark, sf_dir):
    t = view(spark, sf_dir, "orders")
    return sql_extract.scoring_extract(spark, t, "o_orderkey", ["o_totalprice", "o_custkey"],
                                       "o_orderdate", SCORING_DAY)


def q_keyed_sample(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return sampling.keyed_sample(df, SAMPLE_FRACTION, "o_orderkey", SAMPLE_SEED)


def q_filter_project(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return (df.filter(F.col("c_acctbal") > 1000.0)
              .drop("c_comment_not_present", "c_mktsegment")
              .select("c_custkey", "c_name", "c_acctbal"))


def q_exact_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    _, test = sampling.split_exact(df, SPLIT_FRACTION, "o_orderkey", SPLIT_SEED)
    return test


def q_split_sizes(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    _, cut = sampling.exact_cut(df, SPLIT_FRACTION, "o_orderkey", SPLIT_SEED)
    # both sides counted in one pass over the key column
    sizes = df.agg(F.count_if(~cut).alias("train"), F.count_if(cut).alias("test"))
    return sizes.select(F.inline(F.array(
        F.struct(F.lit("train").alias("side"), F.col("train").alias("rows")),
        F.struct(F.lit("test").alias("side"), F.col("test").alias("rows")))))


def q_approx_split(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    _, test = sampling.split_approx(df, SPLIT_FRACTION, "event_id", SPLIT_SEED)
    return test


def q_scaler_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    fit = scaling.scaler_table(df, LINEITEM_FEATURES)
    return fit.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "scale")])


def q_scaler_transform(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    params = scaling.fit_scaler(df, LINEITEM_FEATURES)
    out = scaling.transform(df.select("l_orderkey", "l_linenumber", *LINEITEM_FEATURES), params)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in LINEITEM_FEATURES])


def q_score_linear(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return scoring.score(df, EVENTS_MODEL)


def q_score_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return scoring.score(df, LINEITEM_MODEL).select("l_orderkey", "l_linenumber", "prediction")


def q_score_lineitem_python(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    # whole rows through Python: the predictor does not name its features (score_lineitem_udf: it does)
    scored = score_with_predictor(df, WholeRowPredictor(LINEITEM_MODEL),
                                  columns=["l_orderkey", "l_linenumber", *LINEITEM_FEATURES])
    return scored.select("l_orderkey", "l_linenumber", "prediction")


def q_score_wide(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return scoring.score_vector(df, EMBED_MODEL, "embedding").drop("embedding")


def q_score_documents(spark, sf_dir):
    from tabscore.functions.text import line_count
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", line_count("text").alias("n_lines"))
    return scoring.score_proba(docs, DOC_TEXT_MODEL, label_col="prediction", probability_col="probability",
                               digits=6)


def q_score_lineitem_udf(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    scored = score_with_udf(df, LinearPredictor(LINEITEM_MODEL), LINEITEM_FEATURES)
    return scored.select("l_orderkey", "l_linenumber", "prediction")


def q_score_threshold(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return scoring.shape_output(df, EVENTS_MODEL, id_col="event_id", threshold=THRESHOLD,
                                label_col="is_positive", probability_col="p_positive",
                                timestamp_col="scored_at", run_timestamp=RUN_TS)


def q_score_python(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return score_with_predictor(df, LinearPredictor(EVENTS_MODEL), columns=["event_id", "user_id", "value"])


def q_score_skip_invalid(spark, sf_dir):
    df = events_with_invalid(spark, sf_dir).select("event_id", "user_id", "value")
    return scoring.score(df, EVENTS_MODEL, on_invalid="skip")


def q_score_null_invalid(spark, sf_dir):
    df = events_with_invalid(spark, sf_dir).select("event_id", "user_id", "value")
    return scoring.score(df, EVENTS_MODEL, on_invalid="null")


def q_quarantine_counts(spark, sf_dir):
    return validate.quarantine_counts(events_with_invalid(spark, sf_dir), EVENTS_MODEL.features)


def q_quarantine_rows(spark, sf_dir):
    _, bad = validate.quarantine(events_with_invalid(spark, sf_dir), EVENTS_MODEL.features)
    return bad.select("event_id", "user_id", "reject_reason")


def q_validate_report(spark, sf_dir):
    df = events_with_invalid(spark, sf_dir)
    return validate.InputSchema(REPORT_SPEC, strict=True).report(df)


def q_evaluate_binary(spark, sf_dir):
    m = metrics.evaluate(labelled_documents(spark, sf_dir), DOC_MODEL, label="quality")
    return m.select("n", "tp", "fp", "fn", "tn",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_evaluate_many(spark, sf_dir):
    m = metrics.evaluate_many(labelled_documents(spark, sf_dir), [DOC_MODEL, DOC_NEVER, DOC_MODEL_B], "quality").drop("invalid")
    return m.select("model_name", "model_version", "n", "tp", "fp", "fn", "tn",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_evaluate_positional(spark, sf_dir):
    # the declared feature name is absent: the non-label column is used in its place
    data = labelled_documents(spark, sf_dir).select(F.col("n_chars").alias("length"), "quality")
    m = metrics.evaluate(data, DOC_MODEL, label="quality")
    return m.select("n", "tp", "fp", "fn", "tn",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_random_sample(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.random_sample(df, SAMPLE_FRACTION, SAMPLE_SEED)


def q_evaluate_no_positives(spark, sf_dir):
    m = metrics.evaluate(labelled_documents(spark, sf_dir), DOC_NEVER, label="toxic")
    return m.select("n", "tp", "fp", "fn", "tn",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_describe_numeric(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "lineitem"), LINEITEM_FEATURES, exact=True)


def q_value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


def q_head_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return profile.head(df, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


def q_not_null_check(spark, sf_dir):
    scored = scoring.score(events_with_invalid(spark, sf_dir), EVENTS_MODEL, on_invalid="null")
    return profile.null_count(scored, "prediction")


def q_score_many(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return multi.score_many(df, [EVENTS_MODEL, EVENTS_MODEL_B, EVENTS_MODEL_C], ["event_id"])


def q_score_ensemble(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return multi.score_ensemble(df, [EVENTS_MODEL, EVENTS_MODEL_B, EVENTS_MODEL_C], ["event_id"])


def q_model_status(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return multi.model_status(df, [EVENTS_MODEL, EVENTS_MODEL_B, EVENTS_MODEL_C], STATUS_REQUEST)


def q_runlog_current(spark, sf_dir):
    # events read as a run log: run = user, key = event type, seq = event id
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", "ts",
        F.col("event_id").alias("seq"))
    return runlog.latest_per_key(log, ["run_id", "key"], ["value", "seq"], ["ts", "seq"])


def q_latest_version(spark, sf_dir):
    # events read as a registry: model = event type, version = event id, accuracy = value
    reg = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_name"), F.col("event_id").alias("version"),
        F.col("ts").alias("registered_at"), F.col("value").alias("accuracy"))
    out = runlog.latest_versions(reg, ["model_name"], "version", "registered_at", ["accuracy"])
    return out.select("model_name", "version", "accuracy")


def q_batch_score_job(spark, sf_dir):
    out = scratch_path(spark, "score-job")
    _, rows = jobs.score_job(spark, EVENTS_MODEL, input_path=os.path.join(sf_dir, "events.parquet"),
                             output_path=out + ".parquet")
    return spark.read.parquet(out + ".parquet").select("event_id", "user_id", "value", "prediction")


def q_stream_score(spark, sf_dir):
    stream = streaming.stream_from_table(spark, os.path.join(sf_dir, "events.parquet"))
    scored = streaming.score_stream(stream.select("event_id", "user_id", "value"), EVENTS_MODEL)
    path = streaming.run_available_now(scored, name="stream-score")
    return spark.read.parquet(path)


def q_stream_batch_sink(spark, sf_dir):
    stream = streaming.stream_from_table(spark, os.path.join(sf_dir, "events.parquet"))
    scored = streaming.score_stream(stream.select("event_id", "user_id", "value"), EVENTS_MODEL)
    out = scratch_path(spark, "stream-batches")
    streaming.run_available_now(scored, foreach_batch=streaming.idempotent_batch_sink(out), name="stream-batches")
    return spark.read.parquet(out).select("event_id", "user_id", "value", "prediction")


RECORD = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                       T.StructField("value", T.DoubleType())])


def write_requests(spark, sf_dir, events: DataFrame | None = None) -> str:
    """Group events into JSON request lines of REQUEST_SIZE records (Spark job).

    ``event_id`` is unique, so each request group holds at most REQUEST_SIZE
    rows by construction: the collect is bounded.
    """
    ev = events if events is not None else table(spark, sf_dir, "events")
    reqs = (ev.select(F.floor(F.col("event_id") / REQUEST_SIZE).cast("bigint").alias("request_id"),
                      F.struct("event_id", "user_id", "value").alias("r"))
              .groupBy("request_id").agg(F.sort_array(F.collect_list("r")).alias("records")))
    path = scratch_path(spark, "requests")
    reqs.write.json(path)
    return path


def q_stream_requests(spark, sf_dir):
    src = write_requests(spark, sf_dir)
    replies = streaming.reply(streaming.read_requests(spark, src, RECORD), EVENTS_MODEL)
    path = streaming.run_available_now(streaming.reply_rows(replies), name="stream-requests")
    return spark.read.parquet(path)


def q_csv_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer") + ".csv"
    files.write_file(df, path)
    return files.read_file(spark, path, schema=df.schema)


def q_parquet_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer") + ".parquet"
    files.write_output(df, path=path)
    return files.load_input(spark, path=path)


def q_json_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    path = scratch_path(spark, "part") + ".jsonl"
    files.write_file(df, path)
    return files.read_file(spark, path, schema=df.schema)


def q_table_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    name = f"tabscore_customer_{uuid.uuid4().hex[:10]}"
    files.write_output(df, table=name)
    return files.load_input(spark, table=name)


def q_train_logistic(spark, sf_dir):
    from tabscore.operators.logistic import fit_logistic
    data = labelled_documents(spark, sf_dir)
    params = scaling.fit_scaler(data, ["n_chars"])
    model = fit_logistic(scaling.transform(data, params), ["n_chars"], "quality", max_iter=200, tol=1e-10)
    rows = [("intercept", model.intercept)] + list(zip(model.features, model.coefficients))
    terms = F.array(*[F.struct(F.lit(k).alias("term"), F.round(F.lit(float(v)), 6).alias("value"))
                      for k, v in rows])
    # one row per term, anchored on the data the fit read
    return data.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(terms))


def _wide_terms(spark, sf_dir, solver: str, digits: int) -> DataFrame:
    """A fit on all 64 elements of the embedding: is the label in the upper half?"""
    from tabscore.operators.logistic import fit_logistic
    data = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("target"))
    model = fit_logistic(data, EMBED_MODEL.features, "target", vector="embedding", max_iter=500, tol=1e-10, solver=solver)
    rows = [("intercept", model.intercept)] + list(zip(model.features, model.coefficients))
    terms = F.array(*[F.struct(F.lit(k).alias("term"), F.round(F.lit(float(v)), digits).alias("value")) for k, v in rows])
    return data.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(terms))


def q_train_wide(spark, sf_dir):
    return _wide_terms(spark, sf_dir, "newton", 5)


def q_train_wide_lbfgs(spark, sf_dir):
    return _wide_terms(spark, sf_dir, "lbfgs", 5)


def q_train_wide_mllib(spark, sf_dir):
    return _wide_terms(spark, sf_dir, "mllib", 3)


def q_train_job(spark, sf_dir):
    data = labelled_documents(spark, sf_dir)
    res = jobs.train_job(data, ["n_chars"], "quality", "doc_id", max_iter=200, tol=1e-10,
                         name="doc_quality", version="train-job")
    m = res.metrics
    return data.agg(F.count(F.lit(1)).alias("n")).select(
        "n", *[F.round(F.lit(float(m[k])), 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def _train_metrics(data: DataFrame, res) -> DataFrame:
    return data.agg(F.count(F.lit(1)).alias("n")).select(
        "n", *[F.round(F.lit(float(res.metrics[k])), 6).alias(k) for k in METRICS])


def q_train_from_config(spark, sf_dir):
    """Settings from a nested config, defaults for what it leaves out."""
    data = labelled_documents(spark, sf_dir)
    return _train_metrics(data, jobs.train_from_config(data, ["n_chars"], "quality", "doc_id",
                                                       {"test_size": 0.2, "hyperparameters": {"max_iter": 200, "tol": 1e-10}}))


def q_train_own_function(spark, sf_dir):
    """A user's training function: the cut is the mean length of the good documents, a third of it."""
    def fit(train, features, label):
        mean = train.where(F.col(label) == 1).agg(F.avg(features[0])).first()[0]
        return LinearModel(tuple(features), (1.0,), -mean / 3)

    data = labelled_documents(spark, sf_dir)
    return _train_metrics(data, jobs.train_job(data, ["n_chars"], "quality", "doc_id", fit=fit, version="own"))


def q_train_from_extract(spark, sf_dir):
    """Straight from the SQL extract of a table: orders of a window, finished ones against the others."""
    table(spark, sf_dir, "orders").withColumn("done", F.expr(ORDER_DONE)).createOrReplaceTempView("tabscore_orders_done")
    res = jobs.train_from_extract(spark, "tabscore_orders_done", ["o_totalprice"], "done", "o_orderdate", *TRAIN_WINDOW,
                                  "o_orderkey", config={"hyperparameters": {"max_iter": 200, "tol": 1e-10}})
    rows = res.sizes
    return spark.createDataFrame([(rows["rows_in"], rows["train"], rows["test"])], "n bigint, train bigint, test bigint").select(
        "*", *[F.round(F.lit(float(res.metrics[k])), 6).alias(k) for k in METRICS])


def q_train_and_score(spark, sf_dir):
    # fit on the labelled documents, then score every document with the fitted model
    res = jobs.train_job(labelled_documents(spark, sf_dir), ["n_chars"], "quality", "doc_id",
                         max_iter=200, tol=1e-10, name="doc_quality_fit", version="train-and-score")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return scoring.score_proba(docs, res.model, label_col="prediction", probability_col="probability",
                               digits=6).select("doc_id", "prediction", "probability")


# ---------------------------------------------------------------- invalid rows, jobs and stores

EVENTS_MODELS = [EVENTS_MODEL, EVENTS_MODEL_B, EVENTS_MODEL_C]
SCORED = ["event_id", "user_id", "value"]
# every tenth document lacks its length, another tenth its label
HOLED_CHARS = "CASE WHEN doc_id % 10 = 3 THEN NULL ELSE n_chars END"
HOLED_LABEL = "CASE WHEN doc_id % 10 = 7 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 10 = 8 THEN NULL " \
              "ELSE CAST(quality AS DOUBLE) END"
# a number doubles cannot hold, missing where the event failed
# returned items carry a NaN, open ones no risk at all
HOLED_RISK = "CASE WHEN l_returnflag = 'R' THEN CAST('NaN' AS DOUBLE) WHEN l_returnflag = 'N' THEN NULL ELSE l_discount END"
BIG_ID = "CASE WHEN event_type = 'error' THEN NULL ELSE event_id + 9007199254740993 END"
HOLED_NOTE = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE text END"
METRICS = ("accuracy", "precision", "recall", "f1")


def holed_documents(spark, sf_dir) -> DataFrame:
    return labelled_documents(spark, sf_dir).select(
        "doc_id", F.expr(HOLED_CHARS).alias("n_chars"), F.expr(HOLED_LABEL).alias("quality"))


def q_score_python_invalid(spark, sf_dir):
    return score_with_predictor(events_with_invalid(spark, sf_dir), LinearPredictor(EVENTS_MODEL),
                                columns=SCORED, on_invalid="null")


def q_predictor_whole_row_invalid(spark, sf_dir):
    """Whole rows through a predictor by policy; numbers beyond doubles, NULL and NaN come back unchanged."""
    rows = events_with_invalid(spark, sf_dir).select(*SCORED, F.expr(BIG_ID).alias("big_id"))
    null, skip = (score_with_predictor(rows, WholeRowPredictor(EVENTS_MODEL), on_invalid=p).withColumn("policy", F.lit(p))
                  for p in ("null", "skip"))
    return null.unionByName(skip)


def q_training_extract_nan_label(spark, sf_dir):
    """A floating label that is NULL for some rows and NaN for others: only labelled rows are extracted."""
    rows = table(spark, sf_dir, "lineitem").withColumn("risk", F.expr(HOLED_RISK))
    rows.createOrReplaceTempView("tabscore_lineitem_risk")
    return sql_extract.training_extract(spark, "tabscore_lineitem_risk", LINEITEM_FEATURES, "risk", "l_shipdate", *TRAIN_WINDOW)


def q_evaluate_many_invalid(spark, sf_dir):
    return metrics.evaluate_many(holed_documents(spark, sf_dir), [DOC_MODEL, DOC_MODEL_B], "quality",
                                 on_invalid="skip").select(
        "model_name", "model_version", "n", "tp", "fp", "fn", "tn", "invalid", *[F.round(c, 6).alias(c) for c in METRICS])


USER_MODEL = LinearModel(("user_id",), (0.7,), -0.1, (75.0,), (43.0,), "events_user", "v1")


def q_score_models_job_invalid(spark, sf_dir):
    """Statuses of a model that meets invalid rows, one that does not and an unknown one, under each policy."""
    src = scratch_path(spark, "models-in") + ".parquet"
    events_with_invalid(spark, sf_dir).select(*SCORED).write.parquet(src)
    store = model_store(spark, [EVENTS_MODEL, USER_MODEL])
    rows = []
    for policy in ("error", "skip", "null"):
        out = scratch_path(spark, "models-out")
        found = jobs.score_models_job(spark, store, ["events_a", "events_user", "ghost"], keep=["event_id"], input_path=src,
                                      output_path=out, on_invalid=policy)
        written = {r[0]: r[1] for r in spark.read.parquet(out).groupBy("model_name").count().collect()}
        rows += [(policy, name, s["status"], s.get("rows"), s.get("positives"), s.get("invalid"), written.get(name, 0))
                 for name, s in found.items()]
    return spark.createDataFrame(rows, "policy string, model_name string, status string, rows bigint, positives bigint, "
                                       "invalid bigint, written bigint")


def q_score_udf_invalid(spark, sf_dir):
    return score_with_udf(events_with_invalid(spark, sf_dir).select(SCORED), LinearPredictor(EVENTS_MODEL),
                          EVENTS_MODEL.features, on_invalid="skip")


def q_score_many_invalid(spark, sf_dir):
    return multi.score_many(events_with_invalid(spark, sf_dir), EVENTS_MODELS, ["event_id"], on_invalid="null")


def q_score_ensemble_invalid(spark, sf_dir):
    return multi.score_ensemble(events_with_invalid(spark, sf_dir), EVENTS_MODELS, ["event_id"], on_invalid="skip")


def q_model_status_invalid(spark, sf_dir):
    return multi.model_status(events_with_invalid(spark, sf_dir), EVENTS_MODELS, STATUS_REQUEST)


def q_stream_reply_invalid(spark, sf_dir):
    src = write_requests(spark, sf_dir, events_with_invalid(spark, sf_dir))
    replies = streaming.reply(streaming.read_requests(spark, src, RECORD), EVENTS_MODEL)
    return spark.read.parquet(streaming.run_available_now(streaming.reply_rows(replies), name="stream-invalid"))


def q_stream_rejects(spark, sf_dir):
    """Failed events send broken lines; users divisible by 3 send requests without records."""
    sent = table(spark, sf_dir, "events").select(F.expr("""
        CASE WHEN event_type = 'error' THEN concat('broken ', event_id)
             WHEN user_id % 3 = 0 THEN to_json(named_struct('request_id', event_id))
             ELSE to_json(named_struct('request_id', event_id,
                                       'records', array(named_struct('event_id', event_id, 'value', value)))) END
        """).alias("value"))
    return streaming.rejects(streaming.parse_requests(sent, RECORD))


def q_flagged_rows(spark, sf_dir):
    return validate.flag_invalid(events_with_invalid(spark, sf_dir), EVENTS_MODEL.features).select(
        "event_id", "reject_reason", "is_valid")


def q_evaluate_invalid(spark, sf_dir):
    m = metrics.evaluate(holed_documents(spark, sf_dir), DOC_MODEL, label="quality", on_invalid="skip")
    return m.select("n", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in METRICS])


def q_train_job_invalid(spark, sf_dir):
    data = holed_documents(spark, sf_dir)
    res = jobs.train_job(data, ["n_chars"], "quality", "doc_id", max_iter=200, tol=1e-10,
                         name="doc_quality", version="train-invalid", on_invalid="skip")
    return data.agg(F.count("*").alias("n")).select(
        "n", *[F.lit(int(v)).cast("bigint").alias(k) for k, v in sorted(res.sizes.items())],
        *[F.round(F.lit(float(res.metrics[k])), 6).alias(k) for k in METRICS])


def q_exact_split_sides(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    train, test = sampling.split_exact(df, SPLIT_FRACTION, "o_orderkey", SPLIT_SEED)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def q_approx_split_sides(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    train, test = sampling.split_approx(df, SPLIT_FRACTION, "event_id", SPLIT_SEED)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def q_csv_text_roundtrip(spark, sf_dir):
    """Every whole text with its line breaks and quotes, and a second column with empty and missing ones."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(HOLED_NOTE).alias("note"), "lang")
    path = scratch_path(spark, "texts") + ".csv"
    files.write_file(df, path, null_value="\\N")
    return files.read_file(spark, path, schema=df.schema, null_value="\\N")


def q_path_over_table(spark, sf_dir):
    """With a path and a table name the path is written and read, and no table is made."""
    df = table(spark, sf_dir, "customer")
    path, name = scratch_path(spark, "customer") + ".parquet", f"tabscore_unused_{uuid.uuid4().hex[:10]}"
    files.write_output(df, path=path, table=name)
    back = files.load_input(spark, path=path, table=name)
    return back.select("c_custkey", "c_name", F.lit(spark.catalog.tableExists(name)).alias("table_made"))


def q_runlog_roundtrip(spark, sf_dir):
    """Events as the rows of a stored run log: failed ones are artifacts, the others metrics."""
    path = scratch_path(spark, "runlog")
    table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type") == "error", "artifact").otherwise("metric").alias("kind"),
        F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts")).write.parquet(path)
    return runlog.RunLog(spark, path).current()


def model_store(spark, models) -> runlog.ModelStore:
    store = runlog.ModelStore(spark, scratch_path(spark, "models"), "events")
    for day, model in enumerate(models, 1):
        store.save(model, {"accuracy": 0.5}, registered_at=_dt.datetime(2024, 1, day))
    return store


def q_registry_roundtrip(spark, sf_dir):
    """The later of two saved versions comes back and scores as the model that was saved."""
    store = model_store(spark, [replace(EVENTS_MODEL_B, name="events_a", version="v0"), EVENTS_MODEL])
    return scoring.score(table(spark, sf_dir, "events").select(SCORED), store.load("events_a", "latest"))


def q_describe_sketch(spark, sf_dir):
    """The sketch's profile: its moments, and whether each quantile's rank is within the error that is allowed."""
    df = table(spark, sf_dir, "lineitem").select(*LINEITEM_FEATURES)
    rows = profile.describe(df, exact=False, digits=None).collect()
    share = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    asked = [(r.column_name, r.statistic, r.value) for r in rows if r.statistic in share]
    ranks = df.agg(*[F.array(F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v), F.count(c)) for c, _, v in asked]).first()
    near = {}
    for (c, s, _), (below, upto, n) in zip(asked, ranks):
        near[c, s] = below / n <= share[s] + profile.RANK_ERROR and upto / n >= share[s] - profile.RANK_ERROR
    out = [(r.column_name, r.statistic, None if r.statistic in share else r.value, near.get((r.column_name, r.statistic)))
           for r in rows]
    return spark.createDataFrame(out, "column_name string, statistic string, value double, within boolean").withColumn(
        "value", F.round("value", 6))


def q_random_sample_law(spark, sf_dir):
    """What holds for every Bernoulli sample: rows of the table, none twice, about the share asked for, all at 1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    sample = sampling.random_sample(orders, SAMPLE_FRACTION, SAMPLE_SEED)
    counted = sample.groupBy("o_orderkey").agg(F.count("*").alias("times"))
    both = orders.withColumn("rows", F.lit(1)).join(counted, "o_orderkey", "full_outer")
    law = both.agg(F.count("rows").alias("n"), F.coalesce(F.sum("times"), F.lit(0)).alias("drawn"),
                   F.count_if(F.col("rows").isNull()).alias("strangers"), F.count_if(F.col("times") > 1).alias("repeats"))
    spread = 6 * F.sqrt(F.col("n") * SAMPLE_FRACTION * (1 - SAMPLE_FRACTION))
    whole = sampling.random_sample(orders, 1.0, SAMPLE_SEED).count()
    return law.select("n", "strangers", "repeats", (F.abs(F.col("drawn") - F.col("n") * SAMPLE_FRACTION) <= spread).alias("near_share"),
                      F.lit(whole).cast("bigint").alias("drawn_of_all"))


def q_daily_score_replay(spark, sf_dir):
    """A table scored day by day, then one day scored anew, twice, with another model: the other days stay."""
    src, out = (scratch_path(spark, n) + ".parquet" for n in ("daily-in", "daily-out"))
    table(spark, sf_dir, "events").select(*SCORED, F.to_date("ts").alias("day")).write.partitionBy("day").parquet(src)
    jobs.score_job(spark, EVENTS_MODEL, input_path=src, output_path=out, partition_by=["day"])
    first = spark.read.parquet(src).agg(F.min("day")).first()[0]
    for _ in range(2):
        jobs.score_day_job(spark, EVENTS_MODEL_B, date_column="day", day=first, input_path=src, output_path=out)
    return spark.read.parquet(out).select(*SCORED, F.col("day").cast("string").alias("day"), "prediction")


def q_registry_conflict(spark, sf_dir):
    """For each event type two writers save version v1 at the same moment, with its mean and with its largest value."""
    from concurrent.futures import ThreadPoolExecutor
    store = runlog.ModelStore(spark, scratch_path(spark, "race"), "events")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value"), F.max("value")).collect()

    def save(kind, weight) -> int:
        try:
            store.save(LinearModel(("value",), (weight,), name=kind, version="v1"))
            return 0
        except ValueError:
            return 1

    with ThreadPoolExecutor(2) as pool:
        conflicts = [(kind, sum(pool.map(save, [kind] * 2, weights))) for kind, *weights in kinds]
    found = spark.createDataFrame(conflicts, "model_name string, conflicts bigint")
    return store.versions().groupBy("model_name").agg(F.count("*").alias("rows")).join(found, "model_name")


def q_runlog_compacted(spark, sf_dir):
    """The state of a log that was compacted halfway, and once more after later commits."""
    path = scratch_path(spark, "runlog-compacted")
    log = runlog.RunLog(spark, path)
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type") == "error", "artifact").otherwise("metric").alias("kind"),
        F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    for part in range(3):
        rows.where(F.col("seq") % 3 == part).write.parquet(f"{path}/commit=part-{part}")
        if part < 2:
            log.compact()
    return log.current()


def q_score_models_job(spark, sf_dir):
    out = scratch_path(spark, "models-job")
    jobs.score_models_job(spark, model_store(spark, EVENTS_MODELS), STATUS_REQUEST, keep=["event_id"],
                          input_path=os.path.join(sf_dir, "events.parquet"), output_path=out)
    return spark.read.parquet(out)


def q_observed_rows(spark, sf_dir):
    out = scratch_path(spark, "observed") + ".parquet"
    _, rows = jobs.score_job(spark, EVENTS_MODEL, input_path=os.path.join(sf_dir, "events.parquet"), output_path=out)
    return spark.read.parquet(out).agg(F.count("*").alias("rows_written")).withColumn(
        "rows_observed", F.lit(rows).cast("bigint"))


def q_predictor_score_job(spark, sf_dir):
    """A user predictor over a stored table: numbers beyond doubles, NULL and NaN come through unchanged."""
    src, out = (scratch_path(spark, n) + ".parquet" for n in ("predictor-in", "predictor-out"))
    events_with_invalid(spark, sf_dir).select(*SCORED, F.expr(BIG_ID).alias("big_id")).write.parquet(src)
    _, rows = jobs.predictor_score_job(spark, LinearPredictor(EVENTS_MODEL), input_path=src, output_path=out,
                                       on_invalid="null")
    return spark.read.parquet(out).withColumn("rows_observed", F.lit(rows).cast("bigint"))


QUERIES: dict[str, Query] = {
    "training_extract": q_training_extract,
    "scoring_extract": q_scoring_extract,
    "keyed_sample": q_keyed_sample,
    "filter_project": q_filter_project,
    "exact_split": q_exact_split,
    "split_sizes": q_split_sizes,
    "approx_split": q_approx_split,
    "scaler_fit": q_scaler_fit,
    "scaler_transform": q_scaler_transform,
    "score_linear": q_score_linear,
    "score_lineitem": q_score_lineitem,
    "score_lineitem_python": q_score_lineitem_python,
    "score_lineitem_udf": q_score_lineitem_udf,
    "score_wide": q_score_wide,
    "score_documents": q_score_documents,
    "score_threshold": q_score_threshold,
    "score_python": q_score_python,
    "score_skip_invalid": q_score_skip_invalid,
    "score_null_invalid": q_score_null_invalid,
    "quarantine_counts": q_quarantine_counts,
    "quarantine_rows": q_quarantine_rows,
    "validate_report": q_validate_report,
    "evaluate_binary": q_evaluate_binary,
    "evaluate_no_positives": q_evaluate_no_positives,
    "evaluate_positional": q_evaluate_positional,
    "evaluate_many": q_evaluate_many,
    "random_sample": q_random_sample,
    "describe_numeric": q_describe_numeric,
    "value_counts": q_value_counts,
    "head_rows": q_head_rows,
    "not_null_check": q_not_null_check,
    "score_many": q_score_many,
    "score_ensemble": q_score_ensemble,
    "model_status": q_model_status,
    "runlog_current": q_runlog_current,
    "latest_version": q_latest_version,
    "batch_score_job": q_batch_score_job,
    "stream_score": q_stream_score,
    "stream_requests": q_stream_requests,
    "stream_batch_sink": q_stream_batch_sink,
    "csv_roundtrip": q_csv_roundtrip,
    "parquet_roundtrip": q_parquet_roundtrip,
    "json_roundtrip": q_json_roundtrip,
    "table_roundtrip": q_table_roundtrip,
    "train_logistic": q_train_logistic,
    "train_wide": q_train_wide,
    "train_wide_lbfgs": q_train_wide_lbfgs,
    "train_wide_mllib": q_train_wide_mllib,
    "train_job": q_train_job,
    "train_and_score": q_train_and_score,
    "train_from_config": q_train_from_config,
    "train_own_function": q_train_own_function,
    "train_from_extract": q_train_from_extract,
    "score_python_invalid": q_score_python_invalid,
    "score_udf_invalid": q_score_udf_invalid,
    "score_many_invalid": q_score_many_invalid,
    "score_ensemble_invalid": q_score_ensemble_invalid,
    "model_status_invalid": q_model_status_invalid,
    "stream_reply_invalid": q_stream_reply_invalid,
    "stream_rejects": q_stream_rejects,
    "flagged_rows": q_flagged_rows,
    "evaluate_invalid": q_evaluate_invalid,
    "train_job_invalid": q_train_job_invalid,
    "predictor_whole_row_invalid": q_predictor_whole_row_invalid,
    "training_extract_nan_label": q_training_extract_nan_label,
    "evaluate_many_invalid": q_evaluate_many_invalid,
    "score_models_job_invalid": q_score_models_job_invalid,
    "exact_split_sides": q_exact_split_sides,
    "approx_split_sides": q_approx_split_sides,
    "csv_text_roundtrip": q_csv_text_roundtrip,
    "path_over_table": q_path_over_table,
    "runlog_roundtrip": q_runlog_roundtrip,
    "runlog_compacted": q_runlog_compacted,
    "describe_sketch": q_describe_sketch,
    "random_sample_law": q_random_sample_law,
    "daily_score_replay": q_daily_score_replay,
    "registry_conflict": q_registry_conflict,
    "registry_roundtrip": q_registry_roundtrip,
    "score_models_job": q_score_models_job,
    "observed_rows": q_observed_rows,
    "predictor_score_job": q_predictor_score_job,
}
