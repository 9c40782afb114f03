"""Native scoring, threshold, output shaping, Python predictors, multi-model."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscore.functions.linear import LinearModel
from tabscore.operators import multi, scoring
from tabscore.operators.pyscore import BasePredictor, LinearPredictor, score_with_predictor
from tabscore.operators.validate import InputSchema

MODEL = LinearModel(("a", "b"), (2.0, -1.0), 0.5, (1.0, 0.0), (2.0, 1.0))


def margin_np(a, b):
    return ((a - 1.0) / 2.0) * 2.0 + ((b - 0.0) / 1.0) * -1.0 + 0.5


@pytest.fixture()
def rows(spark):
    data = [(i, float(i % 7) - 3.0, float(i % 5) * 0.7) for i in range(200)]
    return spark.createDataFrame(data, "id bigint, a double, b double")


def test_score_appends_prediction(rows):
    out = scoring.score(rows, MODEL)
    assert out.columns == ["id", "a", "b", "prediction"]
    got = {r.id: r.prediction for r in out.collect()}
    for r in rows.collect():
        assert got[r.id] == (1.0 if margin_np(r.a, r.b) > 0 else 0.0)
    assert out.count() == rows.count()


def test_row_exactly_on_cut_is_negative(spark):
    # margin == 0 exactly: probability 0.5 is not > 0.5
    df = spark.createDataFrame([(1.0, 1.5)], "a double, b double")  # ((0)/2)*2 - 1.5 + 0.5 = -1.0
    m = LinearModel(("a",), (1.0,), 0.0, (1.0,), (1.0,))
    assert scoring.score(df, m).first().prediction == 0.0


def test_threshold_label(rows):
    out = scoring.score_proba(rows, MODEL, threshold=0.8, digits=None)
    for r in out.collect():
        p = 1.0 / (1.0 + math.exp(-margin_np(r.a, r.b)))
        assert abs(r.probability - p) < 1e-12
        if abs(p - 0.8) > 1e-9:
            assert r.predicted_label == (1 if p > 0.8 else 0)


def test_refuses_existing_prediction_column(rows):
    with pytest.raises(ValueError, match="already has"):
        scoring.score(rows.withColumn("prediction", F.lit(1.0)), MODEL)


def test_int_feature_where_float_declared(spark):
    df = spark.createDataFrame([(1, 2), (3, 0)], "a int, b int")
    out = scoring.score(df, MODEL).collect()
    assert [r.prediction for r in out] == [0.0, 1.0]


def test_on_invalid_policies(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0)], "id int, a double, b double")
    assert scoring.score(df, MODEL, on_invalid="skip").count() == 1
    nulls = {r.id: r.prediction for r in scoring.score(df, MODEL, on_invalid="null").collect()}
    assert nulls[2] is None and nulls[3] is None and nulls[1] is not None
    with pytest.raises(Exception, match="invalid feature value"):
        scoring.score(df, MODEL, on_invalid="error").collect()


def test_empty_input(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert scoring.score(df, MODEL).count() == 0


def test_shape_output(rows):
    import datetime as dt
    ts = dt.datetime(2024, 5, 1, 8, 30)
    out = scoring.shape_output(rows, MODEL, id_col="id", label_col="lbl", probability_col="p",
                               timestamp_col="at", run_timestamp=ts, model_col="model")
    assert out.columns == ["id", "lbl", "p", "at", "model"]
    r = out.first()
    assert r.at == ts and r.model == "model:v1"


def test_python_predictor_matches_native(rows):
    native = {r.id: r.prediction for r in scoring.score(rows, MODEL).collect()}
    py = {r.id: r.prediction for r in score_with_predictor(rows, LinearPredictor(MODEL)).collect()}
    assert native == py


def test_python_predictor_frame_and_array(rows):
    class FramePredictor(BasePredictor):
        def load(self):
            return 10.0

        def predict(self, state, batch: pd.DataFrame):
            return batch.assign(prediction=batch["a"] * state)

    class ArrayPredictor(FramePredictor):
        def predict(self, state, batch):
            return np.asarray(batch["a"]) + state

    a = {r.id: r.prediction for r in score_with_predictor(rows, FramePredictor()).collect()}
    b = {r.id: r.prediction for r in score_with_predictor(rows, ArrayPredictor()).collect()}
    src = {r.id: r.a for r in rows.collect()}
    assert all(a[k] == src[k] * 10 for k in src)
    assert all(b[k] == src[k] + 10 for k in src)


def test_python_predictor_wrong_length(rows):
    class Bad(BasePredictor):
        def load(self):
            return None

        def predict(self, state, batch):
            return np.zeros(len(batch) + 1)

    with pytest.raises(Exception, match="shape"):
        score_with_predictor(rows, Bad()).collect()


def test_repartition_does_not_change_result(rows):
    a = sorted(tuple(r) for r in scoring.score(rows, MODEL).collect())
    b = sorted(tuple(r) for r in scoring.score(rows.repartition(7), MODEL).collect())
    assert a == b


def test_score_many_and_status(rows):
    m2 = MODEL.renamed("second", "v9")
    long = multi.score_many(rows, [MODEL, m2], ["id"])
    assert long.count() == 2 * rows.count()
    status = {r.model_name: r for r in multi.model_status(rows, [MODEL, m2], ["model", "ghost", "second"]).collect()}
    assert status["ghost"].status == "error: unknown model" and status["ghost"].rows is None
    assert status["model"].status == "ok" and status["model"].rows == 200
    assert status["model"].positives == status["second"].positives


def test_ensemble_is_mean(rows):
    m2 = LinearModel(("a",), (0.3,), -0.1, name="other")
    ens = {r.id: r.probability for r in multi.score_ensemble(rows, [MODEL, m2], ["id"], digits=None).collect()}
    for r in rows.collect():
        p1 = 1 / (1 + math.exp(-margin_np(r.a, r.b)))
        p2 = 1 / (1 + math.exp(-(r.a * 0.3 - 0.1)))
        assert abs(ens[r.id] - (p1 + p2) / 2) < 1e-12


def test_no_join_in_multi_plan(rows, capsys):
    multi.score_many(rows, [MODEL, MODEL.renamed("b")], ["id"]).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan


def test_large_state_loads_per_partition(rows):
    native = {r.id: r.prediction for r in scoring.score(rows, MODEL).collect()}
    got = {r.id: r.prediction for r in
           score_with_predictor(rows, LinearPredictor(MODEL), max_broadcast_bytes=1).collect()}
    assert got == native


def test_class_labels_keep_type(rows):
    out = scoring.score(rows, MODEL, classes=("no", "yes"))
    assert dict(out.dtypes)["prediction"] == "string"
    native = {r.id: r.prediction for r in scoring.score(rows, MODEL).collect()}
    for r in out.collect():
        assert r.prediction == ("yes" if native[r.id] == 1.0 else "no")
    ints = scoring.score(rows, MODEL, classes=(0, 1))
    assert dict(ints.dtypes)["prediction"] == "int"


def test_predictor_is_abstract():
    with pytest.raises(TypeError):
        BasePredictor()

    class OnlyLoad(BasePredictor):
        def load(self):
            return None

    with pytest.raises(TypeError):
        OnlyLoad()


def test_score_vector_matches_named_columns(spark):
    vm = LinearModel(("v0", "v1", "v2"), (0.5, -1.25, 2.0), 0.1, (1.0, 0.0, -1.0), (2.0, 1.0, 4.0))
    rows = [(i, [float(i % 3), float(i % 5) - 2.0, float(i % 7) / 3.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    named = df.select("id", *[F.col("vec")[i].alias(f"v{i}") for i in range(3)])
    a = {r.id: r.prediction for r in scoring.score(named, vm).collect()}
    b = {r.id: r.prediction for r in scoring.score_vector(df, vm, "vec").collect()}
    assert a == b


def test_score_vector_invalid(spark):
    vm = LinearModel(("v0", "v1"), (1.0, 1.0), 0.0)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")]), (4, None), (5, [None, 1.0])],
                               "id int, vec array<double>")
    assert [r.id for r in scoring.score_vector(df, vm, "vec", on_invalid="skip").collect()] == [1]
    nulls = {r.id: r.prediction for r in scoring.score_vector(df, vm, "vec", on_invalid="null").collect()}
    assert nulls == {1: 1.0, 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(Exception, match="invalid feature vector"):
        scoring.score_vector(df, vm, "vec").collect()
    with pytest.raises(ValueError):
        scoring.score_vector(df, vm, "id")


def test_line_count_whole_text(spark):
    from tabscore.functions.text import char_count, line_count
    df = spark.createDataFrame([("a\nb\n",), ("",), (None,), ("x" * 50000 + "\ny",)], "t string")
    got = [(r.n, r.c) for r in df.select(line_count("t").alias("n"), char_count("t").alias("c")).collect()]
    assert got == [(3, 4), (1, 0), (None, None), (2, 50002)]


def test_package_shipped_once_to_workers(spark):
    from tabscore.session import _SHIPPED, ship_package
    ship_package(spark)
    ship_package(spark)          # second call is a no-op
    assert spark.sparkContext.applicationId in _SHIPPED

    def probe(batches):
        import tabscore  # importable in the worker
        for b in batches:
            yield b.assign(v=tabscore.__version__)

    assert {r.v for r in spark.range(3).mapInPandas(probe, "id long, v string").collect()} == {"0.1.0"}


def test_python_predictor_string_labels(rows):
    from pyspark.sql import types as T

    class Labeller(BasePredictor):
        def load(self):
            return ("low", "high")

        def predict(self, state, batch):
            return np.where(batch["a"].to_numpy() > 0, state[1], state[0])

    out = score_with_predictor(rows, Labeller(), columns=["id", "a"], prediction_type=T.StringType())
    assert dict(out.dtypes)["prediction"] == "string"
    src = {r.id: r.a for r in rows.collect()}
    assert all(r.prediction == ("high" if src[r.id] > 0 else "low") for r in out.collect())


def test_proba_and_shape_output_invalid_policies(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 0.0)], "id int, a double, b double")
    got = {r.id: (r.predicted_label, r.probability)
           for r in scoring.score_proba(df, MODEL, on_invalid="null").collect()}
    assert got[2] == (None, None) and got[3] == (None, None) and got[1][0] in (0, 1)
    shaped = scoring.shape_output(df, MODEL, id_col="id", on_invalid="skip")
    assert [r.id for r in shaped.collect()] == [1]


def test_score_job_to_table(spark, tmp_dir):
    from tabscore.plans import jobs
    src = f"{tmp_dir}/in.parquet"
    spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 0.5)], "id int, a double, b double").write.parquet(src)
    _, rows = jobs.score_job(spark, MODEL, input_path=src, output_table="tabscore_scored_t")
    assert rows == 2 and spark.table("tabscore_scored_t").count() == 2
    assert "prediction" in spark.table("tabscore_scored_t").columns


def test_score_job_partitioned_output(spark, tmp_dir):
    from tabscore.plans import jobs
    src = f"{tmp_dir}/in2.parquet"
    spark.createDataFrame([(1, 1.0, 2.0, "2024-01-01"), (2, 3.0, 0.5, "2024-01-02")],
                          "id int, a double, b double, day string").write.parquet(src)
    _, rows = jobs.score_job(spark, MODEL, input_path=src, output_path=f"{tmp_dir}/out2.parquet",
                             partition_by=["day"])
    import os
    assert rows == 2 and sorted(d for d in os.listdir(f"{tmp_dir}/out2.parquet") if d.startswith("day=")) == \
        ["day=2024-01-01", "day=2024-01-02"]


def test_udf_scoring_matches_native_and_sends_only_features(rows, capsys):
    from tabscore.operators.pyscore import score_with_udf
    native = {r.id: r.prediction for r in scoring.score(rows, MODEL).collect()}
    udf = score_with_udf(rows, LinearPredictor(MODEL), ["a", "b"])
    assert udf.columns == ["id", "a", "b", "prediction"]
    assert {r.id: r.prediction for r in udf.collect()} == native
    big = score_with_udf(rows, LinearPredictor(MODEL), ["a", "b"], max_broadcast_bytes=1)
    assert {r.id: r.prediction for r in big.collect()} == native
    udf.explain()
    text = capsys.readouterr().out
    python_node = [l for l in text.splitlines() if "ArrowEvalPython" in l][0]
    assert "id#" not in python_node.split("[", 1)[1].split("]")[0]


class SeesRows(BasePredictor):
    """A predictor that does not name its features."""

    def __init__(self, answer="array", schema=None):
        self.answer, self.input_schema = answer, schema

    def load(self):
        return 2.0

    def predict(self, state, batch):
        out = batch["x"].to_numpy(dtype=float) * state
        if self.answer == "frame":
            return batch.assign(prediction=out, big=-1)
        return out if self.answer == "array" else list(out)


def invalid_rows(spark):
    big = 2**53 + 1
    rows = [(big, 1.0, None, "a"), (None, None, 1.5, "b"), (big + 2, float("nan"), float("nan"), None), (4, -2.0, float("nan"), "d")]
    return spark.createDataFrame(rows, "big bigint, x double, y double, t string").repartition(2)


@pytest.mark.parametrize("answer", ["array", "frame", "list"])
def test_whole_row_predictor_follows_the_invalid_policy(spark, answer):
    df = invalid_rows(spark)
    p = SeesRows(answer, InputSchema.from_feature_columns(["x"]))
    show = lambda d: sorted((str(tuple(r)) for r in d.collect()))
    null = score_with_predictor(df, p, on_invalid="null")
    assert show(null.drop("prediction")) == show(df)                       # bigint, NULL and NaN come back unchanged
    assert {r.x if r.x == r.x else "nan": r.prediction for r in null.collect()} == {1.0: 2.0, None: None, "nan": None, -2.0: -4.0}
    assert sorted(r.prediction for r in score_with_predictor(df, p, on_invalid="skip").collect()) == [-4.0, 2.0]
    with pytest.raises(Exception, match="invalid feature value"):
        score_with_predictor(df, p, on_invalid="error").collect()
    with pytest.raises(ValueError):
        score_with_predictor(df, p, on_invalid="other")


def test_whole_row_predictor_without_a_schema_needs_every_column(spark):
    df = invalid_rows(spark)
    assert score_with_predictor(df, SeesRows(), on_invalid="skip").count() == 0
    assert score_with_predictor(df, SeesRows(), on_invalid="skip", required=["x", "t"]).count() == 2
    assert score_with_predictor(df.where("x is null"), SeesRows(), on_invalid="null", required=["x"]).first().prediction is None


def test_score_vector_keeps_a_column_named_like_its_own(spark):
    from tabscore.functions.linear import LinearModel
    df = spark.createDataFrame([([1.0, 2.0], 7, 8), (None, 9, 10)], "v array<double>, _margin int, _MARGIN_ int")
    m = LinearModel(("a", "b"), (1.0, 1.0), 0.0)
    out = scoring.score_vector(df, m, "v", on_invalid="null")
    assert out.columns[:3] == df.columns and {r._margin for r in out.collect()} == {7, 9}
    with pytest.raises(Exception, match="invalid feature vector"):
        scoring.score_vector(df, m, "v").select("probability").collect()    # the probability alone is guarded too
