"""Train on a CSV, register, score another CSV, write CSV: the example model's flow."""

import math
import os

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F
from tabscore.operators import profile, scoring
from tabscore.operators.pyscore import LinearPredictor, score_with_predictor
from tabscore.functions.linear import LinearModel
from tabscore.operators.pyscore import ArtifactPredictor, BasePredictor
from tabscore.operators.runlog import ArtifactStore, ModelKey, ModelStore, RunLog
from tabscore.operators.scoring import OutputLayout
from tabscore.plans import jobs
from tabscore.sources import files

FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def _fixtures(tmp_dir):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(50, 5))
    y = (X[:, 0] + 0.5 * X[:, 1] - X[:, 2] > 0).astype(int)
    train = pd.DataFrame(X, columns=FEATURES).assign(target=y)
    train.insert(0, "id", range(50))
    inf = pd.DataFrame(np.random.default_rng(99).normal(size=(10, 5)), columns=FEATURES)
    train_path, inf_path = os.path.join(tmp_dir, "train.csv"), os.path.join(tmp_dir, "inference.csv")
    train.to_csv(train_path, index=False)
    inf.to_csv(inf_path, index=False)
    return train_path, inf_path


def test_train_then_score_csv(spark, tmp_dir):
    train_path, inf_path = _fixtures(tmp_dir)
    data = files.load_input(spark, path=train_path)
    assert data.count() == 50
    log = RunLog(spark, os.path.join(tmp_dir, "runlog"), run_id="e2e")
    store = ModelStore(spark, os.path.join(tmp_dir, "models"), "example")
    res = jobs.train_from_config(data, FEATURES, "target", "id", config={"test_size": 0.2},
                                 name="line_model", run_log=log, store=store, tol=1e-10)
    assert res.scaler.n == 50 - math.ceil(50 * 0.2)
    assert res.metrics["accuracy"] >= 0.8

    model = store.load("line_model", "latest")
    out_path = os.path.join(tmp_dir, "predictions.csv")
    scored, rows = jobs.score_job(spark, model, input_path=inf_path, output_path=out_path)
    assert rows == 10
    back = files.read_file(spark, out_path)
    assert files.format_for_path(out_path) == "csv" and back.count() == 10
    assert back.columns == FEATURES + ["prediction"]
    assert profile.null_count(back, "prediction").first().null_rows == 0

    native = sorted(r.prediction for r in scoring.score(files.load_input(spark, path=inf_path), model).collect())
    python = sorted(r.prediction for r in score_with_predictor(files.load_input(spark, path=inf_path),
                                                               LinearPredictor(model)).collect())
    assert native == python

    kinds = {r.kind for r in log.current().collect()}
    assert kinds == {"param", "metric", "artifact"}


def test_command_line_train_and_score(spark, tmp_dir):
    from tabscore.__main__ import main
    train_path, inf_path = _fixtures(tmp_dir)
    store, log = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "log")
    out = main(["train", "--input", train_path, "--model-store", store, "--model-name", "cli_model",
                "--features", ",".join(FEATURES), "--key", "id", "--run-log", log, "--version", "v1"], spark)
    assert out["status"] == "ok" and set(out["metrics"]) == {"accuracy", "precision", "recall", "f1"}
    res = main(["score", "--input", inf_path, "--model-store", store, "--model-name", "cli_model",
                "--output", os.path.join(tmp_dir, "p.parquet"), "--run-log", log], spark)
    assert res == {"status": "ok", "model": "cli_model", "version": "v1", "rows": 10}


def test_score_models_job_statuses(spark, tmp_dir):
    from tabscore.functions.linear import LinearModel
    store = ModelStore(spark, os.path.join(tmp_dir, "reg"), "example")
    store.save(LinearModel(("f0", "f1"), (1.0, -1.0), 0.0, name="m_a", version="1"))
    store.save(LinearModel(("f0",), (2.0,), -0.5, name="m_b", version="3"))
    store.save(LinearModel(("zz",), (1.0,), 0.0, name="m_bad", version="1"))
    _, inf_path = _fixtures(tmp_dir)
    out = os.path.join(tmp_dir, "multi.parquet")
    st = jobs.score_models_job(spark, store, ["m_a", "ghost", "m_b", "m_bad"], keep=FEATURES,
                               input_path=inf_path, output_path=out)
    assert st["ghost"] == {"status": "error: unknown model"}
    assert st["m_bad"]["status"].startswith("error: missing columns")
    assert st["m_a"]["status"] == "ok" and st["m_a"]["rows"] == 10 and st["m_b"]["version"] == "3"
    back = spark.read.parquet(out)
    assert back.count() == 20 and {r.model_name for r in back.select("model_name").distinct().collect()} == {"m_a", "m_b"}
    pos = back.where("model_name = 'm_b' AND prediction = 1.0").count()
    assert pos == st["m_b"]["positives"]


def test_command_line_xxhash_split(spark, tmp_dir):
    from tabscore.__main__ import main
    train_path, _ = _fixtures(tmp_dir)
    out = main(["train", "--input", train_path, "--model-store", os.path.join(tmp_dir, "m2"),
                "--model-name", "x", "--features", ",".join(FEATURES), "--key", "id", "--hash", "xxhash64"], spark)
    assert out["status"] == "ok"


def test_command_line_errors(spark, tmp_dir):
    import pytest
    from tabscore.__main__ import main
    train_path, inf_path = _fixtures(tmp_dir)
    store = os.path.join(tmp_dir, "m3")
    main(["train", "--input", train_path, "--model-store", store, "--model-name", "e",
          "--features", ",".join(FEATURES), "--key", "id", "--version", "v1"], spark)
    with pytest.raises(SystemExit):
        main(["score", "--input", inf_path, "--model-store", store, "--model-name", "e"], spark)
    with pytest.raises(ValueError):   # neither --input nor --table
        main(["train", "--model-store", store, "--model-name", "e2", "--features", "f0", "--key", "id"], spark)


class Centroid(BasePredictor):
    """What a user's training function may return: any predictor."""

    def __init__(self, good, bad):
        self.centres = (good, bad)
        self.features = list(FEATURES)

    def load(self):
        return self.centres

    def predict(self, state, batch):
        import numpy as np
        x = batch[self.features].to_numpy()
        good, bad = (((x - np.array(c)) ** 2).sum(axis=1) for c in state)
        return (good < bad).astype(float)


def fit_centroids(train, features, label):
    means = {r[label]: [r[f] for f in features] for r in train.groupBy(label).agg(*[F.avg(f).alias(f) for f in features]).collect()}
    return Centroid(means[1], means[0])


def test_train_with_a_users_function_and_predict_from_its_artifact(spark, tmp_dir):
    train_path, inf_path = _fixtures(tmp_dir)
    data = files.load_input(spark, path=train_path)
    key = ModelKey("example", "centroid", "v1")
    artifacts = ArtifactStore(spark, os.path.join(tmp_dir, "art"), key)
    log = RunLog(spark, os.path.join(tmp_dir, "runlog"), run_id="own")
    res = jobs.train_job(data, FEATURES, "target", "id", fit=fit_centroids, name="centroid", artifacts=artifacts, run_log=log)
    assert isinstance(res.model, Centroid) and 0.5 < res.metrics["accuracy"] <= 1.0 and res.sizes["train"] + res.sizes["test"] == res.sizes["rows_in"]
    assert log.summary()["artifacts"] == [{"path": "example/centroid/v1/centroid", "artifact": artifacts.path}]
    assert log.summary()["params"]["model_type"] == "Centroid"

    # a predictor fed from artifacts, another model's too
    ArtifactStore(spark, artifacts.path, key._replace(model="shift")).save("by", 0.25)

    class Shifted(ArtifactPredictor):
        def predict(self, state, batch):
            batch = batch.assign(**{f: batch[f] + state["by"] for f in FEATURES})
            return state["model"].predict(state["model"].load(), batch)

    predictor = Shifted(artifacts, model="centroid", by=("by", {"model": "shift"}))
    _, rows = jobs.predictor_score_job(spark, predictor, input_path=inf_path, output_path=os.path.join(tmp_dir, "shifted.parquet"))
    back = spark.read.parquet(os.path.join(tmp_dir, "shifted.parquet"))
    moved = files.load_input(spark, path=inf_path).select(*[(F.col(f) + 0.25).alias(f) for f in FEATURES])
    want = sorted(r.prediction for r in score_with_predictor(moved, res.model).collect())
    assert rows == 10 and sorted(r.prediction for r in back.collect()) == want
    with pytest.raises(ValueError, match="larger than"):
        score_with_predictor(moved, predictor, max_broadcast_bytes=1)


def test_output_layout_of_the_job(spark, tmp_dir):
    import datetime as dt
    train_path, _ = _fixtures(tmp_dir)
    model = LinearModel(tuple(FEATURES), (1.0,) * len(FEATURES))
    layout = OutputLayout("id", label_col="cls", probability_col="p", timestamp_col="at", run_timestamp=dt.datetime(2024, 5, 6, 7))
    _, rows = jobs.score_job(spark, model, input_path=train_path, output_path=os.path.join(tmp_dir, "o.parquet"), layout=layout)
    out = spark.read.parquet(os.path.join(tmp_dir, "o.parquet"))
    assert out.columns == ["id", "cls", "p", "at"] and out.count() == rows and out.first()["at"] == dt.datetime(2024, 5, 6, 7)


def test_command_line_several_models_predictor_layout_and_commit(spark, tmp_dir):
    from tabscore.__main__ import main
    train_path, inf_path = _fixtures(tmp_dir)
    store, log = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "log")
    for name in ("a", "b"):
        main(["train", "--input", train_path, "--model-store", store, "--model-name", name, "--features", ",".join(FEATURES),
              "--key", "id", "--run-log", log, "--version", "v1", "--commit-hash", "abc123"], spark)
    logged = {(r.key, r.value) for r in RunLog(spark, log).current().collect()}
    assert ("tabscore.commit_hash", "abc123") in logged and ("tabscore.pipeline_type", "training") in logged
    out = main(["score-models", "--input", train_path, "--model-store", store, "--model-names", "a,b,ghost", "--keep", "id",
                "--output", os.path.join(tmp_dir, "many.parquet")], spark)
    assert out["status"].startswith("error") and out["models"]["a"]["status"] == out["models"]["b"]["status"] == "ok"
    assert out["models"]["ghost"]["status"] == "error: unknown model"
    res = main(["score", "--input", train_path, "--model-store", store, "--model-name", "a", "--id-col", "id", "--label-col", "cls",
                "--run-timestamp", "2024-01-02T03:04:05", "--output", os.path.join(tmp_dir, "p.parquet")], spark)
    assert res["status"] == "ok" and spark.read.parquet(os.path.join(tmp_dir, "p.parquet")).columns == ["id", "cls", "probability", "scored_at"]
    res = main(["score", "--input", inf_path, "--model-store", store, "--model-name", "-", "--predictor", "tests.test_e2e:Always",
                "--output", os.path.join(tmp_dir, "q.parquet")], spark)
    assert res["rows"] == 10 and spark.read.parquet(os.path.join(tmp_dir, "q.parquet")).where("prediction = 1").count() == 10
    with pytest.raises(SystemExit):
        main(["score", "--input", inf_path, "--model-store", store, "--model-name", "-", "--predictor", "os:path",
              "--output", os.path.join(tmp_dir, "r.parquet")], spark)


class Always(BasePredictor):
    def load(self):
        return 1.0

    def predict(self, state, batch):
        return [state] * len(batch)


def test_command_line_trains_on_the_extract_and_scores_a_day(spark, tmp_dir):
    from tabscore.__main__ import main
    rows = [(i, float(i % 10), int(i % 10 > 4), f"2024-01-{i % 20 + 1:02d}") for i in range(400)]
    spark.createDataFrame(rows, "id int, x double, y int, d string").withColumn("d", F.to_date("d")).createOrReplaceTempView("t_cli")
    store = os.path.join(tmp_dir, "m")
    out = main(["train", "--table", "t_cli", "--label", "y", "--features", "x", "--key", "id", "--model-store", store, "--model-name", "d",
                "--date-column", "d", "--start-date", "2024-01-01", "--end-date", "2024-01-10", "--version", "v1"], spark)
    assert out["status"] == "ok" and out["metrics"]["accuracy"] == 1.0
    path = os.path.join(tmp_dir, "day.parquet")
    for day in ("2024-01-03", "2024-01-04", "2024-01-03"):
        res = main(["score", "--table", "t_cli", "--model-store", store, "--model-name", "d", "--day", day, "--date-column", "d",
                    "--output", path], spark)
        assert res["rows"] == 20
    assert spark.read.parquet(path).count() == 40
    with pytest.raises(SystemExit):
        main(["train", "--table", "t_cli", "--features", "x", "--key", "id", "--model-store", store, "--model-name", "d", "--date-column", "d"], spark)
