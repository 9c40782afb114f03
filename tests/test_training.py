"""Scaler (population std, zero std → 1), logistic fit against Newton, train job."""

import re

import numpy as np
import pytest

from tabscore.operators import logistic, metrics, scaling
from tabscore.operators.runlog import ModelStore, RunLog
from tabscore.plans import jobs

from tests.conftest import SF0001


def newton_logistic(X, y, C=1.0, iters=100):
    """argmin C * sum(logloss) + 0.5 * |w|^2, intercept unpenalised."""
    n, p = X.shape
    Xa = np.hstack([X, np.ones((n, 1))])
    theta = np.zeros(p + 1)
    reg = np.eye(p + 1)
    reg[p, p] = 0.0
    for _ in range(iters):
        z = Xa @ theta
        mu = 1 / (1 + np.exp(-z))
        grad = C * Xa.T @ (mu - y) + reg @ theta
        H = C * (Xa * (mu * (1 - mu))[:, None]).T @ Xa + reg
        step = np.linalg.solve(H, grad)
        theta -= step
        if np.max(np.abs(step)) < 1e-13:
            break
    return theta[:p], theta[p]


def test_scaler_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (4.0, 5.0, float("nan"))],
                               "a double, c double, z double")
    p = scaling.fit_scaler(df, ["a", "c", "z"])
    assert p.means[0] == pytest.approx(7 / 3)
    assert p.stds[0] == pytest.approx(np.std([1, 2, 4]))  # population
    assert p.scales[1] == 1.0  # zero variance → divide by 1
    assert p.means[2] == 1.0  # NaN and NULL ignored
    out = scaling.transform(df, p).collect()
    assert out[0].c == 0.0


def test_all_null_feature_scaler(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    p = scaling.fit_scaler(df, ["x"])
    assert p.means == (None,) and p.scales == (1.0,)


@pytest.mark.parametrize("solver,atol", [("newton", 1e-9), ("lbfgs", 1e-7), ("mllib", 1e-5)])
def test_logistic_matches_newton(spark, solver, atol):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(600, 3))
    y = (X @ np.array([1.5, -2.0, 0.3]) + 0.4 + rng.logistic(size=600) > 0).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               "a double, b double, c double, target double")
    m = logistic.fit_logistic(df, ["a", "b", "c"], "target", max_iter=500, tol=1e-12, solver=solver)
    w, b = newton_logistic(X, y)
    assert np.allclose(m.coefficients, w, atol=atol)
    assert m.intercept == pytest.approx(b, abs=atol)


def test_newton_separable_data_stays_finite(spark):
    # perfectly separable: the L2 term keeps the optimum finite; damping keeps steps sane
    df = spark.createDataFrame([(float(x), float(x > 0)) for x in np.linspace(-3, 3, 40)], "a double, target double")
    m = logistic.fit_logistic(df, ["a"], "target", tol=1e-10, solver="newton")
    X = np.linspace(-3, 3, 40)[:, None]
    w, b = newton_logistic(X, (X[:, 0] > 0).astype(float))
    assert np.isfinite(m.coefficients[0]) and abs(m.coefficients[0] - w[0]) < 1e-8


def test_train_job_on_documents(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    data = docs.join(labels, "doc_id")
    log = RunLog(spark, f"{tmp_dir}/runlog", run_id="r1")
    store = ModelStore(spark, f"{tmp_dir}/models", "docs")
    res = jobs.train_job(data, ["n_chars"], "quality", "doc_id", name="q", version="v1",
                         run_log=log, store=store, tol=1e-10)
    assert set(res.metrics) == {"accuracy", "precision", "recall", "f1"}
    loaded = store.load("q", "latest")
    assert loaded.coefficients == res.model.coefficients and loaded.means == res.model.means
    cur = {(r.kind, r.key): r.value for r in log.current().collect()}
    assert ("metric", "accuracy") in cur and ("param", "max_iter") in cur
    # evaluation with the stored model equals the job's numbers
    again = metrics.metrics_dict(metrics.evaluate(data, loaded, "quality", on_invalid="skip"))
    assert 0.0 <= again["accuracy"] <= 1.0


def test_metrics_edge_cases(spark):
    none_pred = spark.createDataFrame([(1, 0.0), (0, 0.0)], "target int, prediction double")
    m = metrics.binary_metrics(none_pred).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 0.5)
    no_actual = spark.createDataFrame([(0, 1.0), (0, 0.0)], "target int, prediction double")
    m = metrics.binary_metrics(no_actual).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    null_label = spark.createDataFrame([(None, 1.0), (1, 1.0)], "target int, prediction double")
    m = metrics.binary_metrics(null_label).first()
    assert m.n == 1 and m.tp == 1 and m.accuracy == 1.0
    perfect = spark.createDataFrame([(1, 1.0), (0, 0.0)], "target int, prediction double")
    m = metrics.binary_metrics(perfect).first()
    assert (m.n, m.tp, m.fp, m.fn, m.tn) == (2, 1, 0, 0, 1)
    assert m.tp + m.fp + m.fn + m.tn == m.n


def test_training_settings_defaults():
    s = jobs.training_settings({"test_size": 0.3, "hyperparameters": {"max_iter": 50}})
    assert s["test_size"] == 0.3 and s["max_iter"] == 50 and s["C"] == 1.0 and s["seed"] == 42
    assert jobs.training_settings(None)["max_iter"] == 1000


def test_positional_fallback(spark):
    from tabscore.operators.columns import align_features
    df = spark.createDataFrame([(1.0, 2.0, 1)], "x double, y double, target int")
    assert align_features(df, ["a", "b"]).columns == ["a", "b", "target"]
    with pytest.raises(ValueError):
        align_features(df, ["a"])


def test_evaluate_many_equals_single(spark):
    from tabscore.functions.linear import LinearModel
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").join(
        spark.read.parquet(f"{SF0001}/labels.parquet"), "doc_id")
    ms = [LinearModel(("n_chars",), (1.0,), 0.2, (2000.0,), (900.0,), "a"),
          LinearModel(("n_chars",), (-1.0,), 0.5, (1500.0,), (700.0,), "b")]
    many = {r.model_name: r.asDict() for r in metrics.evaluate_many(docs, ms, "quality").collect()}
    for m in ms:
        one = metrics.evaluate(docs, m, "quality").first().asDict()
        assert {k: many[m.name][k] for k in one} == one


def test_newton_rejects_non_binary_labels(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 2.0)], "a double, target double")
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        logistic.fit_logistic(df, ["a"], "target", solver="newton")


def wide_frame(spark, n=400, p=40, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = (X @ rng.normal(size=p) + rng.logistic(size=n) > 0).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(X, y)], "v array<double>, target double")
    return X, y, df


@pytest.mark.parametrize("solver,atol", [("newton", 1e-9), ("lbfgs", 1e-6)])
def test_wide_fit_matches_newton_whatever_the_partitions_and_blocks(spark, solver, atol, monkeypatch):
    """Sums in blocks of a few numbers, in lanes, over many partitions and from few rows a batch."""
    X, y, df = wide_frame(spark)
    w, b = newton_logistic(X, y)
    monkeypatch.setattr(logistic, "BLOCK_DOUBLES", 100)
    monkeypatch.setattr(logistic, "LANE_CORES", 0)
    m = logistic.fit_logistic(df.repartition(7), None, "target", vector="v", tol=1e-10, solver=solver)
    assert m.features[:2] == ("v_0", "v_1") and len(m.features) == 40 and m.metadata["converged"]
    assert np.allclose(m.coefficients, w, atol=atol) and m.intercept == pytest.approx(b, abs=atol)


@pytest.mark.parametrize("solver", ["newton", "lbfgs", "mllib"])
def test_wide_fit_leaves_out_or_refuses_invalid_vectors(spark, solver):
    X, y, df = wide_frame(spark, 200, 4)
    bad = spark.createDataFrame([(None, 1.0), ([1.0, None, 2.0, 3.0], 0.0), ([1.0, float("nan"), 2.0, 3.0], 1.0), ([1.0], 1.0),
                                 ([], 0.0)], "v array<double>, target double")
    unlabelled = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], None), ([1.0, 2.0, 3.0, 4.0], float("nan"))], df.schema)
    both = df.unionByName(bad).unionByName(unlabelled)
    with pytest.raises(ValueError, match="5 rows"):
        logistic.fit_logistic(both, None, "target", vector="v", solver=solver)
    m = logistic.fit_logistic(both, None, "target", vector="v", solver=solver, on_invalid="skip", tol=1e-10)
    one = logistic.fit_logistic(df, None, "target", vector="v", solver=solver, tol=1e-10)
    assert m.metadata["n"] == 200 and m.metadata["skipped"] == 5 and np.allclose(m.coefficients, one.coefficients, atol=1e-6)
    for empty in (df.where("target > 5"), bad):
        with pytest.raises(ValueError):
            logistic.fit_logistic(empty, ["a", "b", "c", "d"], "target", vector="v", solver=solver, on_invalid="skip")


def test_every_pass_of_a_fit_has_the_same_plan(spark):
    """Coefficients are data: nothing in the plan, so nothing in generated code, changes between passes."""
    _, _, df = wide_frame(spark, 50, 3)
    data = logistic._prepare(df, df["v"], "target")
    plans = set()
    for theta in (np.zeros(4), np.ones(4)):
        sums = data.mapInArrow(logistic.partial_sums(lambda t=theta: t, True), logistic.PARTIAL)
        plans.add(re.sub(r"#\d+L?|run\([^)]*\)", "", sums._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) == 1
