"""L2 logistic regression minimising ``C * sum(logloss) + 0.5 * |w|^2``.

Every pass over the rows is one Spark job with the coefficients as *data*: a
task multiplies its Arrow batches with them and gives back sums (loss,
gradient, for Newton also the Hessian), which are added up by block.  The
plan is the same in every iteration and at every width, so no code is
generated or compiled anew; only the broadcast coefficients change.

* ``newton`` (default): gradient and upper triangle of the Hessian from one
  pass, 6-10 passes in all.  The Hessian is summed in blocks of
  ``BLOCK_DOUBLES``; the driver holds ``(p+1)^2`` numbers.
* ``lbfgs``: the gradient only, ``p + 1`` numbers a task, for features so many
  that ``(p+1)^2`` numbers are too many for the driver; more passes.
* ``mllib``: ``pyspark.ml`` ``LogisticRegression`` with ``regParam = 1/(C*n)``
  (MLlib minimises ``mean(logloss) + regParam/2 * |w|^2``), no
  standardisation of its own, unpenalised intercept.

The solver is what the caller names; it never changes with the size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.linear import LinearModel
from tabscore.session import ship_package, spark_context

#: Doubles of one block of sums (1 MB): what a row of partial sums holds at most, beside the gradient.
BLOCK_DOUBLES = 1 << 17
#: Partial sums meet in this many lanes before the last addition, on clusters of more than LANE_CORES cores.
LANES, LANE_CORES = 32, 64
#: Steps that L-BFGS remembers.
MEMORY = 20
HEADER = 4    # rows fitted, invalid rows, invalid labels, loss

PARTIAL = "block int, lane int, sums binary"


def feature_vector(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _prepare(df: DataFrame, x: Column, label: str) -> DataFrame:
    y = F.col(label).cast("double")
    return df.select(x.cast("array<double>").alias("x"), y.alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))


def _check_counts(n: int, bad_labels: int, bad_rows: int, on_invalid: str) -> None:
    """The one contract of all solvers on what may be fitted."""
    if not n:
        raise ValueError("no labelled rows to fit")
    if bad_labels:
        raise ValueError(f"{bad_labels} labels are neither 0 nor 1 (binary classification only)")
    if bad_rows and on_invalid == "error":
        raise ValueError(f"{bad_rows} rows hold a NULL or NaN feature (on_invalid='skip' leaves them out)")


def _matrix(lists: pa.ListArray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``p`` doubles, which rows of ``lists`` they are): those of the right length without NULL or NaN."""
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), p), False)
    values = pc.fill_null(lists.filter(right).flatten(), float("nan")).to_numpy(zero_copy_only=False)
    x = values.reshape(int(pc.sum(right).as_py() or 0), p)
    fine = ~np.isnan(x).any(axis=1)
    return x[fine], np.flatnonzero(right.to_numpy(zero_copy_only=False))[fine]


def partial_sums(theta: Callable[[], np.ndarray], hessian: bool) -> Callable:
    """The work of a task: sums over its rows at the coefficients (the last one is the intercept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = theta()
        p = len(t) - 1
        head, second = np.zeros(HEADER + p + 1), np.zeros((p + 1, p + 1) if hessian else (0, 0))
        for batch in batches:
            y_all = batch.column("y").to_numpy(zero_copy_only=False)
            x, which = _matrix(batch.column("x"), p)
            y = y_all[which]
            z = x @ t[:p] + t[p]
            mu = 1.0 / (1.0 + np.exp(-np.abs(z)))
            mu = np.where(z >= 0, mu, 1.0 - mu)
            head[:HEADER] += (len(y), len(y_all) - len(y), np.count_nonzero((y_all != 0) & (y_all != 1)),
                              (np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - y * z).sum())
            r = mu - y
            head[HEADER:HEADER + p] += r @ x
            head[HEADER + p] += r.sum()
            if hessian:
                w = mu * (1.0 - mu)
                wx = x * w[:, None]
                second[:p, :p] += x.T @ wx
                second[:p, p] += wx.sum(axis=0)
                second[p, p] += w.sum()
        rows = [head, *_triangle(second)]
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([lane] * len(rows), pa.int32()),
                                          pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "lane", "sums"])

    return run


def _triangle(second: np.ndarray) -> list[np.ndarray]:
    """The upper triangle in blocks of bounded size."""
    flat = second[np.triu_indices(len(second))]
    return [flat[i:i + BLOCK_DOUBLES] for i in range(0, len(flat), BLOCK_DOUBLES)]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of equal (block, lane); holds one sum of each, whatever the number of tasks."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, lane, sums in zip(*(batch.column(c).to_pylist() for c in range(3))):
            more = np.frombuffer(sums)
            held[block, lane] = held[block, lane] + more if (block, lane) in held else more
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
                                          pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "lane", "sums"])


class Objective:
    """Loss, gradient and, if asked for, Hessian at given coefficients: one Spark job a call."""

    def __init__(self, data: DataFrame, p: int, C: float, on_invalid: str):
        self.data, self.p, self.C, self.on_invalid = data, p, C, on_invalid
        self.n = self.skipped = 0
        ship_package(data.sparkSession)

    def __call__(self, theta: np.ndarray, hessian: bool = False):
        spark, p = self.data.sparkSession, self.p
        sc = spark_context(spark)
        shared = sc.broadcast(theta) if sc is not None else None
        blocks = 1 + (-(-(p + 1) * (p + 2) // 2 // BLOCK_DOUBLES) if hessian else 0)
        # on Spark Connect, which has no broadcast variables, the coefficients ride in the closure
        sums = self.data.mapInArrow(partial_sums((lambda: shared.value) if shared else (lambda: theta), hessian), PARTIAL)
        if sc is not None and sc.defaultParallelism > LANE_CORES:
            sums = sums.repartition(blocks * LANES, "block", "lane").mapInArrow(_add, PARTIAL)
        sums = sums.withColumn("lane", F.lit(0)).repartition(blocks, "block").mapInArrow(_add, PARTIAL)
        found = {b: np.frombuffer(v) for b, v in sums.select("block", "sums").toArrow().to_pandas().itertuples(index=False)}
        if shared:
            shared.unpersist()
        head = found.get(0, np.zeros(HEADER + p + 1))
        n, bad_rows, bad_labels = (int(v) for v in head[:3])
        _check_counts(n or (bad_rows if self.on_invalid == "error" else 0), bad_labels, bad_rows, self.on_invalid)
        self.n, self.skipped = n, bad_rows
        reg = np.append(np.ones(p), 0.0)
        value = self.C * float(head[3]) + 0.5 * float(theta[:p] @ theta[:p])
        grad = self.C * head[HEADER:] + reg * theta
        if not (np.isfinite(value) and np.isfinite(grad).all()):
            raise ValueError("the fit left the finite numbers; scale the features")
        if not hessian:
            return value, grad, None
        second = np.zeros((p + 1, p + 1))
        second[np.triu_indices(p + 1)] = np.concatenate([found[b] for b in range(1, len(found))])
        second = self.C * (second + np.triu(second, 1).T) + np.diag(reg)
        if not np.isfinite(second).all():
            raise ValueError("the fit left the finite numbers; scale the features")
        return value, grad, second


def newton(f: Objective, p: int, max_iter: int, tol: float) -> tuple[np.ndarray, int, bool]:
    """(coefficients, iterations, converged); the step is halved while the objective would rise."""
    theta = np.zeros(p + 1)
    value, grad, second = f(theta, hessian=True)
    for iteration in range(1, max_iter + 1):
        step = np.linalg.solve(second, grad)
        t = 1.0
        while True:
            value_t, grad_t, second_t = f(theta - t * step, hessian=True)
            if value_t <= value + 1e-12 * abs(value):
                break
            t *= 0.5
            if t < 1e-8:    # no step along this direction lowers the objective: stay
                return theta, iteration, bool(np.max(np.abs(grad)) <= 1e-6 * max(1.0, abs(value)))
        theta, value, grad, second = theta - t * step, value_t, grad_t, second_t
        if np.max(np.abs(t * step)) <= tol:
            return theta, iteration, True
    return theta, max_iter, False


def lbfgs(f: Objective, p: int, max_iter: int, tol: float) -> tuple[np.ndarray, int, bool]:
    """(coefficients, iterations, converged): limited-memory quasi-Newton steps from gradients alone."""
    theta = np.zeros(p + 1)
    value, grad, _ = f(theta)
    scale = max(1.0, float(np.max(np.abs(grad))))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for iteration in range(1, max_iter + 1):
        if np.max(np.abs(grad)) <= tol * scale:
            return theta, iteration - 1, True
        direction, kept = -grad, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / float(np.linalg.norm(grad))
        for (s, y), a in zip(steps, reversed(kept)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        t, slope = 1.0, float(grad @ direction)
        while True:
            value_t, grad_t, _ = f(theta + t * direction)
            if value_t <= value + 1e-4 * t * slope + 1e-15 * abs(value):
                break
            t *= 0.5
            if t < 1e-10:
                return theta, iteration, bool(np.max(np.abs(grad)) <= 1e-6 * scale)
        s, y = t * direction, grad_t - grad
        theta, value, grad = theta + s, value_t, grad_t
        if s @ y > 1e-14 * float(y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
    return theta, max_iter, bool(np.max(np.abs(grad)) <= tol * scale)


SOLVERS = {"newton": newton, "lbfgs": lbfgs}


def fit_logistic(df: DataFrame, features: Sequence[str] | None, label: str = "target", *, vector: str | None = None,
                 C: float = 1.0, max_iter: int = 1000, tol: float = 1e-6, solver: str = "newton",
                 name: str = "model", version: str = "v1", on_invalid: str = "error", persist: bool = True) -> LinearModel:
    """Coefficients on the given (already scaled) features; means 0, scales 1.

    ``features`` names columns; with ``vector`` they are the elements of that
    array column instead (named ``<vector>_0`` on, or by ``features``), as
    many as its longest value has.

    All solvers keep one contract: rows without a label are not fitted;
    labels other than 0 and 1 are an error; a NULL or NaN feature (an array
    of another length) is an error, or with ``on_invalid="skip"`` the row is
    left out.  ``metadata`` has ``n`` (rows fitted), ``skipped`` and
    ``converged``.  ``persist=False`` when ``df`` is held already.
    """
    if on_invalid not in ("error", "skip"):
        raise ValueError("on_invalid must be 'error' or 'skip'")
    if solver not in (*SOLVERS, "mllib"):
        raise ValueError("solver must be 'newton', 'lbfgs' or 'mllib'")
    if vector is not None and not features:
        widest = df.agg(F.max(F.size(F.when(F.col(vector).isNotNull(), F.col(vector))))).first()[0]
        features = [f"{vector}_{i}" for i in range(max(widest or 0, 0))]
    data = _prepare(df, F.col(vector) if vector is not None else feature_vector(df, features), label)
    if solver == "mllib":
        return _fit_mllib(data, features, C, max_iter, tol, name, version, on_invalid)
    p = len(features)
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        f = Objective(data, p, C, on_invalid)
        theta, iterations, converged = SOLVERS[solver](f, p, max_iter, tol)
    finally:
        if persist:
            data.unpersist()
    return LinearModel(tuple(features), tuple(float(v) for v in theta[:p]), float(theta[p]), name=name, version=version,
                       metadata={"n": f.n, "iterations": iterations, "solver": solver, "skipped": f.skipped,
                                 "converged": converged})


def _fit_mllib(data, features, C, max_iter, tol, name, version, on_invalid) -> LinearModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    fine = (F.size("x") == len(features)) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    bad = ~F.coalesce(fine, F.lit(False))
    n_all, bad_labels, bad_rows = data.agg(F.count("*"), F.count_if(~F.col("y").isin(0.0, 1.0)), F.count_if(bad)).first()
    n = n_all - bad_rows
    _check_counts(n or (bad_rows if on_invalid == "error" else 0), bad_labels, bad_rows, on_invalid)
    assembled = (data.where(~bad).select(array_to_vector("x").alias("_features"), "y")
                 .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        lr = LogisticRegression(featuresCol="_features", labelCol="y", family="binomial",
                                regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                                fitIntercept=True, maxIter=max_iter, tol=tol)
        fitted = lr.fit(assembled)
    finally:
        assembled.unpersist()
    return LinearModel(tuple(features), tuple(float(w) for w in fitted.coefficients.toArray()),
                       float(fitted.intercept), name=name, version=version,
                       metadata={"n": n, "iterations": fitted.summary.totalIterations, "solver": "mllib",
                                 "skipped": bad_rows, "converged": fitted.summary.totalIterations < max_iter})
