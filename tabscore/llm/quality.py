"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

1. Each text becomes a fixed vector of statistics (case, symbols, repetition,
   lines, lengths), a pure function of the whole text.
2. The standardised vector goes through cosines of seeded Gaussian
   projections, which approximate a Gaussian kernel.
3. Ridge weights solve normal equations summed partition by partition: a
   partition sends one matrix, whatever its rows.
4. On rows kept out of the fit, the pooled-adjacent-violators step turns raw
   scores into probabilities.

Labels are read from a training fold only, at most ``MAX_LABELLED`` rows of it
(a hash of the id picks them, documented bound); scoring covers every row in
one narrow pass without a shuffle.  The driver sees at most ``FIT_PARTITIONS``
matrices of (features + 1)^2 numbers and a fixed histogram.

Defined results: null and empty texts get the statistics of an empty text and
a score like any other; several labels of one document are averaged; null
labels and labels without a document are ignored; with no label to learn from
nothing can be rejected, so every score is 1.0; texts of any length are read
whole; an empty table gives an empty result; new columns get names that are
free, and no other column is read or changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tabscore.llm.common import python_workers, F, T, col, crc_mod, free_name, materialise, small

#: Bound on the labelled rows used for the fit.
MAX_LABELLED = 200_000
FIT_PARTITIONS = 16
FEATURES = 256
RIDGE = 1e-3
SEED = 20
THRESHOLD = 0.7
#: Raw ridge scores are binned over this range for the calibration.
LOW, HIGH, BINS = -0.5, 1.5, 2000

_CLASS = np.zeros(256, dtype=np.int64)           # 0: other ASCII
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[[ord(c) for c in " \t\r"]] = 4
_CLASS[ord("\n")] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 8
_CLASS[[ord(c) for c in "#$%&*+=<>@[]^_`{}~\\/"]] = 9
_CLASS[128:] = 10
N_CLASSES = 11


def statistics(text: str | None) -> list[float]:
    """The vector of one text (null counts as empty)."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=N_CLASSES)
    share = by / max(n, 1)
    words = text.split()
    m = len(words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / max(n, 1)
    letters = by[1] + by[2] + by[10] / 2
    boost = lambda x: math.log1p(200.0 * x)  # noqa: E731  small shares count too
    return [
        math.log1p(n), math.log1p(m), (n / m if m else 0.0),
        by[2] / letters if letters else 0.0, boost(by[2] / letters if letters else 0.0),
        boost(share[3]), share[4], boost(share[5]), boost(share[6]), boost(share[7]), boost(share[8]),
        boost(share[9]), share[10],
        len(seen) / m if m else 1.0, math.log1p(len(seen)) / math.log1p(m) if m else 1.0,
        max(seen.values()) / m if m else 0.0,
        boost(sum(map(eq, words, words[1:])) / m if m else 0.0),
        len(set(lines)) / len(lines) if lines else 1.0,
        math.log1p(m / max(len(lines), 1)),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        math.log1p(max(map(len, words), default=0)),
    ]


N_STATS = len(statistics(""))


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, N_STATS)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    rows: int

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8.0, 8.0)
        f = np.cos(z @ self.projection + self.phase) * math.sqrt(2.0 / self.projection.shape[1])
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, texts) -> np.ndarray:
        if not self.rows:
            return np.ones(len(texts))
        raw = self.raw(matrix(texts))
        level = np.interp(raw, self.knots, self.values)
        # pooled blocks are flat; a hundredth of the raw score keeps the order inside them
        return np.clip(0.99 * level + 0.01 * np.clip((raw - LOW) / (HIGH - LOW), 0.0, 1.0), 0.0, 1.0)


def pooled(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to good/total, block by block."""
    blocks: list[list[float]] = []
    for g, t in zip(good, total):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, t2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + t2, blocks[-1][2] + k2]
    # each block's mean with half a row of either outcome, so that none is exactly 0 or 1
    return np.repeat([(g + 0.5) / (t + 1.0) for g, t, _ in blocks], [k for _, _, k in blocks])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column, ident: str, text: str,
                  bound: int) -> DataFrame:
    """(stats, y, part) of the labelled rows in the training fold, written once."""
    spark = docs.sparkSession
    python_workers(spark)
    known = labels.where(col(label).isNotNull() & col(ident).isNotNull() & fold).groupBy(
        col(ident).alias("_id")).agg(F.avg(col(label).cast("double")).alias("_y"))
    known = materialise(known, "quality-labels")
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(n)) < bound)
    side, _ = small(known, 32)
    rows = docs.select(col(ident).alias("_id"), col(text).alias("_text")).join(side, "_id")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    part = F.pmod(F.xxhash64(F.lit(SEED + 1), "_id"), F.lit(4)).cast("int")
    return materialise(rows.select(stats("_text").alias("stats"), F.col("_y").alias("y"), part.alias("part")),
                       "quality-rows")


def summed(rows: DataFrame, fold) -> list[np.ndarray]:
    """``fold(stats, y)`` added up inside every partition; one flat array per partition reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("stats").to_pylist(), dtype=np.float64)
                got = fold(x, b.column("y").to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["v"])

    out = rows.coalesce(FIT_PARTITIONS).mapInArrow(run, "v binary").collect()
    return [np.frombuffer(bytes(r.v), dtype=np.float64) for r in out]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: Column | None = None,
        ident: str = "doc_id", text: str = "text", bound: int = MAX_LABELLED) -> QualityModel:
    """Fit on the labelled rows where ``fold`` holds; a quarter of them calibrates."""
    fold = fold if fold is not None else crc_mod(col(ident), 4) != 2
    rows = training_rows(docs, labels, label, fold, ident, text, bound)
    k = N_STATS
    moments = sum(summed(rows.where("part <> 0"), lambda x, y: np.concatenate(
        [[len(x)], x.sum(0), (x * x).sum(0)])), np.zeros(2 * k + 1))
    n = moments[0]
    rng = np.random.default_rng(SEED)
    model = QualityModel(np.zeros(k), np.ones(k), rng.normal(0.0, 1.0 / math.sqrt(k), (k, FEATURES)),
                         rng.uniform(0.0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1),
                         np.array([LOW, HIGH]), np.array([0.5, 0.5]), int(n))
    if not n:
        return model
    model.mean = moments[1:k + 1] / n
    spread = np.sqrt(np.maximum(moments[k + 1:] / n - model.mean ** 2, 0.0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = sum(summed(rows.where("part <> 0"), normal), np.zeros(d * d + d))
    gram = sums[:d * d].reshape(d, d) + RIDGE * n * np.diag([1.0] * FEATURES + [1e-9])
    model.weights = np.linalg.solve(gram, sums[d * d:])

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)])

    held = rows.where("part = 0")
    if held.isEmpty():
        held = rows
    bins = sum(summed(held, histogram), np.zeros(2 * BINS))
    used = np.flatnonzero(bins[BINS:])
    model.knots = LOW + (used + 0.5) * (HIGH - LOW) / BINS
    model.values = pooled(bins[:BINS][used], bins[BINS:][used])
    return model


def score_column(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """The score of each whole text; the model travels with the task (a few hundred kB, fixed)."""
    python_workers(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(list(batch)))

    return score(text)


def classify(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` and ``accepted`` appended (underscores follow a name that is taken)."""
    s = free_name(docs.columns, "quality_score")
    out = docs.withColumn(s, score_column(docs, model, col(text)))
    return out.withColumn(free_name(out.columns, "accepted"), F.col(s) >= threshold)


def keep_accepted(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows the classifier rejects: one narrow pass after the fit."""
    model = fit(docs, labels, ident=ident, text=text)
    s = free_name(docs.columns, "quality_score")
    scored = docs.withColumn(s, score_column(docs, model, col(text)))
    return scored.where(F.col(s) >= THRESHOLD).select([col(c) for c in docs.columns])
