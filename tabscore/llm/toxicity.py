"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

1. For each word (its 64-bit hash) the labelled training documents give its
   log-odds of toxic against clean use under a Dirichlet prior proportional to
   its overall use, and the z-score of those odds.  Each distinct text counts
   once, and a word once per text, so a text held by a third of the rows weighs
   as one.
2. A word scores its log-odds when they are significant, less a fixed cost per
   word, so ordinary text drifts downwards.  One linear pass over a whole text
   finds every maximal scoring segment.
3. Under the clean word-score distribution, the best segment of ``n`` words
   follows an extreme-value law: expected chance segments
   ``E = K n exp(-lambda S)``.  Segments below ``SIGNIFICANT`` are reported;
   their evidence adds up to the document's, and a logistic curve fitted on
   the training fold maps it to a probability.

Words are counted in Spark, and only those with significant odds make the
model's table.  It is broadcast while its measured size is small; beyond that
the words of the texts meet it in a shuffled join.  Every other word scores the
cost alone, so no word has another's score.

Defined results: null and empty texts have no words, no segments and the
evidence of an empty text; several labels of one document are averaged (ties
count as toxic); labels without a document are ignored; with no labels every
score is 0.0; repeated rows are scored one by one; texts of any length are
scored whole, in time linear in their words; an empty table gives an empty
result; columns beyond id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from tabscore.llm.common import BROADCAST_BYTES, python_workers, F, T, col, crc_mod, materialise, small, words

WORD_BYTES = 16         # a word of the model's table: hash and score
PRIOR_SHARE = 0.05      # prior weight, as a share of all counted words
Z_MIN = 2.5             # log-odds below this many standard errors count as none
WORD_COST = 0.2         # what every word costs a segment
SIGNIFICANT = 0.05      # expected chance segments at which a passage is reported
X_LOW, X_HIGH, X_BINS = -25.0, 75.0, 1000

SEGMENT = T.StructType([
    T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("expected_by_chance", T.DoubleType())])
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()),
    T.StructField("segments", T.ArrayType(SEGMENT))])


def word_ids(text: Column) -> Column:
    """The 64-bit hash of every word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one linear pass.

    Only positive entries can begin or end a segment, so the walk visits
    those; everything between is a difference of running sums.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # candidates: first, last, sum before, sum after, and the nearest candidate
    # to the left with a smaller sum before (-1: none), which keeps the search linear
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, float(total[i]), float(total[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j + 1:]
            j = found.pop()[4]
        found.append((first, i, low, high, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class ToxicModel:
    #: Words with significant odds, sorted, and their scores; or, where they are too many, a table (word, score).
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    table: DataFrame | None = None
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0
    rows: int = 0

    def scores(self, ids, at=None, marks=None) -> np.ndarray:
        """The score of every word; ``at`` and ``marks`` are places and scores already looked up in the table."""
        ids = np.asarray(ids if ids is not None else [], dtype=np.int64)
        out = np.full(len(ids), -WORD_COST)
        if at is not None:
            out[np.asarray(at, dtype=np.int64)] = np.asarray(marks, dtype=np.float64)
        elif len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
            hit = self.keys[k] == ids
            out[hit] = self.values[k[hit]]
        return out

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Maximal segments with the logarithm of the number expected by chance in a text of this length."""
        if not len(scores):
            return []
        log_n = math.log(len(scores))
        return [(a, b, s, self.log_k + log_n - self.decay * s) for a, b, s in maximal_segments(scores)]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        """Evidence of all significant segments together; of the best one if none is."""
        if not found:
            return X_LOW
        strong = [-e for *_, e in found if e <= math.log(SIGNIFICANT)]
        return float(np.clip(sum(strong) if strong else -min(e for *_, e in found), X_LOW, X_HIGH))

    def probability(self, evidence: float) -> float:
        if not self.rows:
            return 0.0
        return 1.0 / (1.0 + math.exp(-(self.intercept + self.slope * evidence)))


def log_odds(t: Column, c: Column, nt: float, nc: float) -> tuple[Column, Column]:
    """Log-odds of toxic against clean use of a word, and their z-score, under the proportional prior."""
    prior, p0 = (t + c) * PRIOR_SHARE, PRIOR_SHARE * (nt + nc)
    a, b = t + prior, c + prior
    odds = F.log(F.try_divide(a, F.lit(nt + p0) - a)) - F.log(F.try_divide(b, F.lit(nc + p0) - b))
    return odds, odds / F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b)


#: Bins of one unit of score in the clean words' distribution.
SCORE_BINS = 256


def decay_of(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(x * score)] = 1 under the clean words' score distribution."""
    p = weight / weight.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * values, 500.0))).sum()) - 1.0
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def logistic_1d(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a lightly regularised logistic curve over binned counts."""
    w = np.zeros(2)
    f = np.stack([np.ones_like(x), x / 10.0], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(f @ w, -30, 30)))
        n = pos + neg
        grad = f.T @ (pos - n * p) - 0.05 * w
        hess = (f * (n * p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-6) / 10.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column, ident: str, text: str) -> DataFrame:
    """(ids, toxic): the words of every distinct labelled text of the training fold, written once."""
    known = labels.where(col(label).isNotNull() & col(ident).isNotNull() & fold).groupBy(
        col(ident).alias("_id")).agg(F.avg(col(label).cast("double")).alias("_y"))
    side, _ = small(materialise(known, "toxic-labels"), 32)
    rows = docs.select(col(ident).alias("_id"), word_ids(col(text)).alias("ids"),
                       F.xxhash64(F.lower(col(text))).alias("h1"), F.crc32(F.lower(col(text)).cast("binary")).alias("h2")
                       ).join(side, "_id")
    # copies of one text: one row, toxic when most of its labels are
    one = rows.groupBy("h1", "h2").agg(F.avg("_y").alias("y"), F.min("_id").alias("_id"))
    one = one.select(F.col("_id").alias("_first"), (F.col("y") >= 0.5).alias("toxic"), F.col("h1").alias("_h1"))
    kept, _ = small(materialise(one, "toxic-texts"), 32)
    return materialise(rows.join(kept, (F.col("_id") == F.col("_first")) & (F.col("h1") == F.col("_h1")))
                       .select("ids", "toxic", F.col("_id").alias("id")), "toxic-rows")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: Column | None = None,
        ident: str = "doc_id", text: str = "text", limit: int = BROADCAST_BYTES) -> ToxicModel:
    spark = docs.sparkSession
    python_workers(spark)
    fold = fold if fold is not None else crc_mod(col(ident), 5) != 0
    rows = training_rows(docs, labels, label, fold, ident, text)
    counts = materialise(rows.select("toxic", F.explode(F.array_distinct("ids")).alias("word")).groupBy("word").agg(
        F.count_if("toxic").cast("double").alias("t"), F.count_if(~F.col("toxic")).cast("double").alias("c")), "toxic-counts")
    model = ToxicModel()
    nt, nc = counts.agg(F.sum("t"), F.sum("c")).first()
    if nt is None:
        return model
    model.rows = 1
    odds, z = log_odds(F.col("t"), F.col("c"), nt, nc)
    kept = materialise(counts.where(F.abs(z) >= Z_MIN).select("word", "t", "c", (odds - WORD_COST).alias("score")), "toxic-words")
    if kept.count() * WORD_BYTES <= limit:
        known = kept.orderBy("word").select("word", "score").toPandas()
        model.keys, model.values = known["word"].to_numpy(np.int64), known["score"].to_numpy(np.float64)
    else:
        model.table = kept.select("word", "score")
    # clean words by score, in bins of a fixed width; words without significant odds are one value
    seen = F.col("c") + F.when(F.col("score") > 0, PRIOR_SHARE * (F.col("t") + F.col("c"))).otherwise(0.0)
    like = kept.groupBy(F.floor(F.col("score") * SCORE_BINS).alias("b")).agg(
        F.sum(seen * F.col("score")).alias("s"), F.sum(seen).alias("w"), F.sum("c").alias("c")).collect()
    score = np.array([r["s"] / r["w"] for r in like if r["w"] > 0] + [-WORD_COST])
    # a toxic word is never impossible in clean text
    weight = np.array([r["w"] for r in like if r["w"] > 0] + [max(nc - sum(r["c"] for r in like), 0.0)])
    model.decay = decay_of(score, weight)
    rows = marked(rows, model, "toxic-rows-marked")
    model.log_k = log_k(rows, model)
    hist = binned(rows, model)
    x = X_LOW + (np.arange(X_BINS) + 0.5) * (X_HIGH - X_LOW) / X_BINS
    used = hist.sum(1) > 0
    model.intercept, model.slope = logistic_1d(x[used], hist[used, 1], hist[used, 0])
    return model


def marked(rows: DataFrame, model: ToxicModel, name: str) -> DataFrame:
    """``rows`` with (at, marks): places and scores of the words in the model's table, null where it is broadcast."""
    if model.table is None:
        return rows.withColumns({"at": F.lit(None).cast("array<int>"), "marks": F.lit(None).cast("array<double>")})
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), name)
    found = rows.select("_row", F.posexplode("ids").alias("_at", "word")).join(model.table, "word").groupBy("_row").agg(
        F.collect_list(F.struct("_at", "score")).alias("_m"))
    found = found.select("_row", F.col("_m._at").alias("at"), F.col("_m.score").alias("marks"))
    return rows.join(found, "_row", "left").drop("_row")


def log_k(rows: DataFrame, model: ToxicModel) -> float:
    """ln K from the best segments of clean training texts (mean of the extreme-value law); 0.1 when they are few."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, table=None))

    @F.pandas_udf(T.DoubleType())
    def excess(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for ids, at, marks in batches:
            best = [max((s for *_, s, _ in m.segments(m.scores(*r))), default=None) for r in zip(ids, at, marks)]
            yield pd.Series([None if s is None else m.decay * s - math.log(len(i)) for s, i in zip(best, ids)],
                            dtype="float64")

    n, mean = rows.where("NOT toxic").select(excess("ids", "at", "marks").alias("v")).agg(F.count("v"), F.avg("v")).first()
    return float(mean) - 0.5772156649 if n >= 30 else math.log(0.1)


def binned(rows: DataFrame, model: ToxicModel) -> np.ndarray:
    """Counts of clean and toxic training texts by bin of their evidence: a fixed table."""
    scored = rows.select("toxic", segment_column(rows, model)["evidence"].alias("x"))
    at = F.least(F.greatest(F.floor((F.col("x") - X_LOW) / ((X_HIGH - X_LOW) / X_BINS)), F.lit(0)), F.lit(X_BINS - 1))
    out = np.zeros((X_BINS, 2))
    for r in scored.groupBy(at.cast("int").alias("b"), "toxic").count().collect():
        out[r["b"], int(r["toxic"])] += r["count"]
    return out


def segment_column(df: DataFrame, model: ToxicModel) -> Column:
    """score, evidence and significant segments of each row's words (ids, at, marks)."""
    shared = df.sparkSession.sparkContext.broadcast(replace(model, table=None))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for ids, at, marks in batches:
            out = []
            for r in zip(ids, at, marks):
                found = m.segments(m.scores(*r))
                x = m.evidence(found)
                out.append((m.probability(x), x, [(a, b, s, math.exp(max(e, -700.0))) for a, b, s, e in found
                                                  if e <= math.log(SIGNIFICANT)]))
            yield pd.DataFrame(out, columns=["score", "evidence", "segments"])

    return run("ids", "at", "marks")


def passages(docs: DataFrame, model: ToxicModel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), evidence and every significant toxic passage (word positions) of each whole text."""
    python_workers(docs.sparkSession)
    rows = marked(docs.select(col(ident).alias("doc_id"), word_ids(col(text)).alias("ids")), model, "toxic-docs-marked")
    found = rows.select("doc_id", segment_column(rows, model).alias("r"))
    return found.select("doc_id", "r.score", "r.evidence", "r.segments")
