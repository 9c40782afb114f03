"""The fitted operators against plain NumPy and Python; the pipeline's stages on odd tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabscore.llm import quality, toxicity
from tabscore.llm.common import crc_mod, materialise

from tests.conftest import SF0001


def test_quality_fit_against_numpy(spark):
    """The same rows in one NumPy fit: weights, calibration levels by the min-max formula of isotonic regression, scores."""
    docs, labels = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("documents", "labels"))
    fold = crc_mod(F.col("doc_id"), 4) != 2
    model = quality.fit(docs, labels, fold=fold)
    rows = quality.training_rows(docs, labels, "quality", fold, "doc_id", "text", quality.MAX_LABELLED).collect()
    x, y, part = np.array([r.stats for r in rows]), np.array([r.y for r in rows]), np.array([r.part for r in rows])
    a, b = x[part != 0], y[part != 0]
    mean, spread = a.mean(0), a.std(0)
    scale = np.where(spread > 1e-9, spread, 1.0)

    def features(s):
        z = np.clip((s - mean) / scale, -8, 8)
        return np.hstack([np.cos(z @ model.projection + model.phase) * math.sqrt(2 / quality.FEATURES), np.ones((len(s), 1))])

    f = features(a)
    penalty = quality.RIDGE * len(a) * np.diag([1.0] * quality.FEATURES + [1e-9])
    weights = np.linalg.solve(f.T @ f + penalty, f.T @ b)
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw = features(x[part == 0]) @ weights
    at = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at))
    good, total = (np.array([v[at == k].sum() for k in bins]) for v in (y[part == 0], np.ones(len(at))))
    n = len(bins)
    level = np.array([max(min(good[i:j + 1].sum() / total[i:j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    want = np.zeros(n)
    for v in set(np.round(level, 12)):
        block = np.round(level, 12) == v
        want[block] = (good[block].sum() + 0.5) / (total[block].sum() + 1)
    assert len(model.knots) == n and np.allclose(model.values, want)
    got = {r.doc_id: r.quality_score for r in quality.classify(docs.select("doc_id", "text"), model).collect()}
    for r in docs.limit(40).collect():
        raw = float((features(np.array([quality.statistics(r.text)])) @ weights)[0])
        inside = min(max((raw - quality.LOW) / (quality.HIGH - quality.LOW), 0.0), 1.0)
        assert got[r.doc_id] == pytest.approx(min(max(0.99 * np.interp(raw, model.knots, want) + 0.01 * inside, 0), 1), abs=1e-5)


def test_toxic_log_odds_and_law_against_python(spark):
    rnd = random.Random(8)
    plain, foul = [f"w{i}" for i in range(30)], [f"bad{i}" for i in range(5)]
    texts = []
    for i in range(160):
        words = rnd.choices(plain, k=25) + (rnd.choices(foul, k=6) if i % 4 == 0 else rnd.choices(foul, k=rnd.randrange(2)))
        rnd.shuffle(words)
        texts.append(" ".join(words).title() if i % 7 == 0 else " ".join(words))
    texts += [texts[0]] * 30 + [texts[1].upper()]                        # copies weigh as one
    df = materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "t-toxic")
    labels = df.select("doc_id", ((F.col("doc_id") % 4 == 0) & (F.col("doc_id") < 160) | (F.col("text") == texts[0])).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels, fold=F.lit(True))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    distinct = {}
    for i, t in enumerate(texts):
        distinct.setdefault(t.lower(), []).append(label[i])
    t, c = {}, {}
    for text, marks in distinct.items():
        for w in set(re.findall(r"[a-z0-9]+", text)):
            side = t if sum(marks) / len(marks) >= 0.5 else c
            side[w] = side.get(w, 0) + 1
    nt, nc = sum(t.values()), sum(c.values())
    want, share = {}, toxicity.PRIOR_SHARE
    spread = []
    for w in set(t) | set(c):
        a0, p0 = (t.get(w, 0) + c.get(w, 0)) * share, share * (nt + nc)
        a, b = t.get(w, 0) + a0, c.get(w, 0) + a0
        odds = math.log(a / (nt + p0 - a)) - math.log(b / (nc + p0 - b))
        if abs(odds) / math.sqrt(1 / a + 1 / b) >= toxicity.Z_MIN:
            want[w] = odds - toxicity.WORD_COST
            spread.append((want[w], c.get(w, 0) + (share * (t.get(w, 0) + c.get(w, 0)) if want[w] > 0 else 0.0)))
    hashes = {r.h: r.w for r in spark.createDataFrame([(w,) for w in set(t) | set(c)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {hashes[int(k)]: float(v) for k, v in zip(model.keys, model.values)}
    assert set(got) == set(want) and set(foul) <= set(got) and all(got[w] == pytest.approx(want[w]) for w in want)
    rest = nc - sum(c.get(w, 0) for w in want)
    total = sum(w for _, w in spread) + rest
    law = (sum(w * math.exp(model.decay * s) for s, w in spread) + rest * math.exp(-model.decay * toxicity.WORD_COST)) / total
    assert law == pytest.approx(1.0, abs=2e-3)
    scores = {r.doc_id: r for r in toxicity.passages(df, model).collect()}
    for i in (0, 1, 4, 9):
        words = re.findall(r"[a-z0-9]+", texts[i].lower())
        per_word = np.array([want.get(w, -toxicity.WORD_COST) for w in words])
        best = max((per_word[a:b].sum() for a in range(len(words)) for b in range(a + 1, len(words) + 1)))
        segments = toxicity.maximal_segments(per_word)
        assert max((s for *_, s in segments), default=0.0) == pytest.approx(max(best, 0.0))
        found = model.segments(per_word)
        assert scores[i].score == pytest.approx(model.probability(model.evidence(found)))
    assert toxicity.passages(materialise(df.where("doc_id < 0"), "t-none"), model).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents as the pipeline may meet them: nulls in every column, repeated rows, clashing extra columns."""
    base = spark.read.parquet(f"{SF0001}/documents.parquet")
    extra = ["_row_file", "file", "pos", "body", "token_ids", "quality_score", "digest", "_drop_pos", "bucket"]
    some = base.limit(60).select("*", *[(F.col("doc_id") + i).alias(c) for i, c in enumerate(extra)])
    nulls = some.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema.fields])
    blank = some.limit(2).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(None).cast("bigint"))
    folder = str(tmp_path_factory.mktemp("odd"))
    some.unionByName(nulls).unionByName(blank).unionByName(some.limit(5)).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    some.where("doc_id < -1").write.parquet(f"{folder}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        rows = spark.read.parquet(f"{SF0001}/{t}.parquet")
        first = rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        rows.unionByName(first).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        rows.coalesce(1).write.parquet(f"{folder}/none/{t}.parquet")
    return folder


def test_stages_return_the_rows_they_keep_unchanged(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(map(str, docs.collect()))
        kept = materialise(stage(spark, docs, odd), f"t-{name}")
        assert kept.columns == docs.columns
        left = list(before)
        for row in map(str, kept.collect()):
            left.remove(row)                       # raises for a row that was not there, or not as often
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert last.count() == docs.count() and last.where("NOT decoded_ok").count() == 0
    assert corpus_pipeline.run(spark, odd).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/none").count() == 0
