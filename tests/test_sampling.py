"""Keyed samples, exact/approx splits and rank selection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscore.functions.hashing import hash32
from tabscore.operators import sampling, selection

from tests.conftest import SF0001


def test_hash_matches_duckdb(spark):
    import duckdb
    from tabscore.functions.hashing import sql_hash32
    df = spark.range(0, 500).withColumn("h", hash32("id", 42))
    got = {r.id: r.h for r in df.collect()}
    con = duckdb.connect()
    want = dict(con.execute(f"SELECT id, {sql_hash32(['id'], 42)} FROM range(500) t(id)").fetchall())
    assert got == want


def test_keyed_sample_is_repeatable_and_partition_independent(spark):
    df = spark.range(0, 5000)
    a = sorted(r.id for r in sampling.keyed_sample(df, 0.3, "id", 1).collect())
    b = sorted(r.id for r in sampling.keyed_sample(df.repartition(13), 0.3, "id", 1).collect())
    assert a == b and 1300 < len(a) < 1700
    assert sampling.keyed_sample(df, 1.0, "id").count() == 5000


@pytest.mark.parametrize("n,f", [(1, 0.2), (10, 0.2), (50, 0.2), (6001, 0.2), (1000, 0.5), (999, 0.01)])
def test_exact_split_sizes_and_order(spark, n, f):
    df = spark.range(0, n).withColumnRenamed("id", "k")
    train, test = sampling.split_exact(df, f, "k", 42)
    k = math.ceil(n * f)
    got = sorted(r.k for r in test.collect())
    assert len(got) == k
    assert train.count() + k == n
    # brute force: the k rows smallest by (hash, key)
    rows = sorted((r.h, r.k) for r in df.withColumn("h", hash32("k", 42)).collect())
    assert got == sorted(k_ for _, k_ in rows[:k])


def test_exact_split_ties_broken_by_key(spark):
    # many rows share a hash when the key is a constant-ish column: (hash, key) order still exact
    df = spark.range(0, 300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    train, test = sampling.split_exact(df, 0.25, ["g", "k"], 5)
    rows = sorted((r.h, r.g, r.k) for r in df.withColumn("h", hash32(["g", "k"], 5)).collect())
    assert sorted((r.g, r.k) for r in test.collect()) == sorted((g, k) for _, g, k in rows[:75])


def test_approx_split_partition(spark):
    df = spark.range(0, 2000)
    train, test = sampling.split_approx(df, 0.2, "id", 42)
    assert train.count() + test.count() == 2000
    assert not set(r.id for r in train.collect()) & set(r.id for r in test.collect())


def test_select_ranks_matches_sort(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 7.25), rng.exponential(size=500) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    srt = np.sort(vals)
    ranks = [1, 2, 100, 2999, 3000, 3001, 4000, 4500, 5000]
    got = selection.select_ranks(df, [("x", r) for r in ranks], bins=64)
    assert got == [float(srt[r - 1]) for r in ranks]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    vals = rng.gamma(2.0, 3.0, size=2001)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    q = selection.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])
    for p in (0.25, 0.5, 0.75):
        assert abs(q[("x", p)] - float(np.quantile(vals, p))) < 1e-12


def test_split_on_test_table(spark):
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    train, test = sampling.split(orders, 0.2, "o_orderkey")
    n = orders.count()
    assert test.count() == math.ceil(n * 0.2) and train.count() == n - test.count()


def test_exact_split_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], "k bigint")
    train, test = sampling.split_exact(empty, 0.2, "k")
    assert train.count() == 0 and test.count() == 0
    # a NULL key has a hash of its own
    df = spark.createDataFrame([(None,)] + [(i,) for i in range(12)], "k bigint")
    train, test = sampling.split_exact(df, 0.2, "k")
    assert test.count() == 3 and train.count() == 10


def test_many_probes_use_fewer_bins(spark, monkeypatch):
    monkeypatch.setattr(selection, "ROUND_BUDGET", 256)
    rng = np.random.default_rng(5)
    cols = {f"c{i}": rng.normal(size=400) for i in range(6)}
    rows = list(zip(*[map(float, v) for v in cols.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    q = selection.exact_quantiles(df, list(cols), [0.1, 0.5, 0.9])
    for c, v in cols.items():
        for p in (0.1, 0.5, 0.9):
            assert abs(q[(c, p)] - float(np.quantile(v, p))) < 1e-12


def test_select_ranks_with_infinities(spark):
    vals = [float("-inf"), -2.0, 0.5, 3.0, float("inf"), float("inf"), 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    srt = sorted(vals)
    got = selection.select_ranks(df, [("x", r) for r in range(1, len(vals) + 1)])
    assert got == srt


def test_xxhash_split_exact_and_repeatable(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    train, test = sampling.split_exact(df, 0.3, "k", 11, algorithm="xxhash64")
    got = sorted(r.k for r in test.collect())
    assert len(got) == 900 and train.count() == 2100
    rows = sorted((r.h, r.k) for r in df.withColumn("h", hash32("k", 11, "xxhash64")).collect())
    assert got == sorted(k for _, k in rows[:900])
    again = sorted(r.k for r in sampling.split_exact(df.repartition(5), 0.3, "k", 11, algorithm="xxhash64")[1].collect())
    assert again == got
    assert all(0 <= h < 2 ** 32 for h, _ in rows)


def test_two_value_bin_resolves_in_one_round(spark, monkeypatch):
    calls = []
    orig = selection._histogram
    monkeypatch.setattr(selection, "_histogram", lambda *a, **k: calls.append(1) or orig(*a, **k))
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 60.0, 99.0, 100.0)], "x double")
    # 4 bins over [0, 100]: {0,1,2} | {} | {60} | {99,100}
    got = selection.select_ranks_detail(df, [("x", 4), ("x", 5), ("x", 6)], bins=4)
    assert [(t.value, t.below, t.ties) for t in got] == [(60.0, 3, 1), (99.0, 4, 1), (100.0, 5, 1)]
    assert len(calls) == 1


def test_exact_split_hot_key_stays_whole(spark):
    # one key holds a third of the rows; the others are unique
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    train, test = sampling.split_exact(df, 0.5, "k", 42)
    te = [r.k for r in test.collect()]
    tr = [r.k for r in train.collect()]
    assert len(te) + len(tr) == n                     # nothing dropped
    assert not (-1 in te and -1 in tr)                # the hot key is not split
    k = math.ceil(n * 0.5)
    hot = n // 3
    assert k <= len(te) < k + hot                     # at most one key group beyond k
    # brute force: whole keys in (hash, key) order until k rows are covered
    order = sorted({(r.h, r.k) for r in df.withColumn("h", hash32("k", 42)).collect()})
    counts = {key: (hot if key == -1 else 1) for _, key in order}
    taken, want = 0, set()
    for _, key in order:
        if taken >= k:
            break
        want.add(key)
        taken += counts[key]
    assert set(te) == want


def test_exact_split_null_key_in_tie_group(spark):
    # NULL and '' are different keys, each a tie group of three rows
    rows = [(None,)] * 3 + [("",)] * 3 + [(f"k{i}",) for i in range(4)]
    df = spark.createDataFrame(rows, "k string")
    for f in (0.1, 0.3, 0.5, 0.8):
        train, test = sampling.split_exact(df, f, "k", 42)
        te, tr = test.count(), train.count()
        assert te + tr == len(rows) and te >= math.ceil(len(rows) * f)


def test_different_keys_never_make_one_text(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("", "x"), ("~", "x"), ("1:a", "b"), ("1", "a1:b")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert len({r[0] for r in df.select(hash32(["a", "b"], 1)).collect()}) == len(rows)
    import duckdb
    from tabscore.functions.hashing import sql_hash32
    con = duckdb.connect()
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)
    for seed in (None, 5):
        got = sorted(r[0] for r in df.select(hash32(["a", "b"], seed)).collect())
        assert got == sorted(r[0] for r in con.execute(f"SELECT {sql_hash32(['a', 'b'], seed)} FROM (VALUES {values}) t(a, b)").fetchall())


@pytest.mark.parametrize("few", [0, 4096])
def test_hash_rank_against_a_sort(spark, monkeypatch, few):
    """Every rank, with ties and hashes at both ends, whether the last round comes early or not."""
    monkeypatch.setattr(sampling, "FEW_ROWS", few)
    rng = np.random.default_rng(1)
    values = [0, 0, 2**32 - 1, 2**21, 2**21 - 1, 2**10] + [int(v) for v in rng.integers(0, 2**32, 40)] + [77] * 9
    df = spark.createDataFrame([(v,) for v in values], "h bigint").coalesce(2)
    order = sorted(values)
    for rank in (1, 2, 3, 12, 30, len(values)):
        v = order[rank - 1]
        assert sampling.hash_rank(df, "h", lambda n: rank) == (v, order.index(v), values.count(v), len(values))
    assert sampling.hash_rank(df.where("h < 0"), "h", lambda n: 1) is None


def test_split_with_the_hash_carried_reads_no_key_again(spark, capsys):
    df = spark.range(1000).withColumn("hash", hash32("id", 42))
    plain, carried = sampling.split_exact(df, 0.3, "id"), sampling.split_exact(df, 0.3, "id", hash_column="hash")
    assert [p.count() for p in plain] == [c.count() for c in carried] == [700, 300]
    assert plain[1].exceptAll(carried[1]).count() == 0


def test_a_round_of_the_split_has_few_partial_rows(spark):
    """At most 2,048 groups a task, however many rows: the plan counts bins, not hashes."""
    df = spark.range(60_000).withColumn("h", hash32("id", 42))
    bins = df.groupBy(F.shiftright("h", sampling.ROUND_BITS[0]).alias("b")).count()
    assert bins.count() <= 2048 and [32 - sampling.ROUND_BITS[0], sampling.ROUND_BITS[0] - sampling.ROUND_BITS[1],
                                     sampling.ROUND_BITS[1]] == [11, 11, 10]
