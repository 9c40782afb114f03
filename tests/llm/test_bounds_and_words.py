"""Joins that keep no key in one task, sizes that are measured, words of every script, rollups by any tokenizer."""

import random

import pytest
from pyspark.sql import functions as F

from tabscore.llm import bpe, common, decontaminate, jaccard_join, token_rollup
from tabscore.llm.common import components, join_counted, materialise, measured_bytes
from tabscore.session import scratch_path


def test_join_counted_equals_a_join(spark, monkeypatch):
    rows = materialise(spark.range(3000).select((F.sqrt("id").cast("long") % 17).alias("k"), "id"), "t-rows")
    groups = materialise(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "t-groups")
    want = sorted(map(tuple, rows.join(groups, "k").collect()))
    for hot in (0, 150, 10**6):
        assert sorted(map(tuple, join_counted(rows, groups, "k", "n", hot).collect())) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, join_counted(rows, groups, "k", "n", 0).collect())) == want


@pytest.mark.parametrize("hot", [5, 4096])
def test_components_of_large_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    edges = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 150)] + [(59, 200), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 60), 200]}, **{i: 100 for i in range(100, 151)}, 300: 300, 301: 300}


def test_buckets_with_hot_paths(spark, monkeypatch):
    paths = spark.range(900).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id") % 40).alias("path"), F.col("id").alias("rep"),
                                    F.lit(None).cast("long").alias("parent"))
    final, large = jaccard_join.sized(paths, "t-sized")
    size = {r.path: r["count"] for r in paths.groupBy("path").count().collect()}
    got = {(r.path, r.rep): r.size for r in final.unionByName(large).collect()}
    assert got == {(r.path, r.rep): size[r.path] for r in paths.collect() if size[r.path] > 1}
    assert {r.path for r in large.collect()} == {p for p, n in size.items() if n > jaccard_join.BUCKET}


def test_measured_bytes_see_long_values(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2, 3], None), (None, None, bytearray(b"ab"))], "s string, a array<long>, b binary")
    assert measured_bytes(df, 10) == (2, 1000 + 24 + 2 + 20)


# ---------------------------------------------------------------- decontamination

def find(spark, docs, items):
    d = materialise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "t-d")
    b = materialise(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "t-b")
    return {(r.doc_id, r.item_id): r.coverage for r in decontaminate.matches(d, b, any_case=True).collect()}


def test_items_without_spaces_and_of_few_words(spark):
    zh = "请问在下列四个选项当中哪一个城市是中华人民共和国的首都"
    th = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทยและมีประชากรมากที่สุด"
    docs = [zh, "前言。" + zh + "。后记在这里", "完全不同的一段文字没有任何相同的内容可以比较", th + " abc", "hello world", "Hello,  WORLD!",
            "say hello world again", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉", "", None]
    items = [zh, th, "hello world", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉", "lonely", "", None]
    assert set(find(spark, docs, items)) == {(0, 0), (1, 0), (3, 1), (4, 2), (5, 2), (7, 3)}


def test_decontamination_against_brute_force(spark):
    """Literal words only, copies in place: coverage is the share of equal windows, by plain Python."""
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "q" + "".join(rnd.choices(letters, k=7))
    items = [[word() for _ in range(rnd.choice([3, 7, 8, 12, 20, 40]))] for _ in range(30)]
    docs = []
    for n in range(300):
        item = list(rnd.choice(items))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            item[rnd.randrange(len(item))] = word()
        docs.append([word() for _ in range(rnd.randrange(30))] + (item if n % 3 else []) + [word() for _ in range(rnd.randrange(30))])
    want = {}
    size = decontaminate.WINDOW
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            n = min(size, len(t))
            here = {tuple(d[k:k + n]) for k in range(len(d) - n + 1)}
            hits = [tuple(t[k:k + n]) in here for k in range(len(t) - n + 1)]
            run = best = 0
            for h in hits:
                run = run + 1 if h else 0
                best = max(best, run)
            if sum(hits) >= decontaminate.COVERAGE * len(hits) or best and best + n - 1 >= decontaminate.RUN:
                want[i, j] = sum(hits) / len(hits)
    got = find(spark, [" ".join(d) for d in docs], [" ".join(t) for t in items])
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k] == pytest.approx(want[k]) for k in want if want[k] >= decontaminate.COVERAGE)


# ---------------------------------------------------------------- token counts

TEXTS = [None, "", "  ", "four short words here", "Привет, мир и все", "这是 一个 文本", "naïve café", "x" * 50000, "a b " * 20000, "a\tb\r\nc"]


def test_rollup_counts_tokens_of_any_tokenizer(spark):
    rows = [(i, t, "s" if i % 2 else None, "l", 1, "c") for i, t in enumerate(TEXTS)]
    docs = materialise(spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string, lang string, counts int, tokenizer string"), "t-tok")
    counters = {**token_rollup.VERSIONS, "bpe": token_rollup.bpe_counter(spark)}
    counted = token_rollup.counted(docs, counters=counters)
    got = {r.doc_id: r.counts for r in counted.collect()}
    want = {r.doc_id: r.n_tokens for r in bpe.encode(docs.select("doc_id", "text")).collect()}
    assert {k: c["bpe"] or 0 for k, c in got.items()} == {k: n or 0 for k, n in want.items()}
    assert [got[i]["words-v2"] for i in range(8)] == [0, 0, 0, 4, 4, 3, 2, 1] and got[9]["words-v1"] == 3
    path = scratch_path(spark, "t-rollup")
    assert token_rollup.commit(token_rollup.signed(counted, "bpe", 1), path, 0)
    assert not token_rollup.commit(token_rollup.signed(counted, "bpe", 1), path, 0)      # a replay
    total = {r.source: (r.docs, r.tokens) for r in token_rollup.totals(spark, path).collect()}
    assert sum(d for d, _ in total.values()) == len(TEXTS) + 1 and None in total
    assert sum(n for _, n in total.values()) == sum(n or 0 for n in want.values())
    token_rollup.commit(token_rollup.revised(counted, "bpe", "words-v1"), path, 1)
    token_rollup.commit(token_rollup.signed(counted, "words-v1", -1), path, 2)
    assert token_rollup.totals(spark, path).count() == 0


def test_rollup_of_an_empty_table(spark):
    none = materialise(spark.createDataFrame([], "doc_id long, text string, source string, lang string"), "t-none")
    path = scratch_path(spark, "t-rollup")
    token_rollup.commit(token_rollup.signed(token_rollup.counted(none), "words-v1", 1), path, 0)
    assert token_rollup.totals(spark, path).count() == 0


def test_a_batch_that_dies_before_it_is_published_leaves_no_trace(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "s", "l")], "doc_id long, text string, source string, lang string")
    rows, path = token_rollup.signed(token_rollup.counted(docs), "words-v1", 1), scratch_path(spark, "t-rollup")
    token_rollup.commit(rows, path, 0)
    with monkeypatch.context() as m:
        m.setattr(token_rollup, "publish_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            token_rollup.commit(rows, path, 1)
    assert token_rollup.totals(spark, path).first().tokens == 2
    assert token_rollup.commit(rows, path, 1) and token_rollup.totals(spark, path).first().tokens == 4
