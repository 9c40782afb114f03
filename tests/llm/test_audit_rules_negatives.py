"""Filter audit, line-frequency rules and hard negatives against brute force, with nulls, empties, ties and clashes;
and every operator with columns that have the names it uses itself."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscore.llm import (bpe, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_join, line_rules,
                          quality, sharding, toxicity, url_filter, warc)
from tabscore.llm.common import materialise

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def pick(rnd, n):
    return " ".join(rnd.choice("ab cd Ef gh ij kl mn op qr st uv wx yz é ß 文字 # % x1 y22".split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, pick(rnd, rnd.choice([5, 30, 230])), rnd.choice(["s", "t", None])) for i in range(120)]
    rows += [(200 + i, rows[i % 4][1], "s") for i in range(40)]
    rows += [(300, None, "t"), (301, "", "s"), (302, "  \n ", None), (None, rows[0][1], "t"), (None, None, "s"),
             (303, "A" * 300, "u"), (303, "A" * 300, "u"), (304, "w w\u0085w " * 210, "u"),
             (305, "long word " * 30000, "t")]
    return materialise(spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                                             "doc_id long, text string, source string, h string, mask int, word int"), "t-docs")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 240, 2)] + [(2, True, True), (None, True, True), (999, True, True)]
    return spark.createDataFrame([(a, int(b), int(c)) for a, b, c in rows], "doc_id long, quality int, toxic int")


def brute_mask(t, first):
    w = words(t)
    t = t or ""
    return ((len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w))
            + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + 8 * any(c in "#$%&*|" for c in t) + 16 * (not first))


def test_filter_audit_against_brute_force(docs, labels):
    rows = docs.collect()
    high = 1 << 62
    smallest = {}
    for r in rows:
        k = high if r.doc_id is None else r.doc_id
        smallest[r.text or ""] = min(k, smallest.get(r.text or "", high))
    good = {r.doc_id for r in labels.collect() if r.quality and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic and r.doc_id is not None}
    all_rows = [(r.source or "", brute_mask(r.text, (high if r.doc_id is None else r.doc_id) == smallest[r.text or ""]),
                 r.doc_id in good, r.doc_id in toxic) for r in rows]
    failed = filter_audit.failed_filters(docs)
    assert sorted((r["part"], r["mask"]) for r in failed.collect()) == sorted(x[:2] for x in all_rows)
    want, removed_by = {}, {}
    for part in {x[0] for x in all_rows}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in all_rows if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out = [x for x in left if x[1] & bit]
                want[part, "".join(order), step] = [
                    len(left) - len(out), len(out), sum(bool(x[1] & bit) for x in gone),
                    sum(x[0] == part and x[1] == bit for x in all_rows), sum(x[2] for x in out), sum(x[3] for x in out)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(out)
                gone += out
                left = [x for x in left if not x[1] & bit]
    got = filter_audit.audit(filter_audit.mask_counts(failed, labels)).collect()
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        key = (r.part, r.filter_order, r.step)
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[key], key
        assert r.shapley == removed_by[r.part, r.filter_order[r.step - 1]]


def test_filter_audit_of_nothing(docs, labels):
    none = materialise(docs.where("doc_id < -1"), "t-none")
    failed = filter_audit.failed_filters(none)
    assert failed.count() == 0 and filter_audit.audit(filter_audit.mask_counts(failed, labels)).count() == 0


def test_bloom_clears_only_unique_texts(spark):
    rows = spark.range(3000).select(F.xxhash64(F.col("id") % 2900).alias("h"))
    size = filter_audit.bloom_words(3000)
    found = filter_audit.may_repeat(rows, filter_audit.counting_bloom(rows, size), size, keep=True).collect()
    seen = {}
    for r in found:
        seen.setdefault(r.h, []).append(r.maybe)
    assert all(all(m) for m in seen.values() if len(m) > 1)            # no repeat is cleared
    alone = [m[0] for m in seen.values() if len(m) == 1]
    assert sum(alone) < 0.05 * len(alone)                              # and few others are not


def brute_repeated(w, window=8):
    at = {}
    for i in range(len(w) - window + 1):
        at.setdefault(tuple(w[i:i + window]), []).append(i)
    return len({i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(window)})


def test_repeated_words_against_brute_force():
    rnd = random.Random(8)
    for n in [0, 1, 7, 8, 9, 15, 16, 17, 40, 200]:
        for kinds in (1, 2, 3, 6, 50):
            w = [b"w%d" % rnd.randrange(kinds) for _ in range(n)]
            assert line_rules.repeated_words(w) == brute_repeated(w), (n, kinds)
    some = [b"x%d" % i for i in range(30)]
    assert line_rules.repeated_words(some + [b"-"] + some[4:13] + [b"+"]) == 18


@pytest.fixture(scope="module")
def pages(spark):
    """Footer lines in many texts of a host, in other case and numbers; copies; a text that is nearly all footer."""
    rnd = random.Random(4)

    def own(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))

    rows = [(i, own(30) + "\n\nCopyright %d  THE Site\n" % (1990 + i) + own(4), "a") for i in range(15)]
    rows += [(100, own(5) + "\n" + "copyright 0 the site\n" * 20, "a"), (101, own(25) + "\ncopyright 7 the site", "b")]
    rows += [(200 + i, "the same text " * 7 + own(0), "a") for i in range(40)]
    same = own(40) + "\n" + own(9)
    rows += [(300 + i, same, None) for i in range(30)]
    rows += [(400, None, "a"), (401, "", None), (402, " \n\t\n", "a"), (None, own(25), "a"), (403, own(25), "a"),
             (403, own(25), "a"), (404, "x\ny\nx\n \nx \nx" + " z" * 20, "a"), (405, (own(50) + "\n") * 400, "b")]
    return materialise(spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows],
                                             "doc_id long, text string, source string, file int, removed string, lines double"),
                       "t-pages")


def test_line_rules_against_brute_force(pages):
    rows = pages.collect()
    norm = lambda line: re.sub("[0-9]+", "0", "".join(c.lower() if c.isascii() else c for c in " ".join(words(line))))
    holders, hosts = {}, {}
    for r in rows:
        hosts.setdefault(r.source, set()).add(r.text or "")
        for line in (r.text or "").split("\n"):
            if words(line):
                holders.setdefault((r.source, norm(line)), set()).add(r.text)
    often = {k for k, v in holders.items() if len(v) > max(10, int(len(hosts[k[0]]) * 0.001))}
    assert often == {("a", "copyright 0 the site")}
    want = []
    for r in rows:
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * brute_repeated(w) > 30 * len(w)
        left = sum(len(words(x)) for x in lines if (r.source, norm(x)) not in often)
        want.append((str(r.doc_id), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                     brute_repeated(w), base, not base and left >= 20 and left >= 0.5 * len(w)))
    got = line_rules.judged(pages).collect()
    assert sorted(want) == sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                                   r.base_failed, r.kept) for r in got)
    clean = line_rules.cleaned(pages)
    assert clean.columns == pages.columns and clean.schema == pages.schema
    kept = {r.doc_id: r for r in clean.collect()}
    assert "Copyright" not in kept[3].text and kept[3].text.count("\n") == 2 and "copyright 7" in kept[101].text
    assert kept[3].file == 1 and kept[3].removed == "x" and 100 not in kept
    assert clean.count() == sum(x[-1] for x in want)
    none = materialise(pages.where("doc_id < -1"), "t-none")
    assert line_rules.judged(none).count() == 0 and line_rules.cleaned(none).count() == 0


def brute_negatives(rows, anchor, relabel, k=5, low=80, high=100):
    import math
    use = []
    for n, (vid, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((n, vid, [math.floor(256 * float(np.float32(x))) for x in v], relabel(vid, label)))
    out = []
    order = lambda s, x: (-s, x[1] is None, x[1] or 0, x[0])
    for a in use:
        if a[1] is None or not anchor(a[1]):
            continue
        scored = [(sum(p * q for p, q in zip(a[2], x[2])), x) for x in use if x[0] != a[0] and len(x[2]) == len(a[2])]
        best = sorted((s for s in scored if s[1][3] == a[3]), key=lambda s: order(*s))[:k]
        for ps, p in best:
            inside = sorted((s for s in scored if s[1][3] != a[3] and low * ps <= 100 * s[0] <= high * ps), key=lambda s: order(*s))
            out += [(a[1], p[1], r, x[1], ps, s) for r, (s, x) in enumerate(inside[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 4000])
def test_hard_negatives_against_brute_force(spark, chunk_bytes, monkeypatch):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(4, 19))
    rows = [(int(i), (centres[i % 4] * (0.9 if i % 3 else 1.0) + rnd.normal(size=19) * 0.3).tolist(), int(i // 5 % 3)) for i in range(260)]
    rows += [(400 + i, rows[0][1], 0 if i < 9 else 1) for i in range(20)]                # ties
    rows += [(0, rows[1][1], 0), (None, rows[0][1], 1), (None, rows[0][1], 0), (20, rows[0][1], 0)]   # ids null and repeated
    rows += [(500, None, 1), (501, rows[0][1], None), (502, [float("nan")] * 19, 1), (503, [float("inf")] * 19, 1),
             (504, [None] * 19, 1), (505, [], 1), (520, [], 0), (521, [], 0), (506, [1.0, 2.0], 0), (540, [1.0, 2.0], 0),
             (541, [1.0, 1.9], 1), (542, [4000.0] * 19, 2), (560, [4000.0] * 19, 2), (561, [3900.0] * 19, 1)]
    df = materialise(spark.createDataFrame([(*r, 7, 8) for r in rows],
                                           "vec_id long, embedding array<float>, label int, v int, row int"), "t-vec")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "PAIRS", 5)
    got = hard_negatives.mine(hard_negatives.index(df.repartition(5), relabel=moved), F.col("vec_id") % 20 == 0, chunk_bytes=chunk_bytes)
    want = brute_negatives(rows, lambda i: i % 20 == 0, lambda i, x: x if i is None or i % 7 else (x + 1) % 10)
    assert sorted(str(tuple(r)) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want
    assert len(want) > 100
    none = materialise(df.where("vec_id < -1"), "t-none")
    assert hard_negatives.mine(hard_negatives.index(none), F.col("vec_id") % 20 == 0).count() == 0


def test_summaries_bound_every_score():
    rnd = np.random.default_rng(5)
    for d in (1, 3, 16, 30, 64):
        a, x = rnd.integers(-300, 300, (20, d)).astype(float), rnd.integers(-300, 300, (30, d)).astype(float)
        (ma, da), (mx, dx) = hard_negatives.summaries(a), hard_negatives.summaries(x)
        at, exact = 0, a @ x.T
        for segments in hard_negatives.LEVELS:
            n = np.diff(hard_negatives.cuts(d, segments))
            s = slice(at, at + len(n))
            middle, width = (ma[:, s] * n) @ mx[:, s].T, (da[:, s] * n) @ dx[:, s].T
            assert (exact <= middle + width + 1e-6).all() and (exact >= middle - width - 1e-6).all()
            at += len(n)


CLASHES = ["_row_file", "_row_pos", "_drop_file", "_drop_pos", "_m_file", "_n_file", "_bucket", "_rn", "_shard", "_pos", "_text",
           "_metadata", "file", "pos", "row", "bucket", "record", "position", "start", "perm", "body", "digest", "h", "w", "id",
           "size", "kept", "first"]


@pytest.fixture(scope="module")
def crowded(spark):
    rnd = random.Random(9)
    rows = [(i, pick(rnd, 40)) for i in range(30)] + [(40 + i, pick(random.Random(1), 60)) for i in range(3)] + [(50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return materialise(df.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(CLASHES)]), "t-crowded")


def same_columns(before, after):
    held = {r["doc_id"]: r for r in before.collect()}
    rows = after.select(before.columns).collect()
    assert rows and all(tuple(r) == tuple(held[r["doc_id"]]) for r in rows)
    return len(rows)


def test_columns_with_the_names_used_inside(spark, crowded):
    """Every operator and stage takes them, and returns those it returns unchanged."""
    benchmark = materialise(crowded.where("doc_id < 2").withColumnRenamed("doc_id", "item_id"), "t-items")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    web = materialise(crowded.select(F.col("doc_id").alias("page_id"), F.lit("http://example.org/es/a").alias("url"),
                                     F.col("text").alias("html"), *CLASHES), "t-web")
    n = crowded.count()
    assert same_columns(crowded, exact_dedup.keep_first_class(crowded)) == n - 2
    assert same_columns(crowded, jaccard_join.keep_one(crowded)) == n - 2
    assert same_columns(crowded, decontaminate.keep_clean(crowded, benchmark)) <= n - 2
    assert same_columns(crowded, quality.keep_accepted(crowded, labels)) <= n
    assert same_columns(crowded, sharding.shuffle_into_shards(crowded, shards=3, bucket_bytes=300)[0]) == n
    assert jaccard_join.join(crowded).count() == n
    assert line_rules.judged(crowded.withColumn("source", F.lit("s"))).count() == n
    assert filter_audit.failed_filters(crowded.withColumn("source", F.lit("s"))).count() == n
    assert url_filter.judge(web).count() == n
    assert warc.records(warc.chunk_table(spark, warc.archive(web), with_payload=False)).count() == n
    model = toxicity.fit(crowded, labels, fold=F.lit(True))
    assert same_columns(crowded.select("doc_id"), toxicity.passages(crowded, model).select("doc_id")) == n
    assert bpe.round_trip(crowded.select("doc_id", "text", "row", "pos")).count() == n


def test_warc_payloads_that_end_in_a_record_start(spark):
    """Also where a piece is cut right behind one."""
    html = ["WARC/1.1", "a\r\n\r\nWARC/1.1", "a\r\n\r\nWARC/1.1\r", "\r\n\r\nWARC/1.1\r\n", "WARC/1.1WARC/1.1", "WARC/1.1\r\n\r\n",
            "x" * 7 + "\r\n\r\nWARC/1.1 y", "WARC/1.", "", None, "\r\n\r\n", "a" * 200 + "\r\n\r\nWARC/1.1", "a" * 200 + "\r\n\r\nWARC/1.1"]
    pages = materialise(spark.createDataFrame([(i, "http://a/", h) for i, h in enumerate(html)],
                                              "page_id long, url string, html string"), "t-warc")
    for size in (1, 3, 8, 12, 19, 1 << 20):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/warc-{size}"
        warc.write(warc.plan(pages), path, size)
        found = {r.page_id: r for r in warc.records(warc.chunk_table(spark, path)).collect()}
        assert [found[i].payload_bytes for i in range(len(html))] == [len((h or "").encode()) for h in html]
        assert found[len(html) - 1].record_type == "revisit"
