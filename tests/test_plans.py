"""Physical-plan shape of the core queries: the properties that matter at scale."""

import re

from pyspark.sql import functions as F

from tabscore.operators import profile, runlog
from tabscore.plans import catalogue as c

from tests.conftest import SF0001


def plan(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


def read_schema(text: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


def test_native_scoring_is_one_narrow_stage(spark, capsys):
    p = plan(c.q_score_lineitem(spark, SF0001), capsys)
    assert "Exchange" not in p and "PythonUDF" not in p and "MapInPandas" not in p
    [schema] = read_schema(p)
    assert "l_returnflag" not in schema and "l_shipdate" not in schema  # pruned to 6 columns
    assert schema.count(":") == 6
    assert "WholeStageCodegen" in p or "[codegen id" in p


def test_extract_filters_reach_the_scan(spark, capsys):
    p = plan(c.q_scoring_extract(spark, SF0001), capsys)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    p = plan(c.q_training_extract(spark, SF0001), capsys)
    assert "GreaterThanOrEqual(l_shipdate" in re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)


def test_metrics_aggregate_map_side_and_prune_text(spark, capsys):
    from tabscore.operators import metrics
    p = plan(metrics.evaluate(c.labelled_documents(spark, SF0001), c.DOC_MODEL, "quality"), capsys)
    assert "partial_count" in p
    assert all("text" not in s for s in read_schema(p))


def test_python_scoring_reads_only_requested_columns(spark, capsys):
    p = plan(c.q_score_python(spark, SF0001), capsys)
    [schema] = read_schema(p)
    assert set(re.findall(r"(\w+):", schema)) == {"event_id", "user_id", "value"}


def test_many_models_no_join_no_exchange(spark, capsys):
    p = plan(c.q_score_many(spark, SF0001), capsys)
    assert "Join" not in p and "Exchange" not in p


def test_keyed_sample_and_split_filters_are_narrow(spark, capsys):
    assert "Exchange" not in plan(c.q_keyed_sample(spark, SF0001), capsys)
    assert "Exchange" not in plan(c.q_exact_split(spark, SF0001), capsys)


def test_latest_value_sorts_no_raw_log(spark, capsys):
    """The order columns are hash-aggregated over the raw log; only each key's last rows reach a sorted aggregate."""
    p = plan(c.q_runlog_current(spark, SF0001), capsys)
    assert "Window" not in p and "max_by" not in p
    nodes = [n for n in p.split("\n\n") if "partial_max(ts" in n or "partial_max(seq" in n]
    assert nodes and all("HashAggregate" in n.splitlines()[0] for n in nodes)


def test_hot_key_third_of_rows(spark, capsys):
    # one run holds a third of the log: still one partial row per task, and the right answer
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("run_id"),
        F.lit("k").alias("key"), F.col("id").cast("double").alias("value"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq")).repartition(6)
    got = {r.run_id: r.value for r in runlog.latest_per_key(df, ["run_id", "key"], ["value"], ["ts", "seq"]).collect()}
    assert got[0] == float(n - 3)
    counts = {r.run_id: r["count"] for r in profile.value_counts(df, "run_id").collect()}
    assert counts[0] == n // 3
    assert "partial_count" in plan(profile.value_counts(df, "run_id"), capsys)


def test_day_window_pushdown_and_last_day(spark, capsys):
    import datetime as dt
    from tabscore.functions.dates import day_window, on_day
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    w = orders.where(day_window(orders, "o_orderdate", "1997-01-01", dt.datetime(1997, 1, 31, 8)))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan(w, capsys)).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    want = orders.where("CAST(o_orderdate AS DATE) BETWEEN DATE'1997-01-01' AND DATE'1997-01-31'").count()
    assert w.count() == want
    d = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "d date")
    assert d.where(on_day(d, "d", "2024-01-31")).count() == 1


def test_no_query_plans_pairs_or_single_task_windows(spark, capsys):
    import __spark_entry__ as entry
    for name, fn in c.QUERIES.items():
        p = plan(fn(spark, SF0001), capsys)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "WindowGroupLimit"):
            assert bad not in p, (name, bad)
        # the CSV reader's windows run over the blocks of each file, never over rows
        windows = [n for n in p.split("\n\n") if ") Window" in n.splitlines()[0]]
        assert all("[file#" in n for n in windows) and (not windows or name.startswith("csv_")), name


def test_bucketed_tables_join_without_exchange(spark, capsys):
    from tabscore.operators import metrics
    from tabscore.sources.files import write_bucketed
    write_bucketed(spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "n_chars"),
                   "tabscore_docs_b", "doc_id", 8)
    write_bucketed(spark.read.parquet(f"{SF0001}/labels.parquet"), "tabscore_labels_b", "doc_id", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the shuffle join path
    try:
        data = spark.table("tabscore_docs_b").join(spark.table("tabscore_labels_b"), "doc_id")
        p = plan(data, capsys)
        assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
        m = metrics.evaluate(data, c.DOC_MODEL, "quality").first()
        assert m.n == spark.read.parquet(f"{SF0001}/labels.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
