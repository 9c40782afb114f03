"""Sources, sinks, SQL extracts and the streaming paths."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.linear import LinearModel
from tabscore.operators.scoring import score
from tabscore.sources import files, sql_extract
from tabscore.streaming import scoring as streaming

from tests.conftest import SF0001

MODEL = LinearModel(("value", "user_id"), (1.3, -0.45), -0.2, (50.0, 75.0), (50.0, 43.0))


def test_format_by_extension():
    assert files.format_for_path("a/b.PARQUET") == "parquet"
    assert files.format_for_path("a/b.csv") == "csv"
    assert files.format_for_path("a/b.txt") == "csv"
    assert files.format_for_path("a/b.jsonl") == "json"


def test_csv_inference_and_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.csv")
    with open(p, "w") as fh:
        fh.write("f0,n,d\n1.5,3,2024-01-02\n2.5,4,2024-01-03\n")
    df = files.read_file(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["double", "int", "date"]
    out = os.path.join(tmp_dir, "out.csv")
    files.write_output(df, path=out)
    back = files.read_file(spark, out, schema=df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_source_precedence(spark, tmp_dir):
    with pytest.raises(ValueError):
        files.load_input(spark)
    spark.range(3).write.mode("overwrite").saveAsTable("tabscore_prec")
    p = os.path.join(tmp_dir, "x.parquet")
    spark.range(5).write.parquet(p)
    assert files.load_input(spark, path=p, table="tabscore_prec").count() == 5
    assert files.load_input(spark, table="tabscore_prec").count() == 3


def test_no_output_returns_frame(spark):
    df = spark.range(2)
    assert files.write_output(df) is df


def test_sql_extract_binds_values_not_text(spark):
    spark.read.parquet(f"{SF0001}/orders.parquet").createOrReplaceTempView("t_orders")
    with pytest.raises(ValueError):
        sql_extract.scoring_extract(spark, "t_orders", "o_orderkey", ["o_totalprice; DROP TABLE x"],
                                    "o_orderdate", "1997-01-01")
    with pytest.raises(ValueError):
        sql_extract.scoring_extract(spark, "t_orders", "o_orderkey", ["o_totalprice"], "o_orderdate",
                                    "1997-01-01' OR '1'='1")


def test_training_extract_keeps_last_day(spark):
    df = spark.createDataFrame(
        [(1.0, 1, "2024-01-31 23:59:59"), (2.0, 0, "2024-02-01 00:00:00"), (3.0, None, "2024-01-15 00:00:00"),
         (4.0, 1, "2023-12-31 23:59:59")], "f0 double, y int, ts string"
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    df.createOrReplaceTempView("t_train")
    out = sql_extract.training_extract(spark, "t_train", ["f0"], "y", "ts", "2024-01-01", "2024-01-31",
                                       1.0, "f0")
    assert [r.f0 for r in out.collect()] == [1.0]
    assert out.columns == ["f0", "target"]


def test_stream_equals_batch(spark):
    path = f"{SF0001}/events.parquet"
    batch = {r.event_id: r.prediction for r in score(spark.read.parquet(path), MODEL).collect()}
    stream = streaming.stream_from_table(spark, path)
    out = streaming.run_available_now(streaming.score_stream(stream, MODEL), name="t-stream")
    got = {r.event_id: r.prediction for r in spark.read.parquet(out).collect()}
    assert got == batch


def test_requests_good_bad_empty(spark, tmp_dir):
    src = os.path.join(tmp_dir, "req")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.json"), "w") as fh:
        fh.write(json.dumps({"request_id": 1, "records": [{"event_id": 10, "user_id": 5, "value": 99.0},
                                                          {"event_id": 11, "user_id": 140, "value": 1.0}]}) + "\n")
        fh.write(json.dumps({"request_id": 2}) + "\n")
        fh.write(json.dumps({"request_id": 3, "records": []}) + "\n")
        fh.write("this is not json\n")
    record = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    reqs = streaming.read_requests(spark, src, record)
    replies_path = streaming.run_available_now(streaming.reply(reqs, MODEL), name="t-replies")
    replies = {r.request_id: r.predictions for r in spark.read.parquet(replies_path).collect()}
    assert set(replies) == {1, 3}
    assert [p.prediction for p in replies[1]] == [1.0, 0.0]
    assert replies[3] == []
    rej_path = streaming.run_available_now(streaming.rejects(reqs), name="t-rejects")
    reasons = sorted(r.reason for r in spark.read.parquet(rej_path).collect())
    assert reasons == ["no records", "not json"]


def test_foreach_batch_sink(spark):
    seen = []
    stream = streaming.stream_from_table(spark, f"{SF0001}/events.parquet")

    def sink(batch_df, batch_id):
        seen.append((batch_id, batch_df.count()))

    streaming.run_available_now(streaming.score_stream(stream, MODEL), foreach_batch=sink, name="t-fb")
    assert sum(n for _, n in seen) == spark.read.parquet(f"{SF0001}/events.parquet").count()


def test_idempotent_batch_sink_replay(spark, tmp_dir):
    from tabscore.operators.runlog import RunLog
    log = RunLog(spark, f"{tmp_dir}/log", run_id="s")
    out = f"{tmp_dir}/scored"
    sink = streaming.idempotent_batch_sink(out, log, query_name="q")
    batch = score(spark.read.parquet(f"{SF0001}/events.parquet"), MODEL)
    sink(batch, 0)
    sink(batch, 0)   # replay of the same batch id
    n = batch.count()
    assert spark.read.parquet(out).count() == n
    cur = {r.key: r.value for r in log.current().collect()}
    assert cur == {"rows:q:0": str(n)}
    # used as a real foreachBatch sink on a stream
    stream = streaming.stream_from_table(spark, f"{SF0001}/events.parquet")
    out2 = f"{tmp_dir}/scored2"
    streaming.run_available_now(streaming.score_stream(stream, MODEL),
                                foreach_batch=streaming.idempotent_batch_sink(out2), name="t-idem")
    assert spark.read.parquet(out2).count() == n


def test_extracts_on_date_column_with_seed(spark):
    import datetime as dt
    rows = [(i, float(i), i % 2, dt.date(2024, 1, 1) + dt.timedelta(days=i % 40)) for i in range(400)]
    spark.createDataFrame(rows, "id bigint, f0 double, y int, d date").createOrReplaceTempView("t_dates")
    full = sql_extract.training_extract(spark, "t_dates", ["f0"], "y", "d", "2024-01-10", "2024-01-19", 1.0, "id")
    assert full.count() == 100
    a = sorted(r.f0 for r in sql_extract.training_extract(spark, "t_dates", ["f0"], "y", "d", "2024-01-10",
                                                          "2024-01-19", 0.5, "id", sample_seed="s1").collect())
    b = sorted(r.f0 for r in sql_extract.training_extract(spark, "t_dates", ["f0"], "y", "d", "2024-01-10",
                                                          "2024-01-19", 0.5, "id", sample_seed="s2").collect())
    assert a != b and 30 < len(a) < 70
    from tabscore.functions.hashing import hash32
    want = sorted(r.f0 for r in spark.table("t_dates")
                  .where("d BETWEEN DATE'2024-01-10' AND DATE'2024-01-19'")
                  .where(hash32("id", "s1") < 0.5 * 4294967296.0).collect())
    assert a == want
    day = sql_extract.scoring_extract(spark, "t_dates", "id", ["f0"], "d", "2024-01-05")
    assert day.count() == 10


def test_rows_frame_preview_and_column_helpers(spark):
    from tabscore.operators import columns
    df = files.rows_frame(spark, [("Alice", 34), ("Bob", 45), ("Cathy", 29)], ["Name", "Age"])
    assert df.filter(df.Age > 26).count() == 3 and files.preview(df, 2).count() == 2
    assert columns.select_features(df, ["Age"]).columns == ["Age"]
    assert columns.drop_columns(df, "Age", "not_there").columns == ["Name"]
    assert df.select(columns.label_as("Age")).columns == ["target"]
    assert columns.append_column(df, "x", F.lit(1)).columns == ["Name", "Age", "x"]
    with pytest.raises(ValueError):
        columns.append_column(df, "Age", F.lit(1))


def test_parse_requests_and_json_replies(spark):
    record = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    lines = [json.dumps({"request_id": 1, "records": [{"event_id": 10, "user_id": 5, "value": 99.0}]}),
             json.dumps({"request_id": 2}), "not json at all", json.dumps({"request_id": 3, "records": []})]
    msgs = spark.createDataFrame([(l,) for l in lines], "value string")
    reqs = streaming.parse_requests(msgs, record)
    out = {r.key: json.loads(r.value) for r in streaming.replies_as_json(streaming.reply(reqs, MODEL)).collect()}
    assert out == {"1": {"predictions": [{"event_id": 10, "user_id": 5, "value": 99.0, "prediction": 1.0}]},
                   "3": {"predictions": []}}
    assert sorted(r.reason for r in streaming.rejects(reqs).collect()) == ["no records", "not json"]


def test_stream_restart_resumes_from_checkpoint(spark, tmp_dir):
    events = spark.read.parquet(f"{SF0001}/events.parquet")
    src, out, ckpt = (os.path.join(tmp_dir, d) for d in ("src", "out", "ckpt"))
    events.where("event_id % 2 = 0").write.parquet(os.path.join(src, "part-a"))
    schema = events.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        streaming.run_available_now(streaming.score_stream(stream, MODEL), path=out, checkpoint=ckpt,
                                    name="t-restart")

    run()
    first = spark.read.parquet(out).count()
    events.where("event_id % 2 = 1").write.parquet(os.path.join(src, "part-b"))
    run()                          # a new query on the same checkpoint: only the new file is read
    back = spark.read.parquet(out)
    assert first < back.count() == events.count()
    assert back.select("event_id").distinct().count() == events.count()


def test_orc_and_json_dispatch_roundtrip(spark, tmp_dir):
    df = spark.read.parquet(f"{SF0001}/customer.parquet")
    for ext in ("orc", "json"):
        path = os.path.join(tmp_dir, f"customer.{ext}")
        files.write_output(df, path=path)
        back = files.read_file(spark, path, schema=df.schema)
        assert files.format_for_path(path) == ext
        assert sorted(back.collect()) == sorted(df.collect())


def test_a_killed_and_replayed_stream_leaves_one_output_and_log_row_a_batch(spark, tmp_dir):
    """The stream dies after a batch's output and log are written, before Spark notes the batch as done."""
    from tabscore.operators.runlog import RunLog
    from tabscore.streaming import scoring as streaming
    for i in range(4):
        spark.range(i * 10, i * 10 + 5 + i).coalesce(1).write.parquet(f"{tmp_dir}/in/part={i}")
    log = RunLog(spark, f"{tmp_dir}/log", run_id="s")
    sink = streaming.idempotent_batch_sink(f"{tmp_dir}/out", log)
    died = []

    def fragile(batch, batch_id):
        sink(batch, batch_id)
        if batch_id in (1, 3) and batch_id not in died:
            died.append(batch_id)
            raise RuntimeError("killed")

    source = f"{tmp_dir}/in/part=*"
    for attempt in range(3):
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        try:
            streaming.run_available_now(stream, foreach_batch=fragile, checkpoint=f"{tmp_dir}/ckpt")
        except Exception:
            assert attempt < 2
    assert died == [1, 3]
    out = spark.read.parquet(f"{tmp_dir}/out")
    counts = {r.batch_id: r["count"] for r in out.groupBy("batch_id").count().collect()}
    rows = log.table().collect()
    assert {int(r.key.rsplit(":", 1)[1]): int(r.value) for r in rows} == counts and len(rows) == len(counts)
    assert out.count() == out.distinct().count() == 5 + 6 + 7 + 8


CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": ""}


@pytest.fixture()
def small_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts_with_everything(n=120):
    import random
    rnd = random.Random(12)
    part = ["a", "word", " ", "\n", "\n\n", '"', '""', ",", "é文", "\\", "\\N", "'", "x" * 50, "\t"]
    return [None if i % 17 == 0 else "".join(rnd.choice(part) for _ in range(rnd.choice([0, 1, 3, 8, 30]))) for i in range(n)]


def test_csv_blocks_read_what_the_whole_file_reader_reads(spark, tmp_dir, small_blocks):
    """Random texts; records over many blocks; blocks that begin inside a field, that hold no record start at all."""
    from tabscore.sources.csv_blocks import read_csv_blocks
    rows = [(i, t, float(i) / 3) for i, t in enumerate(texts_with_everything())]
    df = spark.createDataFrame(rows, "id int, text string, x double").coalesce(2)
    path = f"{tmp_dir}/t.csv"
    files.write_file(df, path, null_value="\\N")
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 40
    got = read_csv_blocks(spark, path, df.schema, True, {k: v for k, v in CSV_OPTIONS.items() if k != "header"})
    want = spark.read.options(multiLine=True, **CSV_OPTIONS).schema(df.schema).csv(path)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("content,rows", [
    ("", []), ("a,b\n", []), ("a,b\n1,x", [("1", "x")]), ("a,b\r\n1,x\r\n2,y\r\n", [("1", "x"), ("2", "y")]),
    ('a,b\n1,"p\r\nq"\r\n\n2,z\n', [("1", "p\r\nq"), ("2", "z")]), ('"a\nb","c"\n1,x\n', [("1", "x")]),
    ('a,b\n1,"' + "long line\n" * 40 + '"\n2,y\n', [("1", "long line\n" * 40), ("2", "y")]),
    ('a,b\n"1\n","2""\n"\n"3"",\n","4"\n', [("1\n", '2"\n'), ('3",\n', "4")])])
def test_csv_blocks_edges(spark, tmp_dir, small_blocks, content, rows):
    from tabscore.sources.csv_blocks import read_csv_blocks
    with open(f"{tmp_dir}/e.csv", "w", newline="") as f:
        f.write(content)
    got = read_csv_blocks(spark, f"{tmp_dir}/e.csv", "a string, b string", True, {"quote": '"', "escape": '"'})
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    headless = read_csv_blocks(spark, f"{tmp_dir}/e.csv", "a string, b string", False, {"quote": '"', "escape": '"'})
    assert headless.count() == len(rows) + bool(content)


def test_one_large_csv_file_is_read_by_many_tasks(spark, tmp_dir):
    df = spark.range(60_000).select("id", F.concat(F.lit("line one\nline \"two\" of "), F.col("id").cast("string"), F.lit("\n" + "pad " * 20)).alias("t"))
    path = f"{tmp_dir}/large.csv"
    files.write_file(df.coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(512 * 1024))
    try:
        back = files.read_file(spark, path, schema=df.schema)
        assert spark.read.text(path).rdd.getNumPartitions() >= 8
        assert back.exceptAll(df).count() == 0 and back.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_day_is_replaced_and_one_partition_read(spark, tmp_dir, capsys):
    from tabscore.plans import jobs
    rows = [(i, float(i), float(i % 3), f"2024-01-0{i % 3 + 1}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, value double, user_id double, d string").withColumn("d", F.to_date("d"))
    files.write_file(df, f"{tmp_dir}/in.parquet", partition_by=["d"])
    jobs.score_job(spark, MODEL, input_path=f"{tmp_dir}/in.parquet", output_path=f"{tmp_dir}/out.parquet", partition_by=["d"])
    before = {r.id: r.prediction for r in spark.read.parquet(f"{tmp_dir}/out.parquet").collect()}
    flipped = LinearModel(MODEL.features, tuple(-c for c in MODEL.coefficients), -MODEL.intercept, MODEL.means, MODEL.scales)
    for _ in range(2):
        scored, n = jobs.score_day_job(spark, flipped, date_column="d", day="2024-01-02", input_path=f"{tmp_dir}/in.parquet",
                                       output_path=f"{tmp_dir}/out.parquet")
        assert n == 10
    capsys.readouterr()
    scored.explain()
    plan = capsys.readouterr().out
    filters = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    assert "2024-01-02" in filters
    after = {r.id: r.prediction for r in spark.read.parquet(f"{tmp_dir}/out.parquet").collect()}
    assert len(after) == 30 and all(after[i] == (1.0 - before[i] if i % 3 == 1 else before[i]) for i in after)
    with pytest.raises(ValueError):
        files.write_file(df, f"{tmp_dir}/x.parquet", mode="replace_partitions")


def test_a_table_replaces_the_partitions_that_are_written(spark):
    import uuid
    name = f"tabscore_daily_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "n int, v string, day string")
    files.write_table(df, name, mode="replace_partitions", partition_by=["day"])
    files.write_table(df.where("n = 1").select("day", "v", (F.col("n") + 10).alias("n")), name, mode="replace_partitions", partition_by=["day"])
    assert sorted(map(tuple, spark.table(name).select("n", "v", "day").collect())) == [(3, "c", "y"), (11, "a", "x")]
