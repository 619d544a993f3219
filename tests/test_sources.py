"""Files in and out, and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.sources.logical import DOMAINS, LOG
from tessera.streaming import events
from tests.conftest import SF


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("domain\ngm.com,x\n sc.com ,y\n\nnot a domain,z\njsbchina.cn")
    assert [r["domain"] for r in files.read_upload(spark, str(tmp_path / "a.csv")).collect()] == ["gm.com", "sc.com", "jsbchina.cn"]
    (tmp_path / "b.txt").write_text('"GM.com",sc.com\nsc.com')
    assert sorted(r["domain"] for r in files.all_cells(spark.read.text(str(tmp_path / "b.txt"))).collect()) == ["gm.com", "sc.com"]


def test_log(spark, tmp_path):
    rows = [{"timestamp": f"2024-01-01T00:0{i}:00Z", "batchId": "b", "event": e, "context": {"n": str(i)}} for i, e in enumerate(("batch_start", "domain_start", "batch_complete"))]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = files.log_summary(files.read_log(spark, str(tmp_path / "l.jsonl"))).collect()
    assert [(r["batchId"], r["events"], r["first_event"], r["last_event"]) for r in got] == [("b", 3, "batch_start", "batch_complete")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "id int, name string")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(str(tmp_path / "out"))
    assert sorted((r["id"], r["name"] or None) for r in back.collect()) == [(1, 'say "hi", you'), (2, None)]
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_empty_tables(spark):
    empty = DOMAINS.read(spark, SF).limit(0)
    assert files.first_cells(empty.select(F.col("domain").alias("value"))).count() == 0


def test_windows_as_stream(spark, tmp_path):
    log = LOG.read(spark, SF)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM windows").collect()[0]["n"] == log.count()


def test_stalled_stream(spark, tmp_path):
    rows = [("a", "domain_start", "2024-01-01 00:00:00"), ("b", "domain_start", "2024-01-01 00:00:00"), ("b", "domain_success", "2024-01-01 00:01:00")]
    make = lambda r: spark.createDataFrame(r, "domain string, event string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    make(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "domain string, event string, ts timestamp"
    q = events.stalled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("stalled").start()
    q.processAllAvailable()
    for i, day in enumerate(("2024-01-02 00:00:00", "2024-01-03 00:00:00")):
        make([("z" + str(i), "domain_success", day)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert [r["domain"] for r in spark.sql("SELECT domain FROM stalled").collect()] == ["a"]


def test_progress_stream(spark, tmp_path):
    """Each event counts once, whatever the micro batches and however often the stream starts again."""
    log = LOG.read(spark, SF)
    log.repartition(5).write.parquet(str(tmp_path / "in"))
    ended = log.filter("event IN ('domain_success', 'domain_failed', 'domain_timeout')").groupBy("batch_id").agg(F.count("*").alias("done"), F.count_if(F.col("event") == "domain_success").alias("successes"))
    want = {tuple(r) for r in ended.collect()}
    for _ in range(2):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        q = events.follow_progress(stream, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
        q.awaitTermination()
        got = events.progress_so_far(spark, str(tmp_path / "out"))
        assert {tuple(r) for r in got.select("batch_id", "done", "successes").collect()} == want
        assert all(0 <= r["success_rate"] <= 100 for r in got.collect())
