"""Stalls as a stream: timers, restarts, and rows that come once."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.sources.logical import LOG
from tessera.streaming import stalls
from tests.conftest import SF

EVENT = "domain string, batch_id string, event string, ts timestamp, seq long"


def _write(spark, rows, path, number):
    folder = f"{path}/in"
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
    new = [n for n in os.listdir(folder) if n.endswith(".parquet") and n.startswith("part")]
    for n in new:
        os.rename(f"{folder}/{n}", f"{folder}/{number}-{n}")
        os.utime(f"{folder}/{number}-{n}", (1_700_000_000 + number, 1_700_000_000 + number))


def _run(spark, path):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stalls.follow(stream, f"{path}/out", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return sorted((r["domain"], r["kind"], r["started"], r["at"]) for r in spark.read.parquet(f"{path}/out").collect())


def test_timers_restarts_and_late_ends(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    path = str(tmp_path)
    _write(spark, [("a", "b1", "domain_start", at(0), 1), ("b", "b1", "domain_start", at(0), 2), ("b", "b1", "domain_success", at(4), 3), ("c", "b1", "domain_start", at(1), 4)], path, 1)
    _write(spark, [("d", "b2", "domain_start", at(180), 5), ("a", "b1", "domain_success", at(185), 6)], path, 2)
    # the watermark has passed a's and c's limits; a speaks again after its stall, d has not been silent long enough
    first = [("a", "resumed", at(0), at(185)), ("a", "stalled", at(0), at(5)), ("c", "stalled", at(1), at(6))]
    assert _run(spark, path) == first
    assert _run(spark, path) == first
    _write(spark, [("d", "b2", "domain_failed", at(183), 7), ("e", "b2", "domain_start", at(600), 8), ("c", "b1", "domain_success", at(3000), 9)], path, 3)
    # d ended in time; c spoke again too late to count as resumed; e's silence shows by the watermark of c
    assert _run(spark, path) == sorted([*first, ("e", "stalled", at(600), at(605))])


def test_log_in_pieces_equals_the_log_at_once(spark, tmp_path):
    path = str(tmp_path)
    log = LOG.read(spark, SF).select("domain", "batch_id", "event", F.col("ts").cast("timestamp").alias("ts"), "seq").orderBy("ts").collect()
    third = len(log) // 3
    for n, part in enumerate((log[:third], log[third : 2 * third], log[2 * third :])):
        _write(spark, [tuple(r) for r in part], path, n)
        _run(spark, path)
    whole = sorted((r["domain"], r["kind"], r["started"], r["at"]) for r in stalls.found_stalls(spark, SF).collect())
    assert _run(spark, path) == whole and len(whole) > 100


def test_polls(spark):
    got = spark.createDataFrame([(datetime(2024, 1, 1, 0, 3),), (datetime(2024, 1, 1, 0, 3, 0, 1),)], "t timestamp").select(stalls.polled(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [datetime(2024, 1, 1, 0, 3), datetime(2024, 1, 1, 0, 6)]
