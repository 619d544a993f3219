"""Streams of log events. Windows with watermarks are an extension; the recovery poll is the application's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.register import query
from tessera.sources.logical import LOG

G = LOG.sql
LATE = "1 hour"


def windowed(events: DataFrame, length: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event; for streams late events count up to the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event").agg(F.count("*").alias("n"), F.sum(F.round(F.col("ms") * 100).cast("long")).alias("cents"))


@query("EXT_tumbling", f"SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event, count(*) AS n, sum(cast(round(ms * 100) AS BIGINT))::BIGINT AS cents FROM {G} l GROUP BY ALL")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return windowed(LOG.read(spark, sf)).select(F.col("w.start").alias("start"), "event", "n", "cents")


@query(
    "EXT_sessions",
    f"""SELECT domain, min(ts) AS start, count(*) AS n FROM (SELECT domain, ts, sum(new) OVER (PARTITION BY domain ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT domain, ts, seq,
        CASE WHEN ts - lag(ts) OVER (PARTITION BY domain ORDER BY ts, seq) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM {G} l) x) y GROUP BY domain, session""",
)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a domain's events with less than two hours between them."""
    return LOG.read(spark, sf).groupBy("domain", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("domain", F.col("w.start").alias("start"), "n")


@query("M1_recovery", f"SELECT batch_id, domain, max(ts) AS last_ts FROM {G} l GROUP BY batch_id, domain HAVING arg_max(event, {{'t': ts, 's': seq}}) = 'domain_start' AND max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 5 MINUTE")
def recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Domains whose last event is a start more than five minutes old."""
    last = LOG.read(spark, sf).groupBy("batch_id", "domain").agg(F.max_by("event", F.struct("ts", "seq")).alias("event"), F.max("ts").alias("last_ts"))
    return last.filter("event = 'domain_start' AND last_ts < timestamp'2024-01-31' - INTERVAL 5 MINUTES").select("batch_id", "domain", "last_ts")


@query("M3_progress", f"SELECT batch_id, seq // 300 AS step, count(*) AS done, sum(count(*)) OVER (PARTITION BY batch_id ORDER BY seq // 300)::BIGINT AS so_far FROM {G} l WHERE event = 'domain_success' GROUP BY batch_id, seq // 300")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress after each micro batch of the log."""
    from pyspark.sql import Window

    step = F.floor(F.col("seq") / 300)
    per = LOG.read(spark, sf).filter("event = 'domain_success'").groupBy("batch_id", step.alias("step")).agg(F.count("*").alias("done"))
    return per.withColumn("so_far", F.sum("done").over(Window.partitionBy("batch_id").orderBy("step")))


def stalled(events: DataFrame, minutes: int = 5) -> DataFrame:
    """As a stream: a row for each domain that starts and then says nothing for so many minutes of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (started,) = state.get
            state.remove()
            yield pd.DataFrame({"domain": [key[0]], "started": [pd.Timestamp(started, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        last = rows.iloc[-1]
        if last["event"] == "domain_start":
            at = int(last["ts"].timestamp() * 1000)
            state.update((at,))
            state.setTimeoutTimestamp(max(at + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    watched = events.withWatermark("ts", LATE).select("domain", "event", "ts").groupBy("domain")
    return watched.applyInPandasWithState(step, "domain string, started timestamp", "started long", "append", GroupStateTimeout.EventTimeTimeout)


def follow_progress(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a stream that writes each micro batch's finished and failed domains per batch below ``path``. A micro batch that runs again overwrites its own part, so each event
    counts once."""

    def add(rows: DataFrame, number: int) -> None:
        ended = rows.filter(F.col("event").isin("domain_success", "domain_failed", "domain_timeout"))
        done = ended.groupBy("batch_id").agg(F.count("*").alias("done"), F.count_if(F.col("event") == "domain_success").alias("successes"))
        done.write.mode("overwrite").parquet(f"{path}/step={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 minutes"})).start()


def progress_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, done, successes, success_rate`` of all micro batches yet."""
    total = spark.read.parquet(path).groupBy("batch_id").agg(F.sum("done").alias("done"), F.sum("successes").alias("successes"))
    return total.withColumn("success_rate", F.round(F.col("successes") * 100.0 / F.col("done"), 2))
