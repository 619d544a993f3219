"""Stalled domains and their recovery as a stream: keyed state with timers.

A domain that starts and then says nothing for five minutes of event time is stalled; the next poll, every three minutes, fails it. A timer reports stalls of domains that stay silent, a second one drops their state
after a day; what ends well leaves no state at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.rounds import new_folder
from tessera.plans.register import query
from tessera.sources.logical import LOG

G = LOG.sql
LATE = "1 hour"
#: Microseconds, as all times inside the state.
STALL, POLL, FORGET = 5 * 60_000_000, 3 * 60_000_000, 24 * 3_600_000_000
STALLS = "domain string, batch_id string, kind string, started timestamp, at timestamp"
FOUND = "domain string, batch_id string, kind string, started long, at long"
STATE = "batch_id string, started long, reported boolean"
# What recovery writes into a domain that it fails.
RECOVERY = {
    "status": "failed",
    "failure_category": "timeout",
    "recommendation": "Batch recovery cleared stuck processing",
    "technical_details": "Stuck in processing - auto-recovered by batch recovery service",
    "error_message": "Processing timeout - cleared by recovery system",
}


class Stalls(StatefulProcessor):
    """State of a domain: its last start while nothing has followed it, and whether the stall was reported. Rows of a micro batch are taken in the order of their times; a row older than the state changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.open.get() if self.open.exists() else None
        batch, started, reported = kept if kept else (None, None, False)
        for row in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            if started is not None:
                if row["us"] < started:
                    continue
                if row["us"] - started > STALL:
                    if not reported:
                        yield Row(domain=key[0], batch_id=batch, kind="stalled", started=started, at=started + STALL)
                    if row["us"] - started <= FORGET:
                        yield Row(domain=key[0], batch_id=batch, kind="resumed", started=started, at=row["us"])
            batch, started, reported = (row["batch_id"], row["us"], False) if row["event"] == "domain_start" else (None, None, False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if started is None:
            self.open.clear()
        else:
            self.open.update((batch, started, reported))
            self._wake(started, FORGET if reported else STALL)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            batch, started, reported = self.open.get()
            if reported:
                self.open.clear()
            else:
                yield Row(domain=key[0], batch_id=batch, kind="stalled", started=started, at=started + STALL)
                self.open.update((batch, started, True))
                self._wake(started, FORGET)

    def _wake(self, started: int, after: int) -> None:
        self.handle.registerTimer((started + after) // 1000)

    def close(self) -> None:
        pass


def stalls(events: DataFrame) -> DataFrame:
    """``domain, batch_id, kind, started, at`` of a stream with ``domain, batch_id, event, ts, seq``: stalled at five minutes after the start, resumed when the domain spoke again within a day."""
    watched = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select("domain", "batch_id", "event", "ts", F.unix_micros("ts").alias("us"), "seq").groupBy("domain")
    found = watched.transformWithState(Stalls(), FOUND, outputMode="Append", timeMode="EventTime")
    return found.select("domain", "batch_id", "kind", *[F.timestamp_micros(c).alias(c) for c in ("started", "at")])


@contextmanager
def keyed_state(spark: SparkSession):
    """Timers and state variables need the RocksDB store; the setting holds while the stream starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def follow(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the stream of stalls into Parquet below ``path``; each row is written once, also over restarts from ``checkpoint``."""
    with keyed_state(events.sparkSession):
        return stalls(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "3 minutes"})).start()


def log_stream(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The event log as a stream of files; the pattern stands for a single file as well as for a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stored = spark.readStream.schema(schema).options(**options).parquet(f"{sf}/events.parque[t]")
    return stored.selectExpr(*[f"{e} AS {n}" for n, e in LOG.columns.items()])


def found_stalls(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log run through the stream."""
    path = new_folder(spark, "stalls")
    follow(log_stream(spark, sf), f"{path}/rows", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(STALLS).parquet(f"{path}/rows")


def wall_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the log holds them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


STALLS_SQL = f"""(WITH o AS (SELECT domain, batch_id, event, ts, lead(ts) OVER (PARTITION BY domain ORDER BY ts, seq) AS following FROM {G} l),
  s AS (SELECT *, (SELECT max(ts) FROM o) - INTERVAL 1 HOUR AS mark FROM o WHERE event = 'domain_start' AND (following IS NULL OR following - ts > INTERVAL 5 MINUTE))
  SELECT domain, batch_id, 'stalled' AS kind, ts AS started, ts + INTERVAL 5 MINUTE AS "at" FROM s WHERE following IS NOT NULL OR ts + INTERVAL 5 MINUTE <= mark
  UNION ALL SELECT domain, batch_id, 'resumed', ts, following FROM s WHERE following - ts <= INTERVAL 24 HOUR)"""


@query("M7_stall_stream", f"SELECT * FROM {STALLS_SQL} x")
def stall_stream(spark: SparkSession, sf: str) -> DataFrame:
    return wall_times(found_stalls(spark, sf))


def polled(at: Column) -> Column:
    """The first poll at or after a time."""
    return F.timestamp_micros(F.ceil(F.unix_micros(at) / F.lit(POLL)).cast("long") * POLL)


@query(
    "M1_recovery_stream",
    f"""SELECT domain, batch_id, started, recovered_at, {', '.join(f"'{v}' AS {k}" for k, v in RECOVERY.items())}, 0.0::DOUBLE AS confidence_score, count(*) OVER (PARTITION BY batch_id, recovered_at) AS cleared
      FROM (SELECT *, make_timestamp((ceil(epoch_us("at") / 180000000.0) * 180000000)::BIGINT) AS recovered_at FROM {STALLS_SQL} x WHERE kind = 'stalled') y""",
)
def recovery_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each stalled domain as the next poll leaves it, with how many of its batch that poll cleared."""
    failed = found_stalls(spark, sf).filter("kind = 'stalled'").withColumn("recovered_at", polled(F.col("at")))
    cleared = failed.groupBy("batch_id", "recovered_at").agg(F.count("*").alias("cleared"))
    rows = failed.join(cleared, ["batch_id", "recovered_at"])
    return wall_times(rows).select("domain", "batch_id", "started", "recovered_at", *[F.lit(v).alias(k) for k, v in RECOVERY.items()], F.lit(0.0).alias("confidence_score"), "cleared")
