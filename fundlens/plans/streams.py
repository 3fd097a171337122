"""Queries that run a stream over the events there are and compare with the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..storage import new_path
from ..streaming import ticks as stream_ops
from . import sql as q
from .market import FRESHNESS_NOW
from .registry import catalog


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tables.as_ticks(stream_ops.read_stream(spark, folder, "events"))


@catalog.query(
    "stream_bars",
    q.given(q.TICKS, q.BARS)
    + """SELECT code, strftime(ts, '%Y-%m-%d') AS day, o, h, l, c, v, ticks FROM bars
WHERE ts + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM ticks) - INTERVAL 1 DAY""",
)
def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Day bars the watermark has closed; the last open days are not out yet."""
    bars = stream_ops.run_to_table(
        stream_ops.stream_bars(tick_stream(spark, folder), "1 day", "1 day"), "stream-bars"
    )
    return bars.select(
        "code", F.date_format("ts", "yyyy-MM-dd").alias("day"), "o", "h", "l", "c", "v", "ticks"
    )


@catalog.query(
    "stream_dedup",
    q.given(q.TICKS)
    + "SELECT DISTINCT code, strftime(ts, '%Y-%m-%d %H') AS hour FROM ticks",
)
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Hours in which a code traded, each reported once."""
    hourly = tick_stream(spark, folder).withColumn("ts", F.date_trunc("hour", "ts")).select("code", "ts")
    once = stream_ops.run_to_table(
        stream_ops.stream_dedup(hourly, "2 hours", ("code", "ts")), "stream-dedup"
    )
    return once.select("code", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


def latest_table(spark: SparkSession, folder: str) -> DataFrame:
    latest = stream_ops.LatestQuotes(spark)
    latest.start(tick_stream(spark, folder), new_path(spark, "latest-checkpoint")).awaitTermination()
    return latest.table()


@catalog.query(
    "stream_latest",
    q.given(q.TICKS)
    + """SELECT code, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, tick_id, price, volume FROM ticks
QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC, tick_id DESC) = 1""",
)
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_table(spark, folder).select(
        "code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "tick_id", "price", "volume"
    )


@catalog.query(
    "stale_keys",
    q.given(q.TICKS)
    + f""", latest AS (SELECT code, max(ts) AS ts FROM ticks GROUP BY code),
aged AS (
  SELECT code, CAST(floor((epoch_us(TIMESTAMP '{FRESHNESS_NOW}') - epoch_us(ts)) / 1000000.0) AS BIGINT)
    AS age_seconds FROM latest)
SELECT code, age_seconds FROM aged WHERE age_seconds >= 21600""",
)
def stale_keys(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit(FRESHNESS_NOW).cast("timestamp_ntz").cast("timestamp")
    return stream_ops.stale_keys(latest_table(spark, folder), now, 6 * 3600).drop("ts")


_LIMIT_HOURS = 6


@catalog.query(
    "stale_events",
    q.given(q.TICKS)
    + f""", marked AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM ticks),
closed AS (
  SELECT code, ts, mark, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM ticks, marked
  WHERE time_bucket(INTERVAL {_LIMIT_HOURS} HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL {_LIMIT_HOURS} HOURS <= mark
  WINDOW w AS (PARTITION BY code ORDER BY ts))
SELECT code, 'stale' AS state, strftime(ts + INTERVAL {_LIMIT_HOURS} HOURS, '%Y-%m-%d %H:%M:%S') AS at FROM closed
WHERE coalesce(after - ts >= INTERVAL {_LIMIT_HOURS} HOURS, ts + INTERVAL {_LIMIT_HOURS} HOURS <= mark)
UNION ALL SELECT code, 'returned', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM closed
WHERE ts - before >= INTERVAL {_LIMIT_HOURS} HOURS""",
)
def stale_events(spark: SparkSession, folder: str) -> DataFrame:
    """When each code fell silent for six hours and when it was heard again, as the stream found it."""
    watched = stream_ops.watch_stale(tick_stream(spark, folder), _LIMIT_HOURS * 3600, "1 hour")
    with stream_ops.rocksdb(spark):
        events = stream_ops.run_to_table(watched, "stale-events")
    return events.select("code", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))
