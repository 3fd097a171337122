"""Streams of price ticks: bars, latest quotes, duplicate removal and stale keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.bars import bar_columns
from ..operators.ordering import first_by
from ..sources.upserts import BUCKETS, UpsertTable
from ..storage import new_path


def read_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the files of one table, with the schema of what is there already."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_bars(ticks: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars per code and tumbling window.

    Append mode emits a bar once the watermark has passed its end; ticks later
    than that are dropped.  State is one row per code and open window.
    """
    windowed = ticks.withWatermark("ts", late).groupBy("code", F.window("ts", every).alias("w"))
    return windowed.agg(*bar_columns()).select(
        "code", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v", "ticks"
    )


def stream_dedup(ticks: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("code", "tick_id")) -> DataFrame:
    """First delivery of each tick; keys are remembered for the watermark's delay only."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def latest_of(ticks: DataFrame) -> DataFrame:
    """Newest tick per code."""
    return first_by(ticks, "code", F.col("ts").desc(), F.col("tick_id").desc())


class LatestQuotes(UpsertTable):
    """Keeps the newest tick per code as a table, upserted once per micro-batch.

    A batch that runs again after a failure starts from the version before its own, so nothing
    is lost or counted twice, and a restarted driver finds the state on disk.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> None:
        super().__init__(spark, "code", latest_of, path or new_path(spark, "latest"), buckets)

    def start(self, ticks: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Start or resume from ``checkpoint``; without a trigger, take what there is and stop."""
        return (
            ticks.writeStream.foreachBatch(self.upsert)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

def stale_keys(latest: DataFrame, now: Column, limit_seconds: int) -> DataFrame:
    """Codes whose newest tick is older than the limit, with its age."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(1e6)
    return latest.select("code", "ts", F.floor(age).cast("bigint").alias("age_seconds")).where(
        F.col("age_seconds") >= limit_seconds
    )


def quiet_spans(ticks: DataFrame, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """First and last tick per code and window of ``limit_seconds``.

    No silence within such a window can be that long, so these two ticks are all that
    :class:`StaleWatch` needs of it, however many there were.
    """
    window = F.window("ts", f"{limit_seconds} seconds")
    return ticks.withWatermark("ts", late).groupBy("code", window).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


class StaleWatch(StatefulProcessor):
    """Per code: silent for the limit -> one ``stale`` row; heard again -> one ``returned`` row.

    State is the last tick, whether the code is stale, and since when it waits.  A timer in
    event time runs from the last tick to the limit, so a code that never trades again is
    reported too; ``forget_seconds`` after that its state is dropped, and a later tick then
    counts as the first.
    """

    def __init__(self, limit_seconds: int, forget_seconds: int | None = None) -> None:
        self.limit, self.forget = limit_seconds * 1000, None if forget_seconds is None else forget_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, stale boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        spans = sorted((r.first, r.last) for r in rows)
        known = self.seen.get() if self.seen.exists() else None
        last, stale = known if known else (None, False)
        for first, final in spans:
            if last is not None:
                if not stale and first - last >= self.limit * 1000:
                    yield self._row(key, "stale", last + self.limit * 1000)
                    stale = True
                if stale:
                    yield self._row(key, "returned", first)
            last, stale = max(final, last or final), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((last, stale))
        self.handle.registerTimer(last // 1000 + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        last, stale = self.seen.get()
        if stale:
            self.seen.clear()
            return
        yield self._row(key, "stale", last + self.limit * 1000)
        self.seen.update((last, True))
        if self.forget is not None:
            self.handle.registerTimer(last // 1000 + self.limit + self.forget)

    @staticmethod
    def _row(key, state: str, micros: int) -> Row:
        return Row(code=key[0], state=state, at=micros)

    def close(self) -> None:
        pass


def watch_stale(ticks: DataFrame, limit_seconds: int, late: str = "1 hour", forget_seconds: int | None = None) -> DataFrame:
    """(code, state, at) whenever a code goes stale or returns, each once, in event time.

    A window's ticks count once the watermark has passed its end.  The session's state store
    must be RocksDB (:func:`rocksdb`).
    """
    spans = quiet_spans(ticks, limit_seconds, late)
    slim = spans.select("code", "window", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
    events = slim.groupBy("code").transformWithState(
        statefulProcessor=StaleWatch(limit_seconds, forget_seconds),
        outputStructType="code string, state string, at long", outputMode="Append", timeMode="EventTime",
    )
    return events.select("code", "state", F.timestamp_micros("at").alias("at"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as timers and :class:`StaleWatch` need."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def run_to_table(
    stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Run a stream over all data there is now into a parquet table and return the table.

    With the same ``path`` and ``checkpoint`` a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, label)
    checkpoint = checkpoint or new_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
