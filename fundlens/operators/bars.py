"""Price bars and what follows from them.

Ticks are aggregated with partial aggregation, so a key with a third of all
ticks sends one row per bar and map task.  What follows uses limits per key that
apply before the shuffle, aggregates joined back, and range-partitioned
positions; no key's whole history has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite, half_up, pct_change
from .ordering import first_by, top_per_key, with_position

# Trailing windows as (bar interval, number of bars).
PERIODS = {
    "1D": ("1m", 78),
    "1W": ("1d", 7),
    "1M": ("1d", 22),
    "3M": ("1d", 66),
    "1Y": ("1d", 250),
    "3Y": ("1d", 750),
}
# How many bars back the day, week and month figures look.
OFFSETS = (1, 5, 20)


def bar_columns() -> list[Column]:
    """Aggregates that make a bar of ticks; the tick id breaks ties in time.

    A price that is not finite is missing; such a tick only adds its volume.
    """
    price = finite("price")
    when = F.when(price.isNotNull(), F.struct("ts", "tick_id"))
    return [
        F.min_by(price, when).alias("o"),
        F.max(price).alias("h"),
        F.min(price).alias("l"),
        F.max_by(price, when).alias("c"),
        F.sum("volume").alias("v"),
        F.count(F.lit(1)).alias("ticks"),
    ]


def bars(ticks: DataFrame, unit: str = "day") -> DataFrame:
    """Open, high, low, close and volume per code and calendar unit."""
    start = F.date_trunc(unit, "ts")
    return (
        ticks.groupBy("code", start.alias("bar_ts"))
        .agg(*bar_columns())
        .withColumnRenamed("bar_ts", "ts")
    )


def quotes(
    bars: DataFrame,
    last_price: DataFrame | None = None,
    offsets: Sequence[int] = OFFSETS,
    unit: float = 1e8,
) -> DataFrame:
    """Price, changes and trading value per code from its newest bars.

    With fewer bars than an offset asks for, the oldest bar stands in.  The
    trading value of the bar before has no such stand-in.  Only the newest
    ``max(offsets) + 1`` bars per code leave the map side.  ``spread`` is high over
    low of the newest bar in percent.
    """
    back = max(offsets)
    newest = top_per_key(bars, "code", [F.col("ts").desc()], back + 1, name="_back")
    index = F.col("_back") - 1
    turnover = F.col("c") * F.col("v") / F.lit(float(unit))

    def close_at(i: int) -> Column:
        return F.max(F.when(index == i, F.col("c")))

    past = newest.groupBy("code").agg(
        F.count(F.lit(1)).alias("_bars"),
        F.max_by("c", index).alias("_oldest"),
        close_at(0).alias("_close"),
        *[close_at(i).alias(f"_c{i}") for i in offsets],
        F.max(F.when(index == 0, turnover)).alias("_tv0"),
        F.max(F.when(index == 1, turnover)).alias("_tv1"),
        F.max(F.when(index == 0, pct_change(F.col("h"), F.col("l")))).alias("_spread"),
        F.max("ts").alias("_ts"),
    )
    day, week, month = (
        F.when(F.col("_bars") > i, F.col(f"_c{i}")).otherwise(F.col("_oldest")) for i in offsets
    )
    if last_price is None:
        joined = past.withColumn("price", F.col("_close")).withColumn("price_ts", F.col("_ts"))
    else:
        live = last_price.select("code", "price", F.col("ts").alias("price_ts"))
        joined = live.join(past, "code", "left")
    priced = F.col("price").isNotNull()

    def if_priced(c: Column, name: str) -> Column:
        return F.when(priced, c).alias(name)

    return joined.select(
        "code",
        "price",
        if_priced(F.col("price") - day, "change"),
        if_priced(pct_change(F.col("price"), day), "change_rate"),
        if_priced(pct_change(F.col("price"), week), "return_1w"),
        if_priced(pct_change(F.col("price"), month), "return_1m"),
        if_priced(half_up(F.col("_tv0")), "trading_value"),
        if_priced(pct_change(F.col("_tv0"), F.col("_tv1")), "trading_value_change_rate"),
        F.col("_spread").alias("spread"),
        F.col("price_ts").alias("ts"),
    )


def last_bars(bars: DataFrame, n: int, ordinal: str | None = None) -> DataFrame:
    """Last ``n`` bars per code, old to new.

    Pages of one history may overlap: with an ``ordinal`` column the first
    delivery of a timestamp counts and later ones are dropped.
    """
    if n < 2:
        raise ValueError(f"number of bars must be 2 or more: {n}")
    if ordinal:
        bars = first_by(bars, ["code", "ts"], F.col(ordinal).asc())
    newest = top_per_key(bars, "code", [F.col("ts").desc()], n, name="_back")
    window = W.partitionBy("code").orderBy(F.col("ts").asc())
    return newest.withColumn("position", F.row_number().over(window)).drop("_back")


def downsample(bars: DataFrame, k: int) -> DataFrame:
    """Every k-th bar from the first on, plus the last one."""
    if k < 1:
        raise ValueError(f"step must be positive: {k}")
    placed = with_position(bars, [F.col("ts").asc()], by=["code"], name="_place")
    lengths = bars.groupBy("code").agg(F.count(F.lit(1)).alias("_length"))
    kept = ((F.col("_place") - 1) % k == 0) | (F.col("_place") == F.col("_length"))
    return placed.join(lengths, "code").where(kept).drop("_place", "_length")


def cumulative_return(bars: DataFrame) -> DataFrame:
    """Return of each bar against the first close of its code."""
    first = bars.groupBy("code").agg(F.min_by("c", "ts").alias("_first"))
    return (
        bars.join(first, "code")
        .withColumn("cum_return", pct_change(F.col("c"), F.col("_first")))
        .drop("_first")
    )


def scaled(bars: DataFrame) -> DataFrame:
    """Closes scaled to 0..1 between the lowest and the highest of the code."""
    ends = bars.groupBy("code").agg(F.min("c").alias("_low"), F.max("c").alias("_high"))
    span = F.col("_high") - F.col("_low")
    height = (F.col("c") - F.col("_low")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return bars.join(ends, "code").withColumn("scaled", height).drop("_low", "_high")


def period_return(bars: DataFrame, period: str) -> DataFrame:
    """Return between the first and the last bar of a trailing window."""
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")
    size = PERIODS[period][1]
    newest = top_per_key(bars, "code", [F.col("ts").desc()], size, name="_back")
    ends = newest.groupBy("code").agg(
        F.min_by("c", "_back").alias("last_close"),
        F.max_by("c", "_back").alias("first_close"),
        F.count(F.lit(1)).alias("bars"),
    )
    return ends.select(
        "code",
        F.lit(period).alias("period"),
        "bars",
        "first_close",
        "last_close",
        F.when(F.col("bars") >= 2, pct_change(F.col("last_close"), F.col("first_close"))).alias(
            "period_return"
        ),
    )
