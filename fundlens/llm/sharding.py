"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into 2 ** bits cells of about equally many values, a row's cells
give its place on the curve, and the curve is cut into runs.  Rows of one shard are near each
other in every dimension, so the minima and maxima of its file prune it for filters on any.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators.ordering import with_position
from .columns import free

BITS = 5


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place on the curve of points given as one integer array per dimension."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, from the coarsest
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, n):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ turn) >> level) & 1)
    return index


def cuts(df: DataFrame, dimension: str, cells: int) -> list:
    """At most ``cells - 1`` ascending values that start a new cell.

    Numbers are cut at quantiles of the rows; other values where Spark's range partitioning
    of the distinct ones begins a part.
    """
    if isinstance(df.schema[dimension].dataType, NumericType):
        at = [i / cells for i in range(1, cells)]
        found = df.agg(F.percentile_approx(dimension, at, 10_000)).first()[0] or []
        return sorted({v for v in found if v is not None and v == v})
    parts = (
        df.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(F.count(F.lit(1)).alias("_n"))
        .repartitionByRange(cells, dimension)
        .groupBy(F.spark_partition_id().alias("_part")).agg(F.min(dimension).alias("_low"))
    )
    return sorted(r["_low"] for r in parts.collect())[1:]


def cell(dimension: str, bounds: list, cells: int) -> Column:
    """Number of bounds a value has reached, spread over the cells; null is in the first."""
    if not bounds:
        return F.lit(0)
    reached = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(dimension)))
    scaled = F.floor(F.coalesce(reached, F.lit(0)) * F.lit(cells) / F.lit(len(bounds) + 1))
    return F.when(F.col(dimension).isNull(), F.lit(0)).otherwise(scaled).cast("int")


def shard(
    df: DataFrame, dimensions: Sequence[str], tie: Sequence[str], shards: int, law: str = "rows", size: str | None = None, bits: int = BITS
) -> DataFrame:
    """``df`` with ``curve``, ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in a shard).

    ``law`` "rows" cuts runs whose row counts are at most one apart, "bytes" runs whose sums
    of the column ``size`` are near equal.  ``tie`` orders rows in a cell of the curve; equal
    rows stand next to each other.  Null and missing values fall into a dimension's first
    cell, NaN into its last.  An empty table stays empty.  A column given under an added
    name stays, and the added one gets underscores before its name.

    Cells are found in one pass, with bounded lists of cuts; positions come from a range
    sort, so a value that a third of the rows share is spread over tasks by ``tie``.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is rows or bytes, not {law}")
    inner = {c: f"_given{i}" for i, c in enumerate(df.columns)}
    slim = df.toDF(*inner.values())
    found = _sharded(slim, [inner[d] for d in dimensions], [inner[t] for t in tie], shards, law, inner.get(size), bits)
    return found.toDF(*df.columns, *(free(c, df.columns) for c in ("curve", "shard", "slot")))


def _sharded(
    df: DataFrame, dimensions: Sequence[str], tie: Sequence[str], shards: int, law: str, size: str | None, bits: int
) -> DataFrame:
    count = 1 << bits
    names = [f"_cell{i}" for i in range(len(dimensions))]
    placed = df
    for name, d in zip(names, dimensions):
        placed = placed.withColumn(name, cell(d, cuts(df, d, count), count))

    @F.pandas_udf("bigint")
    def curve(parts: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([parts[c].to_numpy() for c in parts.columns], bits))

    placed = placed.withColumn("curve", curve(F.struct(*names))).drop(*names)
    order = [F.col("curve").asc(), *[F.col(c).asc_nulls_first() for c in tie]]
    positions = with_position(placed, order, name="_at")
    if law == "rows":
        total = positions.count()
        if not total:
            return positions.select(*df.columns, "curve", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
        at = F.col("_at") - 1
        # In whole numbers: shard s starts at ceil(s * total / shards).
        run = F.expr(f"((_at - 1) * {shards}) div {total}").cast("int")
        begin = F.expr(f"(((_at - 1) * {shards} div {total}) * {total} + {shards - 1}) div {shards}")
        return positions.select(*df.columns, "curve", run.alias("shard"), (at - begin).alias("slot"))
    return _by_bytes(positions, df.columns, size, shards)


def _by_bytes(positions: DataFrame, columns: Sequence[str], size: str, shards: int) -> DataFrame:
    """Cut where the running size passes each shard's share.

    Rows are summed in blocks of positions first, then within a block, so no task has more
    than a block's rows or one row per block.
    """
    from pyspark.sql import Window as W

    block_rows = 50_000
    blocked = positions.withColumn("_block", F.floor((F.col("_at") - 1) / block_rows))
    past = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocked.groupBy("_block").agg(F.sum(size).alias("_sum"))
    total = sums.agg(F.sum("_sum")).first()[0] or 1
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_shift"))
    inner = W.partitionBy("_block").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    running = blocked.withColumn("_before", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(sums, "_block")
    middle = (F.col("_shift") + F.col("_before")) * 2 + F.col(size)
    run = F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    cut = running.withColumn("shard", run)
    starts = cut.groupBy("shard").agg(F.min("_at").alias("_first"))
    return cut.join(starts, "shard").select(*columns, "curve", "shard", (F.col("_at") - F.col("_first")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, so that file statistics prune on every dimension."""
    order = ["shard", "slot"]
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)
