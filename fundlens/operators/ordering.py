"""Order-dependent building blocks that hold up when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

LOCAL_INDEX_MASK = (1 << 33) - 1
# A group of at most this many rows never needs more than one task.
SMALL_GROUP = 10_000
# Rows a task numbers, so that its memory does not grow with the table.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to so many tasks that each gets ``ROWS_PER_TASK`` of ``rows``.

    Below that for every core, Spark's own choice stands.  Above it adaptive execution would
    join partitions by their compressed size, and the memory of a task grow with the table.
    """
    tasks = rows // ROWS_PER_TASK + 1
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def first_by(df: DataFrame, keys: str | Sequence[str], *order: Column | str) -> DataFrame:
    """First row per key in the given order.

    Spark turns the filter on ``row_number`` into a group limit that runs before
    the shuffle too, so each map task sends at most one row per key.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column | str],
    n: int,
    name: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key; ``name`` keeps the row's position as a column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    position = name or "_position"
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(position, F.row_number().over(window)).where(F.col(position) <= n)
    return ranked if name else ranked.drop(position)


def top(df: DataFrame, order: Sequence[Column | str], n: int, name: str = "position") -> DataFrame:
    """First ``n`` rows of the whole table, numbered.  Only those ``n`` rows meet in one task."""
    window = W.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(window))


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Number all rows 1..n in order, per group if ``by`` is given.

    ``order`` must end with a unique key.
    """
    return with_positions(df, {name: order}, by) if by else _ranged(df, order, by, name)


def with_positions(
    df: DataFrame,
    orders: Mapping[str, Sequence[Column]],
    by: Sequence[str],
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Number the rows of each group 1..n, once for each named order.

    ``totals`` adds aggregates over the whole group.  The rows are written once and counted per
    group.  A group with more rows than a task's even share is numbered by ranges; there are
    fewer such groups than tasks.  All others meet in one shuffle that serves every order.
    """
    totals = dict(totals or {})
    rows = materialize(df, "grouped")
    count = rows.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, count // ROWS_PER_TASK + 1)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[t.alias(n) for n, t in totals.items()])
    hot = sizes.where(F.col("_rows") > max(SMALL_GROUP, count // tasks)).withColumnsRenamed({c: f"_by_{c}" for c in by})
    hot = materialize(hot.drop("_rows"), "hot")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    any_hot = not hot.isEmpty()
    small = rows.join(F.broadcast(hot), same, "left_anti") if any_hot else rows
    numbers = {n: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint") for n, order in orders.items()}
    placed = small.repartition(tasks, *by).withColumns({**numbers, **{n: t.over(W.partitionBy(*by)) for n, t in totals.items()}})
    if not any_hot:
        return placed
    big = rows.join(F.broadcast(hot), same).drop(*[f"_by_{c}" for c in by])
    for name, order in orders.items():
        big = _ranged(big, order, by, name)
    return placed.unionByName(big)


def _ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str], name: str) -> DataFrame:
    """Positions of rows that are range-partitioned on (group, order): a big group spreads over many tasks.

    The sorted rows are written once, with their partition number and local index; adding the
    row counts of the partitions before gives the position.
    """
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    numbered = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_INDEX_MASK))),
        "sorted",
    )
    # One row per range partition: bounded by the number of shuffle partitions.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_index") + 1
    )
    if by:
        # Where a group begins is looked up per partition and group: no task gets more rows of
        # a group than the range partition had.
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        local = numbered.groupBy("_part", *by).agg(F.min("_index").alias("_index"))
        parts = local.join(F.broadcast(offsets), "_part").select(
            F.col("_part").alias("_by_part"),
            *[F.col(c).alias(f"_by_{c}") for c in by],
            (F.col("_offset") + F.col("_index")).alias("_start"),
        )
        first = parts.groupBy(*[F.col(f"_by_{c}").alias(c) for c in by]).agg(F.min("_start").alias("_first"))
        starts = parts.join(first, same).select("_by_part", *[f"_by_{c}" for c in by], "_first")
        placed = placed.join(starts, [F.col("_part") == F.col("_by_part"), *same], "left").withColumn(
            name, F.col(name) - F.col("_first")
        )
    return placed.select(*df.columns, name)
