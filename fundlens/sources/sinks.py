"""Sinks and ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import half_up
from ..operators.ordering import first_by, top_per_key
from .upserts import BUCKETS, UpsertTable


def holdings_documents(holding: DataFrame, n: int, key: str = "etf_code") -> DataFrame:
    """One nested row per fund with its first ``n`` holdings by rank."""
    best = top_per_key(holding, key, [F.col("rank").asc()], n, "_place")
    fields = [c for c in best.columns if c not in (key, "_place")]
    ordered = F.sort_array(F.collect_list(F.struct("_place", *fields)))
    return best.groupBy(key).agg(
        F.transform(ordered, lambda h: F.struct(*[h[c].alias(c) for c in fields])).alias("holdings")
    )


def write_holdings_documents(holding: DataFrame, path: str, n: int = 10, key: str = "etf_code") -> None:
    """Nested JSON documents of at most ``n`` holdings; the long table keeps all of them."""
    holdings_documents(holding, n, key).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_report(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Report with a header; texts with quotes, commas or line ends are quoted."""
    chosen = df.select(*columns) if columns else df
    chosen.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue=""
    )


def pending(targets: DataFrame, done: DataFrame, key: str = "etf_code", force: bool = False) -> DataFrame:
    """Targets not collected yet, or all of them when forced."""
    if force:
        return targets
    return targets.join(done.select(key).distinct(), key, "left_anti")


def run_summary(results: DataFrame, source: str, now: Column) -> DataFrame:
    """Counts of one run by outcome and the share that has data, in percent at one decimal."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    totals = results.agg(
        F.count(F.lit(1)).alias("requested"),
        count("cached").alias("from_cache"),
        count("success").alias("success"),
        count("empty").alias("empty"),
        count("failed").alias("failed"),
    )
    good = F.col("success") + F.col("from_cache")
    rate = half_up(good / F.nullif(F.col("requested"), F.lit(0)) * 1000) / F.lit(10.0)
    return totals.select(
        F.lit(source).alias("source"), now.alias("generated_at"), *totals.columns,
        rate.alias("success_rate"),
    )


def append_run(results: DataFrame, path: str, source: str, now: Column, run_id: str | None = None) -> None:
    """Add a run's summary to the ledger; a job that runs again under its ``run_id`` replaces its own row.

    Without one every call is a run of its own.
    """
    entry = run_summary(results, source, now).withColumn("run_id", F.lit(run_id or uuid.uuid4().hex))
    writer = entry.write.partitionBy("run_id").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def input_hash(columns: Sequence[str]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns)), 256))


def scoring_ledger(
    inputs: DataFrame, columns: Sequence[str], taxonomy_version: str, prompt_version: str
) -> DataFrame:
    """Key of each input record: when all of it is unchanged, its scores can be reused."""
    kept = [c for c in ("etf_code", "batch_id", "scored_at") if c in inputs.columns]
    return inputs.select(
        *kept,
        input_hash(columns).alias("input_hash"),
        F.lit(taxonomy_version).alias("taxonomy_version"),
        F.lit(prompt_version).alias("prompt_version"),
    )


def latest_entries(ledger: DataFrame) -> DataFrame:
    """Last entry per fund."""
    return first_by(ledger, "etf_code", F.col("scored_at").desc(), F.col("input_hash").asc())


class ScoringLedger(UpsertTable):
    """The last entry of each fund, kept as a table; the same run recorded twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, "etf_code", latest_entries, path, buckets)

    def record(self, entries: DataFrame) -> None:
        """Add the entries of a run (with scored_at), each in place of an older one of its fund."""
        self.upsert(entries, max(self.versions(), default=-1) + 1)


def to_score(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records whose input or versions changed since they were last scored.

    A ledger with a scored_at counts by its last entry per fund.
    """
    if "scored_at" in ledger.columns:
        ledger = latest_entries(ledger)
    key = ["etf_code", "input_hash", "taxonomy_version", "prompt_version"]
    return current.join(ledger.select(*key).distinct(), key, "left_anti")
