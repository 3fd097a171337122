"""Content feed: news, disclosures and research, and the funds they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import first_by, with_position

# Fixed values.
CONTENT_TYPES = ("news", "disclosure", "research")


def content_feed(content: DataFrame, kind: str) -> DataFrame:
    """Items of one type, newest first, the id breaking ties."""
    if kind not in CONTENT_TYPES:
        raise ValueError(f"unknown content type: {kind}")
    rows = content.where(F.col("type") == kind)
    return with_position(rows, [F.col("published_at").desc(), F.col("id").asc()])


def _per_fund(content: DataFrame) -> DataFrame:
    """One row per item and fund it names.  A list may name a fund twice; that counts once."""
    return content.withColumn("etf_id", F.explode(F.array_distinct("related_etf_ids")))


def content_by_fund(content: DataFrame, etf: DataFrame, code: str | None = None) -> DataFrame:
    """Items that name a fund, for one fund code or for all of them."""
    funds = etf.select(F.col("id").alias("etf_id"), "code").distinct()
    if code is not None:
        funds = funds.where(F.col("code") == code)
    return _per_fund(content).join(funds, "etf_id").select(
        "code", F.col("id").alias("content_id"), "type", "summary", "published_at"
    )


def first_news(content: DataFrame, ordinal: str = "id") -> DataFrame:
    """Summary of the first news item of the feed that names each fund."""
    news = _per_fund(content.where(F.col("type") == "news"))
    return first_by(news, "etf_id", F.col(ordinal).asc()).select(
        "etf_id", F.col("id").alias("content_id"), "summary"
    )
