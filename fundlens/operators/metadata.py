"""Metadata integration: joined records, provenance and coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import half_up
from ..functions.names import is_covered_call, name_flag, name_hints, pays_monthly

# Weight of each field group in the coverage score, and its thresholds.
FIELD_WEIGHTS = {
    "etf_code": 0.10,
    "name": 0.05,
    "issuer": 0.05,
    "benchmark_name": 0.15,
    "descriptions": 0.20,
    "holdings": 0.20,
    "strategy_facts": 0.10,
    "distribution": 0.05,
    "sector_country_weights": 0.05,
    "fees_and_assets": 0.05,
}
HIGH_COVERAGE = 0.75
LOW_COVERAGE = 0.45

# Source -> (priority, confidence) of its values.
SOURCE_TRUST = {"detail": (100, 0.85), "listing_file": (80, 0.7), "master": (50, 0.75)}

# The fields whose source is recorded.
PROVENANCE_FIELDS = (
    "name", "issuer", "listing_date", "benchmark_name", "total_fee_pct", "net_assets",
    "distribution_text", "liquidity_provider_text", "type_text", "holdings",
)
#: Of these the as-of date of the detail source is known.
DATED_FIELDS = ("net_assets", "holdings")

DETAIL_FIELDS = (
    "issuer", "listing_date", "benchmark_name", "total_fee_pct", "net_assets",
    "distribution_text", "type_text", "beta", "return_1m", "return_3m", "return_6m", "return_12m",
)


def integrate(master: DataFrame, detail: DataFrame, holding_counts: DataFrame) -> DataFrame:
    """One record per fund that the detail source or the holdings sources know.

    ``detail`` may lack some of its fields; ``holding_counts``: etf_code,
    holdings_count, holdings_source.  Facts come from literal words of the name.
    """
    have = set(detail.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in DETAIL_FIELDS]
    known = detail.select(
        "etf_code",
        (F.col("name") if "name" in have else F.lit(None).cast("string")).alias("_name"),
        *fields,
        F.lit(True).alias("_detailed"),
    )
    joined = master.select("etf_code", "code_type", F.col("name").alias("_master_name")).join(
        known, "etf_code", "left"
    ).join(holding_counts, "etf_code", "left")
    detailed = F.coalesce(F.col("_detailed"), F.lit(False))
    return joined.where(detailed | (F.col("holdings_count") > 0)).select(
        "etf_code",
        "code_type",
        F.coalesce(F.when(F.col("_name") != "", F.col("_name")), F.col("_master_name")).alias("name"),
        *DETAIL_FIELDS,
        F.coalesce("holdings_count", F.lit(0)).alias("holdings_count"),
        "holdings_source",
        name_flag("_master_name", "액티브").alias("active"),
        name_flag("_master_name", r"\(H\)").alias("currency_hedged"),
        name_hints("_master_name").alias("name_hints"),
        pays_monthly("distribution_text").alias("monthly"),
        is_covered_call("_master_name").alias("covered_call"),
        F.when(detailed, "success").otherwise("not_collected").alias("collection_status"),
    )


def source_values(df: DataFrame, source: str, fields: Mapping[str, str], as_of: Column | None = None) -> DataFrame:
    """Provenance rows (one per fund and field) of one source's columns."""
    priority, confidence = SOURCE_TRUST[source]
    pairs = F.array(
        *[
            F.struct(F.lit(field).alias("field"), F.col(c).cast("string").alias("value"))
            for field, c in fields.items()
        ]
    )
    return df.select(
        "etf_code",
        F.inline(pairs),
        F.lit(source).alias("source_id"),
        (as_of if as_of is not None else F.lit(None).cast("date")).alias("as_of"),
        F.lit(priority).alias("priority"),
        F.lit(confidence).alias("confidence"),
    ).where(F.coalesce(F.col("value"), F.lit("")) != "")


def presence(columns: list[str]) -> dict[str, Column]:
    """Which field groups a record fills; groups whose columns do not exist are never filled."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False)) if name in columns else F.lit(False)

    def given(name: str) -> Column:
        return F.col(name).isNotNull() if name in columns else F.lit(False)

    def some(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False)) if name in columns else F.lit(False)

    hints = F.size("name_hints") > 0 if "name_hints" in columns else F.lit(False)
    return {
        "etf_code": text("etf_code"),
        "name": text("name"),
        "issuer": text("issuer"),
        "benchmark_name": text("benchmark_name"),
        "descriptions": text("product_description")
        | text("investment_objective")
        | text("strategy_description"),
        "holdings": some("holdings_count"),
        "strategy_facts": text("type_text") | hints,
        "distribution": text("distribution_text"),
        "sector_country_weights": some("sector_count") | some("country_count"),
        "fees_and_assets": given("total_fee_pct") | given("net_assets"),
    }


def coverage(records: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Coverage score with the filled and the missing field groups."""
    filled = presence(records.columns)
    score = F.lit(0.0)
    for group, weight in weights.items():
        score = score + F.when(filled[group], F.lit(float(weight))).otherwise(F.lit(0.0))
    return records.withColumns(
        {
            "coverage_score": half_up(score, 3),
            "available_fields": F.array_compact(
                F.array(*[F.when(filled[g], g) for g in weights])
            ),
            "missing_fields": F.array_compact(
                F.array(*[F.when(~filled[g], g) for g in weights])
            ),
        }
    )


def coverage_buckets(covered: DataFrame, high: float = HIGH_COVERAGE, low: float = LOW_COVERAGE) -> DataFrame:
    score = F.col("coverage_score")
    return covered.agg(
        F.count_if(score >= high).alias("high"),
        F.count_if((score >= low) & (score < high)).alias("low"),
        F.count_if(score < low).alias("needs_more"),
        F.count(F.lit(1)).alias("records"),
    )


def field_coverage(covered: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Share of records filling each field group, in percent at one decimal."""
    counts = covered.agg(
        F.count(F.lit(1)).alias("_records"),
        *[F.count_if(F.array_contains("available_fields", g)).alias(g) for g in weights],
    )
    pairs = F.array(*[F.struct(F.lit(g).alias("field"), F.col(g).alias("filled")) for g in weights])
    pct = F.when(F.col("_records") > 0, half_up(F.col("filled") / F.col("_records") * 1000) / 10.0)
    return counts.select("_records", F.inline(pairs)).select(
        "field", "filled", F.coalesce(pct, F.lit(0.0)).alias("coverage_pct")
    )


def missing(covered: DataFrame) -> DataFrame:
    """One row per record and missing field group."""
    return covered.select(
        "etf_code", "name", F.explode("missing_fields").alias("missing_field"), "coverage_score"
    )


# Field of a web page -> field of a record, and the fields that make a record real.
WEB_FIELDS = {
    "issuer": "issuer",
    "listing_date": "listing_date",
    "total_fee_pct": "total_fee_pct",
    "net_assets": "net_assets_eok",
    "benchmark_name": "benchmark_name",
    "type_text": "type_text",
    "beta": "beta",
    "return_1m": "return_1m",
    "return_3m": "return_3m",
    "return_6m": "return_6m",
    "return_12m": "return_12m",
    "distribution_text": "distribution_schedule",
}
REAL_FIELDS = ("issuer", "listing_date", "total_fee_pct", "beta", "distribution_schedule", "return_12m")


def web_extract(records: DataFrame) -> DataFrame:
    """Narrow records with at least one real field."""
    types = dict(records.dtypes)

    def tidy(name: str) -> Column:
        if types[name] == "string":
            return F.when(F.trim(name) != "", F.trim(name))
        return F.col(name)

    narrow = records.select("etf_code", *[tidy(c).alias(new) for c, new in WEB_FIELDS.items()])
    return narrow.where(F.coalesce(*[F.col(c).cast("string") for c in REAL_FIELDS]).isNotNull())


def as_compact_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON text per key; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("body"))


def field_counts(extract: DataFrame) -> DataFrame:
    return extract.agg(
        F.count(F.lit(1)).alias("funds"), *[F.count(c).alias(c) for c in REAL_FIELDS]
    )
