"""Checks: document shape, business rules, scorer results, references and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clamp01, delay_minutes, is_delayed, normalize_code, not_finite
from ..functions.names import ASSET_TYPES
from .holdings import holding_figures
from .ordering import spread

# Fixed values of the holdings document schema.
PROVIDERS = ("PYKRX", "KRX_DIRECT", "SEIBRO", "ISSUER", "MOCK")
SOURCE_TYPES = ("KRX_PDF", "KRX_API", "SEIBRO_PDF", "ISSUER_FILE", "MOCK", "UNKNOWN")
COLLECTION_STATUSES = (
    "OK", "PARTIAL", "EMPTY", "REQUEST_FAILED", "INVALID_SCHEMA", "NORMALIZATION_FAILED",
    "WEIGHT_MISSING", "UNSUPPORTED", "NOT_IMPLEMENTED", "UNRESOLVED",
)
DATE_STATUSES = ("EXACT", "RESOLVED_PRIOR", "UNRESOLVED", "NOT_ATTEMPTED")
ETF_CODE_SHAPE = "^[0-9A-Za-z]{6}$"
DATE_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
INSTANT_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
VERSION_SHAPE = r"^[0-9]+\.[0-9]+\.[0-9]+$"
WEIGHT_SUM_TOLERANCE = 1.0
CANDIDATE_CATEGORIES = ("sector", "strategy", "dividend")

# Phrases a neutral text must not contain.
BANNED_PHRASES = (
    "추천 ETF", "ETF 추천", "추천 테마", "추천드", "지금 사야", "매수 타이밍", "매도 타이밍",
    "상승 가능성이 높", "목표가격", "목표수익률", "자금 유입", "자금이 유입", "자금이 몰",
    "돈이 몰", "자금이 빠져",
)


def codes(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that fail, in the given order."""
    return F.array_compact(F.array(*[F.when(failed, name) for name, failed in checks]))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _outside(c: str, allowed: Sequence[str], nullable: bool = False) -> Column:
    known = F.col(c).isin(*allowed)
    return ~F.coalesce(known, F.col(c).isNull() if nullable else F.lit(False))


def _misshapen(c: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))


SHAPE_ERRORS = ("asset_code:missing", "asset_name:missing", "asset_type:enum")


def check_shape(holdings: DataFrame) -> DataFrame:
    """Attach ``shape_errors`` to each holding row."""
    return holdings.withColumn(
        "shape_errors",
        codes(
            *zip(
                SHAPE_ERRORS,
                (_blank("asset_code"), _blank("asset_name"), _outside("asset_type", ASSET_TYPES)),
            )
        ),
    )


def check_document_shape(documents: DataFrame) -> DataFrame:
    """Attach ``document_errors``; only the columns a document table has are checked."""
    known = {
        "schema_version": ("schema_version:pattern", lambda c: _misshapen(c, VERSION_SHAPE)),
        "etf_code": ("etf_code:pattern", lambda c: _misshapen(c, ETF_CODE_SHAPE)),
        "etf_name": ("etf_name:missing", _blank),
        "base_date": ("base_date:pattern", lambda c: _misshapen(c, DATE_SHAPE)),
        "generated_at": ("generated_at:pattern", lambda c: _misshapen(c, INSTANT_SHAPE)),
        "provider": ("provider:enum", lambda c: _outside(c, PROVIDERS)),
        "source_type": ("source_type:enum", lambda c: _outside(c, SOURCE_TYPES, nullable=True)),
        "is_fallback": ("is_fallback:missing", lambda c: F.col(c).isNull()),
        "status": ("status:enum", lambda c: _outside(c, COLLECTION_STATUSES)),
        "date_status": ("date_status:enum", lambda c: _outside(c, DATE_STATUSES, nullable=True)),
    }
    checks = [(name, test(c)) for c, (name, test) in known.items() if c in documents.columns]
    return documents.withColumn("document_errors", codes(*checks))


def shape_summary(checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per shape error, counted in one aggregation and then unfolded."""
    counted = checked.groupBy(*by).agg(
        *[F.count_if(F.array_contains("shape_errors", e)).alias(e) for e in SHAPE_ERRORS]
    )
    pairs = F.array(
        *[F.struct(F.lit(e).alias("error"), F.col(f"`{e}`").alias("rows")) for e in SHAPE_ERRORS]
    )
    return counted.select(*by, F.inline(pairs)).where(F.col("rows") > 0)


def check_business(documents: DataFrame, holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status, errors and warnings per document.

    A weight sum away from 100 is only ever a warning: cash, derivatives and
    leverage move it for good reasons.
    """
    keys = list(keys)
    counts = [
        "row_count", "valued_count", "blank_count", "bad_count", "negative_count",
        "misshapen_count", "repeated_assets",
    ]
    joined = documents.join(holding_figures(holdings, keys), keys, "left").fillna(0, counts)
    empty = F.col("row_count") == 0
    blank = F.col("blank_count")
    checks = [("etf_code:pattern", _misshapen("etf_code", ETF_CODE_SHAPE))]
    if "base_date" in documents.columns:
        checks.append(("base_date:missing", F.col("base_date").isNull()))
    if "provider" in documents.columns:
        checks.append(("provider:missing", _blank("provider")))
    checks += [("holdings:empty", empty), ("weight:not_finite", F.col("bad_count") > 0)]
    off = F.abs(F.col("weight_sum") - 100) > WEIGHT_SUM_TOLERANCE
    warnings = [
        ("weight:negative", F.col("negative_count") > 0),
        ("asset:repeated", F.col("repeated_assets") > 0),
        ("weight:all_blank", ~empty & (F.col("valued_count") == 0)),
        ("weight:some_blank", (F.col("valued_count") > 0) & (blank > 0)),
        ("weight:sum_off", (F.col("valued_count") > 0) & off),
    ]
    status = (
        F.when(empty, "EMPTY")
        .when(F.col("valued_count") == 0, "WEIGHT_MISSING")
        .when(blank > 0, "PARTIAL")
        .otherwise("OK")
    )
    return joined.select(
        *documents.columns,
        *counts,
        "weight_sum",
        status.alias("business_status"),
        codes(*checks).alias("business_errors"),
        codes(*warnings).alias("business_warnings"),
    )


def business_findings(holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows behind a document's warnings and errors, one finding per row."""
    rows = holdings.withColumn(
        "finding",
        F.explode(
            codes(
                ("weight:not_finite", not_finite("weight_pct")),
                ("weight:negative", F.col("weight_pct") < 0),
                ("weight:blank", F.col("weight_pct").isNull()),
            )
        ),
    )
    repeated = (
        holdings.where(F.col("asset_code").isNotNull())
        .groupBy(*keys, "asset_code")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .withColumn("finding", F.lit("asset:repeated"))
    )
    return rows.select(*keys, "asset_code", "finding", F.lit(1).cast("bigint").alias("rows")).unionByName(
        repeated.select(*keys, "asset_code", "finding", "rows")
    )


def check_scores(results: DataFrame, taxonomy: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdict and clamped numbers for each scored tag.

    ``results``: batch_id, etf_code, pos, tag_id, score, confidence.  The first
    valid row of a tag is kept; later ones are duplicates.  Codes that were not
    asked for in the batch are refused.
    """
    key = ["batch_id", "etf_code", "tag_id"]
    numbers_ok = F.col("score_01").isNotNull() & F.col("confidence_01").isNotNull()
    known_tags = taxonomy.select(F.col("id").alias("tag_id"), F.lit(True).alias("_known"))
    asked = expected.select("batch_id", "etf_code", F.lit(True).alias("_asked")).distinct()
    rows = (
        results.withColumn("score_01", clamp01("score"))
        .withColumn("confidence_01", clamp01("confidence"))
        .join(known_tags, "tag_id", "left")
        .join(asked, ["batch_id", "etf_code"], "left")
    )
    first_valid = (
        rows.where(F.col("_known") & numbers_ok).groupBy(*key).agg(F.min("pos").alias("_first"))
    )
    verdict = (
        F.when(F.col("etf_code").isNull(), "error:no_code")
        .when(F.col("_asked").isNull(), "refused:unexpected_code")
        .when(F.col("tag_id").isNull(), "error:bad_item")
        .when(F.col("_known").isNull(), "error:unknown_tag")
        .when(F.col("pos") > F.col("_first"), "warning:duplicate_tag")
        .when(~numbers_ok, "error:bad_number")
        .otherwise("ok")
    )
    return rows.join(first_valid, key, "left").withColumn("verdict", verdict).drop(
        "_known", "_asked", "_first"
    )


def candidate_tags(candidates: DataFrame) -> DataFrame:
    """Candidate tags with a label and one of the three categories, numbers clamped."""
    kept = F.col("label").isNotNull() & F.col("category").isin(*CANDIDATE_CATEGORIES)
    return candidates.where(kept).withColumns(
        {
            "score": F.coalesce(clamp01("score"), F.lit(0.0)),
            "confidence": F.coalesce(clamp01("confidence"), F.lit(0.0)),
        }
    )


def fk_violations(df: DataFrame, column: str, reference: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """Values of a reference column that the referenced table lacks, with their row counts.

    Both columns are counted in one aggregation, without a join: nothing is sorted or
    broadcast.  ``rows``, of both tables together if known, bounds what a task holds; the rows
    of a large table then meet by value, and a hot one's are only counted as they come.
    """
    used = df.select(F.col(column).alias("value"), F.lit(1).cast("bigint").alias("rows"))
    known = reference.select(F.col(key).alias("value"), F.lit(None).cast("bigint").alias("rows")).where("value is not null")
    both = spread(used.unionAll(known), rows, "value").groupBy("value")
    counted = both.agg(F.sum("rows").alias("rows"), F.bool_or(F.col("rows").isNull()).alias("_known"))
    return counted.where("not _known").select(F.col("value").cast(used.schema["value"].dataType), "rows")


def exploded(df: DataFrame, array_column: str, name: str = "ref_id") -> DataFrame:
    """References held in arrays as rows, for :func:`fk_violations`."""
    return df.select(F.explode(array_column).alias(name))


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def weight_violations(holding: DataFrame) -> DataFrame:
    valid = (F.col("weight") > 0) & (F.col("weight") <= 100)
    return holding.where(~F.coalesce(valid, F.lit(False)))


def array_mismatch(stored: DataFrame, derived: DataFrame, key: str = "etf_id", value: str = "stock_id") -> DataFrame:
    """Keys whose stored list differs from the derived one, and at how many places.

    Lists are in long form: key, place, value.
    """
    both = [rows.select(key, "place", value, F.lit(side).alias("_side")) for side, rows in ((1, stored), (2, derived))]
    return _differing(both[0].unionAll(both[1]), key, value)


def place_mismatch(
    rows: DataFrame, places: Sequence[str] = ("place", "stored_place"), key: str = "etf_id", value: str = "stock_id"
) -> DataFrame:
    """:func:`array_mismatch` of two lists whose places stand in the same rows, null where a list lacks the value."""
    both = F.array(
        *[F.struct(F.col(p).alias("place"), F.col(value), F.lit(side).alias("_side")) for side, p in enumerate(places, 1)]
    )
    return _differing(rows.select(key, F.inline(both)).where("place is not null"), key, value)


def _differing(listed: DataFrame, key: str, value: str) -> DataFrame:
    """Places at which not both lists have the same value; a null value is like none."""
    sides = listed.where(F.col(value).isNotNull()).groupBy(key, "place", value).agg(F.bit_or("_side").alias("_sides"))
    places = sides.groupBy(key, "place").agg(F.min("_sides").alias("_sides")).where(F.col("_sides") < 3)
    return places.groupBy(key).agg(F.count(F.lit(1)).alias("differing_places"))


def breadth_violations(summary: DataFrame, funds: int | Column) -> DataFrame:
    """Summaries whose counts do not add up, or whose strongest theme is not the stronger."""
    total = F.col("advancers") + F.col("decliners") + F.col("unchanged")
    checks = [("counts", total != funds)]
    if "strongest_return" in summary.columns:
        checks.append(("extremes", F.col("strongest_return") <= F.col("weakest_return")))
    checked = summary.withColumn("violations", codes(*checks))
    return checked.where(F.size("violations") > 0)


def phrase_hits(
    documents: DataFrame, key: str, text: str, phrases: Sequence[str] = BANNED_PHRASES
) -> DataFrame:
    """Each (document, phrase) where the whole text contains the phrase."""
    found = F.array_compact(F.array(*[F.when(F.col(text).contains(p), p) for p in phrases]))
    return documents.select(key, F.explode(found).alias("phrase"))


def code_collisions(df: DataFrame, column: str) -> DataFrame:
    """Padded codes that distinct raw codes share."""
    pairs = df.select(
        normalize_code(column).alias("padded"), F.col(column).alias("raw")
    ).where(F.col("padded").isNotNull())
    return (
        pairs.groupBy("padded", "raw")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("padded")
        .agg(
            F.count(F.lit(1)).alias("raw_codes"),
            F.min("raw").alias("first_raw"),
            F.max("raw").alias("last_raw"),
            F.sum("rows").alias("rows"),
        )
        .where(F.col("raw_codes") > 1)
    )


def freshness(df: DataFrame, now: Column, threshold: int = 1, as_of: str = "as_of") -> DataFrame:
    """Minutes late, late flag, and ``ok`` turned to ``stale`` on late rows."""
    late = is_delayed(as_of, now, threshold)
    return df.withColumns(
        {
            "delay_minutes": delay_minutes(as_of, now),
            "is_delayed": late,
            "status": F.when(late & (F.col("status") == "ok"), "stale").otherwise(F.col("status")),
        }
    )


def combine_status(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One status per group from the states of its parts."""
    state = F.coalesce(F.col("status"), F.lit("unavailable"))
    combined = (
        F.when(F.bool_and(state == "unavailable"), "unavailable")
        .when(F.bool_or(state.isin("unavailable", "partial")), "partial")
        .when(F.bool_or(state == "stale"), "stale")
        .otherwise("ok")
    )
    return df.groupBy(*by).agg(combined.alias("status"), F.count(F.lit(1)).alias("parts"))


def status_rollup(df: DataFrame, by: str, gate: float = 80.0) -> DataFrame:
    """Status counts and success rate per group and overall, against an entry gate."""
    # Counted per (group, status) first; the roll-up then works on that small table.
    counted = df.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == name, F.col("n"))), F.lit(0))

    rolled = counted.rollup(by).agg(
        F.grouping(by).alias("_all"),
        F.sum("n").alias("total"),
        of("OK").alias("ok"),
        of("PARTIAL").alias("partial"),
        of("EMPTY").alias("empty"),
        of("REQUEST_FAILED").alias("request_failed"),
    )
    rate = (F.col("ok") + F.col("partial")) / F.col("total") * 100.0
    return rolled.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by)).alias("group_name"),
        "total", "ok", "partial", "empty", "request_failed",
        (F.floor(rate * 100 + 0.5) / 100.0).cast("double").alias("success_pct"),
        (rate >= gate).alias("passes_gate"),
    )
