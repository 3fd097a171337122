"""Resolution: base dates, provider fallback, field priority and source choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize
from .ordering import first_by
from .quality import check_business, check_document_shape, check_shape

# Fixed values.
PROVIDER_PRIORITY = ("PYKRX", "KRX_DIRECT", "SEIBRO", "ISSUER")
LOOKBACK_DAYS = 7
MODES = ("live", "hybrid", "mock")
NOT_LISTED = 1_000_000


def resolve_base_date(
    requests: DataFrame,
    available: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    today: Column | None = None,
) -> DataFrame:
    """Newest available date at or before the request, within the look-back.

    ``requests``: etf_code, requested_date and optionally anchor_date, lookback_days (any
    number of days; the argument where it is null) and attempted (false: NOT_ATTEMPTED, with
    no date and no look-back).  ``available``: etf_code, date.

    Days asked for and days available are first reduced to one row per fund and day; a window
    per fund then carries the newest available day along.  So a window has at most as many
    rows as the calendar has days, however many requests a fund has and however far they look
    back.  The days are written once, so that requests meet them by a plain equality join,
    which splits a fund and day with very many requests.
    """
    start = F.col("requested_date")
    if "anchor_date" in requests.columns:
        start = F.coalesce(start, F.col("anchor_date"))
    start = F.coalesce(start, today if today is not None else F.current_date())
    allowed = F.lit(lookback_days)
    if "lookback_days" in requests.columns:
        allowed = F.coalesce(F.col("lookback_days"), allowed)
    tried = F.coalesce(F.col("attempted"), F.lit(True)) if "attempted" in requests.columns else F.lit(True)
    asked = requests.withColumns({"_day": start, "_allowed": allowed, "_tried": tried})
    days = available.select("etf_code", F.col("date").alias("_day"), F.lit(True).alias("_there")).unionByName(
        asked.where("_tried").select("etf_code", "_day", F.lit(False).alias("_there"))
    )
    days = days.where("_day is not null").groupBy("etf_code", "_day").agg(F.max("_there").alias("_there"))
    so_far = W.partitionBy("etf_code").orderBy("_day").rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = F.last(F.when(F.col("_there"), F.col("_day")), ignorenulls=True).over(so_far)
    found = days.select("etf_code", "_day", newest.alias("_found"), F.lit(True).alias("_tried")).where("_found is not null")
    distance = F.date_diff("_day", "_found")
    hit = F.coalesce(distance <= F.col("_allowed"), F.lit(False))
    kept = [c for c in requests.columns if c not in ("lookback_days", "anchor_date", "attempted")]
    return asked.join(materialize(found, "newest-days"), ["etf_code", "_day", "_tried"], "left").select(
        *kept,
        F.when(hit, F.col("_found")).alias("resolved_base_date"),
        F.when(hit, distance).when(F.col("_tried"), F.col("_allowed")).alias("lookback_days"),
        F.when(~F.col("_tried"), "NOT_ATTEMPTED")
        .when(hit & (distance == 0), "EXACT")
        .when(hit, "RESOLVED_PRIOR")
        .otherwise("UNRESOLVED")
        .alias("date_status"),
    )


def priority_of(provider: Column | str, priority: Sequence[str] = PROVIDER_PRIORITY) -> Column:
    column = F.col(provider) if isinstance(provider, str) else provider
    listed = F.array(*[F.lit(p) for p in priority])
    place = F.array_position(listed, column)
    return F.when(place > 0, place).otherwise(F.lit(NOT_LISTED)).cast("int")


def check_attempts(attempts: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome of each (document, provider) attempt.

    An attempt that fetched nothing keeps its own status; a misshapen document or
    one with any misshapen row is INVALID_SCHEMA; else the business check decides.
    """
    keys = list(keys)
    by = [*keys, "provider"]
    judged = check_document_shape(check_business(attempts, check_shape(rows), by))
    fetched = F.col("fetch_status") == "OK" if "fetch_status" in attempts.columns else F.lit(True)
    failed = F.col("fetch_status") if "fetch_status" in attempts.columns else F.lit("EMPTY")
    outcome = (
        F.when(~fetched, failed)
        .when((F.col("misshapen_count") > 0) | (F.size("document_errors") > 0), "INVALID_SCHEMA")
        .otherwise(F.col("business_status"))
    )
    usable = fetched & outcome.isin("OK", "PARTIAL", "WEIGHT_MISSING") & (F.size("business_errors") == 0)
    return judged.withColumn("outcome", outcome).withColumn("usable", usable)


def resolve_holdings(
    checked: DataFrame, keys: Sequence[str], priority: Sequence[str] = PROVIDER_PRIORITY
) -> DataFrame:
    """First usable provider per document; its dataset is to be taken whole.

    ``checked`` comes from :func:`check_attempts` and has a ``listed`` column with
    the order in which providers were given.  A document has as many rows here as
    there are providers, so the per-document arrays stay tiny.
    """
    tries = F.sort_array(
        F.collect_list(
            F.struct(
                priority_of("provider", priority).alias("place"),
                "listed",
                "provider",
                "outcome",
                "usable",
                "row_count",
                "business_warnings",
            )
        )
    )
    grouped = checked.groupBy(*keys).agg(tries.alias("tries"))
    usable_flags = F.transform("tries", lambda t: t["usable"])
    winner_at = F.array_position(usable_flags, F.lit(True)).cast("int")
    made = F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.size("tries"))
    failures = F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(F.size("tries"))
    winner = F.get("tries", F.col("_at") - 1)
    last = F.get("tries", F.size("tries") - 1)
    resolved = F.col("_at") > 0
    return grouped.withColumn("_at", winner_at).select(
        *keys,
        F.when(resolved, winner["provider"]).otherwise(last["provider"]).alias("provider"),
        (resolved & (F.col("_at") > 1)).alias("is_fallback"),
        F.when(resolved, winner["outcome"]).otherwise("UNRESOLVED").alias("status"),
        F.transform(F.slice("tries", F.lit(1), made), lambda t: t["provider"]).alias(
            "attempted_providers"
        ),
        F.transform(
            F.slice("tries", F.lit(1), failures),
            lambda t: F.struct(t["provider"].alias("provider"), t["outcome"].alias("status")),
        ).alias("provider_failures"),
        F.when(resolved, winner["row_count"]).otherwise(F.lit(0)).alias("total_count"),
        F.when(resolved, winner["business_warnings"])
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
    )


#: What is kept of a judged attempt.
_JUDGED = ("provider", "listed", "outcome", "usable", "row_count", "business_warnings")


def resolve_in_rounds(
    attempts: DataFrame,
    raw: DataFrame,
    normalize: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    priority: Sequence[str] = PROVIDER_PRIORITY,
) -> DataFrame:
    """:func:`resolve_holdings`, asking a provider only for documents none before it settled.

    One round per provider, in order: its rows in ``raw`` (a filter that reaches the scan, or
    picks its partition) are normalized and judged for the documents still open.  Providers
    without a place in ``priority`` share the last round.  A round's outcomes are written, one
    row per attempt, and close documents for the rounds after it.
    """
    keys = list(keys)
    rounds = [F.col("provider") == p for p in priority] + [~F.coalesce(F.col("provider").isin(*priority), F.lit(False))]
    asked_for = {r.provider for r in attempts.select("provider").distinct().collect()}
    wanted = [bool(p in asked_for) for p in priority] + [bool(asked_for - set(priority))]
    judged = None
    for theirs in [condition for condition, there in zip(rounds, wanted) if there]:
        asked, rows = attempts.where(theirs), raw.where(theirs)
        if judged is not None:
            settled = judged.where("usable").select(*keys)
            asked = asked.join(settled, keys, "left_anti")
            rows = rows.join(settled, keys, "left_anti")
        outcome = check_attempts(asked, normalize(rows), keys).select(*keys, *_JUDGED)
        outcome = materialize(outcome, "judged")
        judged = outcome if judged is None else judged.unionByName(outcome)
    if judged is None:
        judged = check_attempts(attempts, normalize(raw), keys).select(*keys, *_JUDGED)
    return resolve_holdings(judged, keys, priority)


def winning_rows(documents: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each document's winner, and of nobody else.

    ``rows`` may be raw ones still; only those of winners then need to be normalized.
    """
    winners = documents.where(F.col("status") != "UNRESOLVED").select(*keys, "provider")
    return rows.join(winners, [*keys, "provider"], "left_semi")


def collection_status(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return documents.select(
        *keys,
        "status",
        "provider",
        "is_fallback",
        F.array_join("attempted_providers", ",").alias("attempted_providers"),
        (F.col("status") != "UNRESOLVED").alias("is_resolved"),
    )


def diagnostics(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failed attempts before the winner, in order."""
    return documents.select(
        *keys, F.posexplode("provider_failures").alias("place", "failure")
    ).select(*keys, "place", "failure.provider", "failure.status")


def resolve_capability(
    keys: DataFrame,
    sources: Sequence[tuple[str, DataFrame]],
    fallback: DataFrame | None,
    mode: str = "hybrid",
    key: str = "code",
) -> DataFrame:
    """Rows of the first source that has any for the key.

    ``live`` leaves keys without data unavailable; ``hybrid`` lets ``fallback``
    answer them and marks it; ``mock`` asks only ``fallback``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    offered = [] if mode == "mock" else [(name, df, False) for name, df in sources]
    if mode != "live" and fallback is not None:
        offered.append(("mock", fallback, mode == "hybrid"))
    if not offered:
        raise ValueError("no source to ask")
    stacked = None
    for place, (name, df, marked) in enumerate(offered):
        part = df.withColumns(
            {"_place": F.lit(place), "source": F.lit(name), "is_fallback": F.lit(marked)}
        )
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    best = stacked.groupBy(key).agg(F.min("_place").alias("_place"))
    rows = stacked.join(best, [key, "_place"], "left_semi").drop("_place")
    return keys.select(key).distinct().join(rows, key, "left").withColumns(
        {
            "status": F.when(F.col("source").isNull(), "unavailable").otherwise("ok"),
            "source": F.coalesce("source", F.lit("none")),
            "is_fallback": F.coalesce("is_fallback", F.lit(False)),
        }
    )


def pick_by_priority(
    values: DataFrame, keys: Sequence[str] = ("etf_code", "field"), recency: Sequence[str] = ()
) -> DataFrame:
    """The value of the highest-priority source per field; ``values`` keeps all of them.

    For fields listed in ``recency`` a newer as-of date goes before the priority.
    """
    order = [F.col("priority").desc(), F.col("source_id").asc()]
    if recency:
        dated = F.when(F.col("field").isin(*recency), F.col("as_of"))
        order = [dated.desc_nulls_last(), *order]
    return first_by(values.where(F.col("value").isNotNull()), list(keys), *order)


def provenance_record(
    values: DataFrame, fields: Sequence[str], key: str = "etf_code", recency: Sequence[str] = ()
) -> DataFrame:
    """One wide row per fund: for each of ``fields`` a struct of the chosen value and where it is from.

    The structs have value, source_id, as_of, priority, confidence and overridden, which is true
    where a newer as-of date of a ``recency`` field went before the priority.  A field that no
    source has is null.  A fund has as many rows here as it has fields, so the pivot is bounded.
    """
    keys = [key, "field"]
    chosen = pick_by_priority(values, keys, recency)
    overridden = F.lit(False)
    if recency:
        plain = pick_by_priority(values.where(F.col("field").isin(*recency)), keys)
        chosen = chosen.join(plain.select(*keys, F.col("source_id").alias("_plain")), keys, "left")
        overridden = F.coalesce(F.col("_plain") != F.col("source_id"), F.lit(False))
    facts = F.struct("value", "source_id", "as_of", "priority", "confidence", overridden.alias("overridden"))
    return chosen.select(*keys, facts.alias("fact")).groupBy(key).pivot("field", list(fields)).agg(F.first("fact"))


def choose_holdings(
    first: DataFrame, second: DataFrame, labels: tuple[str, str], key: str = "etf_code"
) -> DataFrame:
    """All holdings of the first source for funds it has, of the second for the others."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("holdings_source", F.lit(labels[0])).unionByName(
        rest.withColumn("holdings_source", F.lit(labels[1])), allowMissingColumns=True
    )


def conflicts(
    first: DataFrame, second: DataFrame, labels: tuple[str, str], key: str = "etf_code"
) -> DataFrame:
    """Funds both sources list, with holding names that differ in content or order.

    Lists are compared place by place (``rank`` counts within the fund), without
    building them.  Where a side has an as_of, the conflict carries the newest of both.
    """

    def as_of(df: DataFrame) -> Column:
        return F.col("as_of") if "as_of" in df.columns else F.lit(None).cast("date")

    dated = "as_of" in first.columns or "as_of" in second.columns
    dates = [F.max("_da").alias("selected_as_of"), F.max("_db").alias("other_as_of")] if dated else []
    a = first.select(key, "rank", F.col("name").alias("_a"), F.lit(1).alias("_in_a"), *([as_of(first).alias("_da")] if dated else []))
    b = second.select(key, "rank", F.col("name").alias("_b"), F.lit(1).alias("_in_b"), *([as_of(second).alias("_db")] if dated else []))
    per_fund = (
        a.join(b, [key, "rank"], "full")
        .groupBy(key)
        .agg(
            *dates,
            F.count("_in_a").alias("selected_count"),
            F.count("_in_b").alias("other_count"),
            F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing_places"),
        )
    )
    both = (F.col("selected_count") > 0) & (F.col("other_count") > 0)
    return per_fund.where(both & (F.col("differing_places") > 0)).select(
        key,
        F.lit("holdings").alias("field"),
        F.lit(labels[0]).alias("selected_source"),
        "selected_count",
        F.lit(labels[1]).alias("other_source"),
        "other_count",
        "differing_places",
        *(["selected_as_of", "other_as_of"] if dated else []),
    )
