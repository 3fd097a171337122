"""Fund universe: merging sources, overlaying quotes and rolling up to themes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import exact_mean, exact_sum, finite, half_up, name_key, pct_change
from ..functions.clean import lookup_code
from ..functions.names import code_type
from .ordering import first_by

# Quote field -> fund column it overlays.
QUOTE_FIELDS = {
    "price": "current_price",
    "change_rate": "change_rate_1d",
    "return_1w": "return_1w",
    "return_1m": "return_1m",
    "trading_value": "trading_value",
    "trading_value_change_rate": "trading_value_change_rate",
}
# Fields taken from the snapshot, and source -> target of the roll-up.
SNAPSHOT_FIELDS = ("net_assets", "nav", "market_cap")
ROLLUP_FIELDS = {
    "change_rate_1d": "return_1d",
    "return_1w": "return_1w",
    "return_1m": "return_1m",
    "trading_value_change_rate": "trading_value_change_rate",
}


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "code" else prefix + c) for c in df.columns])


def merge_universe(curated: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Curated funds enriched from the snapshot, plus a thin row per other snapshot code.

    Both sides carry one row per code.  ``prev_close`` and ``is_curated`` serve
    the overlays that follow.
    """
    # One full join reads each side once; codes are unique, so no key is hot.
    have = curated.columns
    both = curated.withColumn("_curated", F.lit(True)).join(
        _prefixed(snapshot, "s_"), "code", "full"
    )
    known = F.coalesce("_curated", F.lit(False))
    thin_values = {
        "id": F.concat(F.lit("etf-"), F.col("code")),
        "name": F.col("s_name"),
        "current_price": F.col("s_prev_close"),
        "change_rate_1d": F.col("s_change_rate"),
        "trading_value": F.col("s_trading_value"),
    }

    def merged(name: str) -> Column:
        stored = F.col(name) if name in have else F.lit(None)
        if name in SNAPSHOT_FIELDS:
            return F.coalesce(finite(F.col(f"s_{name}")), stored)
        if name == "index_name":
            given = F.when(~known | (F.col("s_index_name") != ""), F.col("s_index_name"))
            return F.coalesce(given, stored)
        if name in thin_values:
            return F.when(known, stored).otherwise(thin_values[name])
        return stored

    names = list(dict.fromkeys([*have, *thin_values, *SNAPSHOT_FIELDS, "index_name"]))
    return both.select(
        *[F.col("code") if name == "code" else merged(name).alias(name) for name in names],
        F.col("s_prev_close").alias("prev_close"),
        known.alias("is_curated"),
    )


def overlay(
    base: DataFrame, quotes: DataFrame, fields: Mapping[str, str] = QUOTE_FIELDS
) -> DataFrame:
    """Put every live figure over the stored one; a missing live figure changes nothing."""
    live = _prefixed(quotes.select("code", *fields), "q_")
    joined = base.join(live, "code", "left")
    replaced = {
        target: F.coalesce(finite(F.col(f"q_{source}")), F.col(target))
        for source, target in fields.items()
    }
    return joined.withColumns(replaced).select(*base.columns)


def overlay_thin(thin: DataFrame, prices: DataFrame) -> DataFrame:
    """Live price on thin rows, with the change against the stored previous close."""
    live = prices.select("code", finite("price").alias("_live"))
    joined = thin.join(live, "code", "left")
    change = pct_change(F.col("_live"), F.col("prev_close"))
    return joined.withColumns(
        {
            "current_price": F.coalesce(F.col("_live"), F.col("current_price")),
            "change_rate_1d": F.coalesce(change, F.col("change_rate_1d")),
        }
    ).select(*thin.columns)


def overlay_universe(universe: DataFrame, quotes: DataFrame, prices: DataFrame) -> DataFrame:
    """:func:`overlay` on curated rows and :func:`overlay_thin` on the others, in one pass."""
    live = _prefixed(quotes.select("code", *QUOTE_FIELDS), "q_")
    last = prices.select("code", finite("price").alias("_live"))
    joined = universe.join(live, "code", "left").join(last, "code", "left")
    known = F.col("is_curated")
    values = {
        target: F.when(known, finite(F.col(f"q_{source}")))
        for source, target in QUOTE_FIELDS.items()
    }
    values["current_price"] = F.when(known, finite("q_price")).otherwise(F.col("_live"))
    values["change_rate_1d"] = F.when(known, finite("q_change_rate")).otherwise(
        pct_change(F.col("_live"), F.col("prev_close"))
    )
    return joined.withColumns(
        {name: F.coalesce(value, F.col(name)) for name, value in values.items()}
    ).select(*universe.columns)


def overlay_stats(base: DataFrame, quotes: DataFrame) -> DataFrame:
    """How many of the funds a quote row matched, and how many of these have a price."""
    live = quotes.select("code", F.lit(1).alias("_hit"), F.col("price").alias("_price"))
    return base.join(live, "code", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_hit").alias("matched"),
        F.count("_price").alias("priced"),
    )


def theme_rollup(themes: DataFrame, members: DataFrame) -> DataFrame:
    """Theme figures from its member funds; a figure no member has keeps its old value."""
    rolled = members.groupBy("theme_id").agg(
        *[
            half_up(exact_mean(finite(source), 4), 2).alias(f"m_{target}")
            for source, target in ROLLUP_FIELDS.items()
        ],
        half_up(exact_sum(finite("trading_value"), 4)).alias("m_trading_value"),
    )
    figures = [*ROLLUP_FIELDS.values(), "trading_value"]
    joined = themes.join(rolled, themes["id"] == rolled["theme_id"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"m_{c}"), themes[c]).alias(c) if c in figures else themes[c]
            for c in themes.columns
        ]
    )


def breadth(universe: DataFrame, themes: DataFrame) -> DataFrame:
    """Advancers, decliners, unchanged (missing rates included) and the theme extremes.

    On equal returns the theme that comes first in its table stays, at both ends.
    """
    rate = finite("change_rate_1d")
    market = universe.agg(
        F.count(F.lit(1)).alias("funds"),
        F.count_if(rate > 0).alias("advancers"),
        F.count_if(rate < 0).alias("decliners"),
        half_up(exact_sum(finite("trading_value"), 4)).alias("total_trading_value"),
    )
    ends = themes.where(F.col("return_1d").isNotNull()).agg(
        F.min_by("id", F.struct(-F.col("return_1d"), F.col("ord"))).alias("strongest_theme_id"),
        F.min_by("id", F.struct(F.col("return_1d"), F.col("ord"))).alias("weakest_theme_id"),
    )
    # One row each, so the union has two rows and max() picks the one that is set.
    both = market.unionByName(ends, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "advancers",
        "decliners",
        (F.col("funds") - F.col("advancers") - F.col("decliners")).alias("unchanged"),
        "total_trading_value",
        "strongest_theme_id",
        "weakest_theme_id",
    )


def master_list(items: DataFrame) -> DataFrame:
    """Fund master from listed items: first row per code, code type attached.

    ``items``: ord, item_code, item_name and any reference figures.
    """
    coded = items.withColumn("etf_code", F.upper(F.trim(F.col("item_code").cast("string"))))
    first = first_by(coded, "etf_code", F.col("ord").asc())
    return first.withColumnRenamed("item_name", "name").withColumn(
        "code_type", code_type("etf_code")
    ).drop("item_code")


def master_counts(items: DataFrame) -> DataFrame:
    """Funds, numeric codes, unresolved codes and duplicates dropped."""
    per_code = (
        items.select(F.upper(F.trim(F.col("item_code").cast("string"))).alias("etf_code"))
        .groupBy("etf_code")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    numeric = code_type("etf_code") == "krx_numeric"
    return per_code.agg(
        F.count(F.lit(1)).alias("funds"),
        F.count_if(numeric).alias("numeric_codes"),
        F.count_if(~numeric).alias("unresolved_codes"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates_dropped"),
    )


def lookup_holdings(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """Find the holdings owner of a request by code, else by exact name key.

    ``requests``: request_id, name.  ``holders``: ord, code, name - one row per
    fund that has holdings.  A request nothing matches stays without a code.
    """
    asked = requests.withColumn("_code", lookup_code("request_id")).withColumn(
        "_name", name_key("name")
    )
    by_code = holders.select(F.col("code").alias("_code"), F.col("code").alias("_by_code"))
    named = holders.withColumn("_name", name_key("name")).where(F.col("_name") != "")
    by_name = first_by(named, "_name", F.col("ord").asc()).select(
        "_name", F.col("code").alias("_by_name")
    )
    found = asked.join(by_code, "_code", "left").join(by_name, "_name", "left")
    return found.select(
        *requests.columns,
        F.coalesce("_by_code", "_by_name").alias("holdings_code"),
        F.when(F.col("_by_code").isNotNull(), "code")
        .when(F.col("_by_name").isNotNull(), "name")
        .otherwise("none")
        .alias("matched_by"),
    )


