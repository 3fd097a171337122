"""Queries over ticks, quotes, themes and the universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as bar_ops
from ..operators import quality, screen
from ..operators import universe as universe_ops
from ..sources import readers, tables
from . import sql as q
from .registry import catalog

SQL_DAY = "strftime(ts, '%Y-%m-%d') AS day"


def day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


@catalog.query(
    "daily_bars",
    q.given(q.TICKS, q.BARS) + f"SELECT code, {SQL_DAY}, o, h, l, c, v, ticks FROM bars",
)
def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    return tables.daily_bars(spark, folder).select("code", day(), "o", "h", "l", "c", "v", "ticks")


@catalog.query(
    "bar_returns",
    q.given(q.TICKS, q.BARS, q.QUOTES)
    + """SELECT code, price, change, change_rate, return_1w, return_1m, trading_value,
                trading_value_change_rate FROM quotes""",
)
def bar_returns(spark: SparkSession, folder: str) -> DataFrame:
    return tables.quotes(spark, folder).drop("ts", "spread")


@catalog.query(
    "bar_last_n",
    q.given(q.TICKS)
    + """, pages AS (
  SELECT code, date_trunc('hour', ts) AS ts, price, tick_id FROM ticks
  QUALIFY row_number() OVER (PARTITION BY code, date_trunc('hour', ts) ORDER BY tick_id) = 1),
newest AS (
  SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC) <= 20)
SELECT code, strftime(ts, '%Y-%m-%d %H') AS hour, price, tick_id,
       row_number() OVER (PARTITION BY code ORDER BY ts) AS position FROM newest""",
)
def bar_last_n(spark: SparkSession, folder: str) -> DataFrame:
    hourly = tables.ticks(spark, folder).select(
        "code", F.date_trunc("hour", "ts").alias("ts"), "price", "tick_id"
    )
    return bar_ops.last_bars(hourly, 20, ordinal="tick_id").select(
        "code", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "price", "tick_id",
        F.col("position").cast("bigint").alias("position"),
    )


@catalog.query(
    "bar_downsample",
    q.given(q.TICKS, q.BARS)
    + f"""SELECT code, {SQL_DAY}, c FROM bars
QUALIFY (row_number() OVER (PARTITION BY code ORDER BY ts) - 1) % 5 = 0
     OR row_number() OVER (PARTITION BY code ORDER BY ts DESC) = 1""",
)
def bar_downsample(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.downsample(tables.daily_bars(spark, folder), 5).select("code", day(), "c")


@catalog.query(
    "bar_cum_return",
    q.given(q.TICKS, q.BARS)
    + f"""SELECT code, {SQL_DAY}, c,
  {q.pct('c', 'first_value(c) OVER (PARTITION BY code ORDER BY ts)')} AS cum_return FROM bars""",
)
def bar_cum_return(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.cumulative_return(tables.daily_bars(spark, folder)).select(
        "code", day(), "c", "cum_return"
    )


@catalog.query(
    "bar_scaled",
    q.given(q.TICKS, q.BARS)
    + f""", ends AS (SELECT code, min(c) AS low, max(c) AS high FROM bars GROUP BY code)
SELECT code, {SQL_DAY}, (c - low) / (CASE WHEN high - low = 0 THEN 1.0 ELSE high - low END) AS scaled
FROM bars JOIN ends USING (code)""",
)
def bar_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.scaled(tables.daily_bars(spark, folder)).select("code", day(), "scaled")


@catalog.query(
    "period_return",
    q.given(q.TICKS, q.BARS)
    + f""", newest AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back FROM bars
  QUALIFY back <= 22),
ends AS (
  SELECT code, count(*) AS bars, last(c ORDER BY back) AS first_close, first(c ORDER BY back) AS last_close
  FROM newest GROUP BY code)
SELECT code, '1M' AS period, bars, first_close, last_close,
       CASE WHEN bars >= 2 THEN {q.pct('last_close', 'first_close')} END AS period_return FROM ends""",
)
def period_return(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.period_return(tables.daily_bars(spark, folder), "1M")


def _ranking_sql(column: str, direction: str) -> str:
    return q.given(*q.MARKET) + f"""
SELECT row_number() OVER (ORDER BY {column} {direction}, trading_value DESC NULLS LAST, name, id) AS rank,
       id, name, {column} AS figure, trading_value
FROM quoted WHERE {column} IS NOT NULL"""


def _ranking(tab: str):
    column = screen.RANKING_TABS[tab][0]

    def plan(spark: SparkSession, folder: str) -> DataFrame:
        return screen.ranked(tables.quoted_funds(spark, folder), tab).select(
            "rank", "id", "name", F.col(column).alias("figure"), "trading_value"
        )

    return plan


for _tab, (_column, _ascending) in screen.RANKING_TABS.items():
    catalog.query(f"rank_{_tab}", _ranking_sql(_column, "ASC" if _ascending else "DESC"))(_ranking(_tab))


@catalog.query(
    "rank_cards",
    q.given(*q.MARKET)
    + """SELECT row_number() OVER (ORDER BY change_rate_1d DESC, trading_value DESC NULLS LAST, name, id)
       AS rank, id, name, change_rate_1d FROM quoted WHERE change_rate_1d IS NOT NULL
ORDER BY rank LIMIT 8""",
)
def rank_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The first cards of a ranking tab: the limit is the feature."""
    cards = screen.ranked(tables.quoted_funds(spark, folder), "gainers", limit=screen.RANKING_CARDS)
    return cards.select(F.col("rank").cast("bigint").alias("rank"), "id", "name", "change_rate_1d")


def rolled_themes(spark: SparkSession, folder: str) -> DataFrame:
    return universe_ops.theme_rollup(
        tables.themes(spark, folder), tables.quoted_funds(spark, folder)
    )


@catalog.query(
    "theme_rollup",
    q.given(*q.MARKET, q.ROLLED)
    + """SELECT id, return_1d, return_1w, return_1m, trading_value, trading_value_change_rate
FROM themes""",
)
def theme_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rolled_themes(spark, folder).drop("ord", "name")


@catalog.query(
    "theme_heatmap",
    q.given(*q.MARKET, q.ROLLED)
    + """SELECT row_number() OVER w AS position, id AS theme_id, name, return_1d AS return_rate,
  trading_value,
  CASE WHEN row_number() OVER w <= 2 THEN 'lg' WHEN row_number() OVER w <= 6 THEN 'md' ELSE 'sm' END
    AS size_class,
  CASE WHEN return_1d > 0 THEN 'up-' WHEN return_1d < 0 THEN 'down-' ELSE 'flat' END ||
  CASE WHEN return_1d = 0 THEN '' WHEN abs(return_1d) >= 3 THEN '3' WHEN abs(return_1d) >= 1.5 THEN '2'
       ELSE '1' END AS tone,
  CASE WHEN max(trading_value) OVER () > 0 THEN trading_value / max(trading_value) OVER () ELSE 0.0 END
    AS relative_size
FROM themes WINDOW w AS (ORDER BY trading_value DESC, name, id)""",
)
def theme_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return screen.heatmap(rolled_themes(spark, folder), "1d")


@catalog.query(
    "theme_extremes",
    q.given(*q.MARKET, q.ROLLED)
    + " UNION ALL ".join(
        f"""SELECT '{period}' AS period,
  (SELECT id FROM themes ORDER BY {column} DESC, trading_value DESC, name, id LIMIT 1) AS strongest_id,
  (SELECT id FROM themes ORDER BY {column} ASC, trading_value DESC, name, id LIMIT 1) AS weakest_id"""
        for period, column in screen.PERIOD_RETURNS.items()
    ),
)
def theme_extremes(spark: SparkSession, folder: str) -> DataFrame:
    return screen.all_extremes(rolled_themes(spark, folder))


@catalog.query(
    "top_themes",
    q.given(*q.MARKET, q.ROLLED)
    + """SELECT row_number() OVER (ORDER BY trading_value DESC, ord) AS position, id, trading_value
FROM themes ORDER BY position LIMIT 6""",
)
def top_themes(spark: SparkSession, folder: str) -> DataFrame:
    return screen.top_themes(rolled_themes(spark, folder)).select(
        F.col("position").cast("bigint").alias("position"), "id", "trading_value"
    )


_BREADTH_SQL = f"""
SELECT count(*) FILTER (WHERE change_rate_1d > 0) AS advancers,
       count(*) FILTER (WHERE change_rate_1d < 0) AS decliners,
       count(*) - count(*) FILTER (WHERE change_rate_1d > 0) - count(*) FILTER (WHERE change_rate_1d < 0)
         AS unchanged,
       {q.half_up(q.exact_sum('trading_value'))} AS total_trading_value,
       (SELECT id FROM themes ORDER BY return_1d DESC, ord LIMIT 1) AS strongest_theme_id,
       (SELECT id FROM themes ORDER BY return_1d ASC, ord LIMIT 1) AS weakest_theme_id
FROM quoted"""


@catalog.query("market_breadth", q.given(*q.MARKET, q.ROLLED) + _BREADTH_SQL)
def market_breadth(spark: SparkSession, folder: str) -> DataFrame:
    return universe_ops.breadth(
        tables.quoted_funds(spark, folder), rolled_themes(spark, folder)
    )


UNIVERSE_COLUMNS = (
    "id", "code", "name", "theme_id", "current_price", "change_rate_1d", "trading_value",
    "net_assets", "nav", "market_cap", "index_name", "prev_close", "is_curated",
)


def merged_universe(spark: SparkSession, folder: str) -> DataFrame:
    return universe_ops.merge_universe(
        tables.curated_funds(spark, folder), tables.snapshot(spark, folder)
    )


@catalog.query("universe_merge", q.given(q.FUNDS, q.SNAPSHOT, q.UNIVERSE) + "SELECT * FROM universe")
def universe_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged_universe(spark, folder).select(*UNIVERSE_COLUMNS)


@catalog.query(
    "quote_overlay",
    q.given(q.TICKS, q.BARS, q.QUOTES, q.FUNDS, q.SNAPSHOT, q.UNIVERSE, q.LAST_ORDERS)
    + f"""SELECT u.code, u.is_curated,
  CASE WHEN is_curated THEN coalesce(q.price, u.current_price)
       ELSE coalesce(o.price, u.current_price) END AS current_price,
  CASE WHEN is_curated THEN coalesce(q.change_rate, u.change_rate_1d)
       ELSE coalesce({q.pct('o.price', 'u.prev_close')}, u.change_rate_1d) END AS change_rate_1d,
  CASE WHEN is_curated THEN coalesce(q.trading_value, u.trading_value) ELSE u.trading_value END
    AS trading_value
FROM universe u LEFT JOIN quotes q ON u.code = q.code LEFT JOIN last_orders o ON u.code = o.code""",
)
def quote_overlay(spark: SparkSession, folder: str) -> DataFrame:
    overlaid = universe_ops.overlay_universe(
        merged_universe(spark, folder),
        tables.quotes(spark, folder),
        tables.last_order_prices(spark, folder),
    )
    return overlaid.select("code", "is_curated", "current_price", "change_rate_1d", "trading_value")


@catalog.query(
    "overlay_stats",
    q.given(q.TICKS, q.BARS, q.QUOTES, q.FUNDS)
    + """SELECT count(*) AS total, count(q.code) AS matched, count(q.price) AS priced
FROM funds f LEFT JOIN quotes q USING (code)""",
)
def overlay_stats(spark: SparkSession, folder: str) -> DataFrame:
    return universe_ops.overlay_stats(tables.funds(spark, folder), tables.quotes(spark, folder))


@catalog.query(
    "latest_snapshot",
    f"""SELECT {q.code('o_custkey')} AS code, strftime(o_orderdate, '%Y-%m-%d') AS bas_dt,
       o_totalprice AS prev_close, {q.half_up('o_totalprice / 1000.0')} AS trading_value
FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
)
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read(spark, folder, "orders")
    newest = readers.latest_snapshot(orders, "o_orderdate")
    return newest.select(
        tables.code_of("o_custkey").alias("code"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("bas_dt"),
        F.col("o_totalprice").alias("prev_close"),
        tables.clean.half_up(F.col("o_totalprice") / 1000.0).alias("trading_value"),
    )


@catalog.query(
    "master_counts",
    f"""WITH items AS (
  SELECT CASE WHEN event_type = 'error' THEN 'E' || {q.code('user_id')} ELSE {q.code('user_id')} END
    AS etf_code FROM events),
per_code AS (SELECT etf_code, count(*) AS n FROM items GROUP BY etf_code)
SELECT count(*) AS funds,
       count(*) FILTER (WHERE regexp_full_match(etf_code, '[0-9]{{6}}')) AS numeric_codes,
       count(*) FILTER (WHERE NOT regexp_full_match(etf_code, '[0-9]{{6}}')) AS unresolved_codes,
       CAST(sum(n - 1) AS BIGINT) AS duplicates_dropped FROM per_code""",
)
def master_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.read(spark, folder, "events")
    prefix = F.when(F.col("event_type") == "error", " e").otherwise("")
    return universe_ops.master_counts(
        events.select(F.concat(prefix, tables.code_of("user_id")).alias("item_code"))
    )


@catalog.query(
    "status_rollup",
    f"""WITH tagged AS (
  SELECT o_orderpriority AS g, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'PARTIAL' ELSE 'EMPTY' END
    AS status FROM orders),
counted AS (
  SELECT coalesce(g, 'ALL') AS group_name, count(*) AS total,
         count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'PARTIAL') AS partial,
         count(*) FILTER (WHERE status = 'EMPTY') AS empty, CAST(0 AS BIGINT) AS request_failed
  FROM tagged GROUP BY ROLLUP (g))
SELECT *, floor((ok + partial) / total * 100.0 * 100 + 0.5) / 100.0 AS success_pct,
       (ok + partial) / total * 100.0 >= 80.0 AS passes_gate FROM counted""",
)
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read(spark, folder, "orders").select(
        "o_orderpriority",
        tables.mapped("o_orderstatus", {"F": "OK", "P": "PARTIAL"}, "EMPTY").alias("status"),
    )
    return quality.status_rollup(orders, "o_orderpriority")


@catalog.query(
    "envelope_status",
    f"""WITH parts AS (
  SELECT {q.code('user_id')} AS code, strftime(ts, '%Y-%m-%d') AS day,
         {q.case('event_type', tables.FEED_STATES, "'ok'")} AS status FROM events)
SELECT code, day,
  CASE WHEN bool_and(status = 'unavailable') THEN 'unavailable'
       WHEN bool_or(status IN ('unavailable', 'partial')) THEN 'partial'
       WHEN bool_or(status = 'stale') THEN 'stale' ELSE 'ok' END AS status,
  count(*) AS parts FROM parts GROUP BY code, day""",
)
def envelope_status(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.read(spark, folder, "events").select(
        tables.code_of("user_id").alias("code"), day(),
        tables.mapped("event_type", tables.FEED_STATES, "ok").alias("status"),
    )
    return quality.combine_status(parts, ["code", "day"])


FRESHNESS_NOW = "2024-01-31 00:00:00"


@catalog.query(
    "freshness",
    f"""WITH newest AS (
  SELECT {q.code('user_id')} AS code, max(ts) AS ts,
         last({q.case('event_type', tables.FEED_STATES, "'ok'")} ORDER BY ts, event_id) AS status
  FROM events GROUP BY user_id),
aged AS (
  SELECT *, CAST(greatest(0, floor((epoch_us(TIMESTAMP '{FRESHNESS_NOW}') - epoch_us(ts)) / 1000000.0 / 60 + 0.5))
    AS BIGINT) AS delay_minutes FROM newest)
SELECT code, delay_minutes, delay_minutes >= 600 AS is_delayed,
       CASE WHEN delay_minutes >= 600 AND status = 'ok' THEN 'stale' ELSE status END AS status FROM aged""",
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    state = tables.mapped("event_type", tables.FEED_STATES, "ok")
    newest = tables.read(spark, folder, "events").groupBy(tables.code_of("user_id").alias("code")).agg(
        F.max("ts").cast("timestamp").alias("as_of"),
        F.max_by(state, F.struct("ts", "event_id")).alias("status"),
    )
    now = F.lit(FRESHNESS_NOW).cast("timestamp_ntz").cast("timestamp")
    return quality.freshness(newest, now, threshold=600).drop("as_of")
