"""Queries over holdings, screens and the content feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content as content_ops
from ..operators import holdings as holding_ops
from ..operators import screen
from ..operators.ordering import top_per_key
from ..sources import tables
from . import sql as q
from .registry import catalog


@catalog.query(
    "fund_holdings",
    q.given(q.HOLDINGS, q.STOCKS)
    + """SELECT etf_id AS code, rank, s.id AS stock_code, s.name AS stock_name, weight
FROM ranked LEFT JOIN stocks s ON stock_id = s.id""",
)
def fund_holdings(spark: SparkSession, folder: str) -> DataFrame:
    return holding_ops.fund_holdings(
        tables.funds(spark, folder),
        tables.ranked_holdings(spark, folder),
        tables.stocks(spark, folder),
    )


@catalog.query(
    "funds_by_stock",
    q.given(*q.MARKET, q.HOLDINGS)
    + """SELECT stock_id, etf_id, weight, rank,
  row_number() OVER (PARTITION BY stock_id ORDER BY weight DESC, trading_value DESC NULLS LAST, name, etf_id)
    AS position,
  greatest(4.0, floor(weight / greatest(max(weight) OVER (PARTITION BY stock_id), 1.0) * 100 + 0.5))
    AS bar_width
FROM ranked JOIN quoted ON etf_id = id""",
)
def funds_by_stock(spark: SparkSession, folder: str) -> DataFrame:
    edges = tables.ranked_holdings(spark, folder).withColumn("ord", F.col("rank"))
    rows = screen.funds_by_stock(tables.quoted_funds(spark, folder), edges)
    return screen.with_bars(rows).select(
        "stock_id", "etf_id", "weight", "rank", "position", "bar_width"
    )


@catalog.query(
    "fund_compare",
    q.given(*q.MARKET, q.HOLDINGS, q.STOCKS)
    + """, best AS (
  SELECT etf_id, string_agg(name, '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS names,
         max(CASE WHEN rank = 1 THEN weight END) + max(CASE WHEN rank = 2 THEN weight END) AS top2
  FROM ranked LEFT JOIN stocks ON stock_id = id GROUP BY etf_id)
SELECT f.id AS etf_id, f.name, coalesce(names, '') AS top_holding_names, top2 AS top2_concentration,
       f.net_assets, f.trading_value, f.return_1m
FROM quoted f LEFT JOIN best ON f.id = etf_id""",
)
def fund_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Every fund's comparison row; the three best edges are all a comparison needs."""
    best = top_per_key(
        tables.holdings(spark, folder), "etf_id",
        [F.col("weight").desc(), F.col("stock_id").asc()], 3, name="rank",
    )
    compared = screen.compare(
        tables.quoted_funds(spark, folder), best, tables.stocks(spark, folder)
    )
    return compared.select(
        "etf_id", "name", F.array_join("top_holding_names", "|").alias("top_holding_names"),
        "top2_concentration", "net_assets", "trading_value", "return_1m",
    )


@catalog.query(
    "holdings_top10",
    q.given(q.HOLDINGS) + "SELECT etf_id, stock_id, weight, rank FROM ranked WHERE rank <= 10",
)
def holdings_top10(spark: SparkSession, folder: str) -> DataFrame:
    return holding_ops.top_holdings(tables.holdings(spark, folder)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@catalog.query(
    "holdings_top_weight",
    q.given(q.HOLDINGS)
    + f"""SELECT etf_id, {q.half_up(q.exact_sum('weight'), 2)} AS top_weight
FROM ranked WHERE rank <= 10 GROUP BY etf_id""",
)
def holdings_top_weight(spark: SparkSession, folder: str) -> DataFrame:
    return holding_ops.top_weight_total(tables.holdings(spark, folder))


@catalog.query(
    "holdings_summary",
    q.given(q.HOLDINGS)
    + """, counted AS (SELECT *, count(*) OVER (PARTITION BY etf_id) AS total_count FROM ranked)
SELECT etf_id, stock_id, weight, rank, total_count FROM counted WHERE rank <= 3""",
)
def holdings_summary(spark: SparkSession, folder: str) -> DataFrame:
    return holding_ops.holding_summary(tables.holdings(spark, folder), 3).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@catalog.query(
    "derived_arrays",
    q.given(q.HOLDINGS)
    + "SELECT etf_id, rank AS place, stock_id FROM ranked",
)
def derived_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return holding_ops.holding_ids(tables.holdings(spark, folder), [F.col("weight").desc(), F.col("stock_id").asc()])


@catalog.query(
    "related_funds",
    q.given(q.HOLDINGS)
    + """SELECT stock_id, etf_id,
  row_number() OVER (PARTITION BY stock_id ORDER BY CAST(etf_id AS BIGINT), etf_id) AS position
FROM holdings""",
)
def related_funds(spark: SparkSession, folder: str) -> DataFrame:
    edges = tables.holdings(spark, folder).withColumn("ord", F.col("etf_id").cast("bigint"))
    return holding_ops.related_funds(edges)


@catalog.query(
    "funds_by_theme",
    q.given(q.FUNDS) + "SELECT id, name, net_assets FROM funds WHERE theme_id = 'BUILDING'",
)
def funds_by_theme(spark: SparkSession, folder: str) -> DataFrame:
    return screen.by_theme(tables.funds(spark, folder), "BUILDING").select("id", "name", "net_assets")


def _search_sql(needle: str) -> str:
    hit = f"contains(lower(name), '{needle}')"
    return f"""SELECT '{needle}' AS needle, 'etf' AS kind, id, name FROM funds
  WHERE {hit} OR contains(lower(code), '{needle}')
UNION ALL SELECT '{needle}', 'stock', id, name FROM stocks WHERE {hit} OR contains(lower(id), '{needle}')
UNION ALL SELECT DISTINCT '{needle}', 'theme', theme_id, theme_id FROM funds
  WHERE contains(lower(theme_id), '{needle}')"""


@catalog.query(
    "search_all",
    q.given(q.FUNDS, q.STOCKS) + _search_sql("12") + "\nUNION ALL " + _search_sql("in"),
)
def search_all(spark: SparkSession, folder: str) -> DataFrame:
    etf, stock = tables.funds(spark, folder), tables.stocks(spark, folder)
    theme = tables.themes(spark, folder)

    def find(query: str) -> DataFrame:
        found = screen.search(etf, stock, theme, query)
        return found.select(F.lit(query.strip().lower()).alias("needle"), "kind", "id", "name")

    return find(" 12 ").unionByName(find("In"))


@catalog.query(
    "chip_filter",
    q.given(q.RECORDS)
    + " UNION ALL ".join(
        f"SELECT '{chip}' AS chip, etf_code FROM records WHERE "
        + " OR ".join(f"contains(upper(name), '{w.upper()}')" for w in words)
        for chip, words in screen.CHIP_KEYWORDS.items()
    ),
)
def chip_filter(spark: SparkSession, folder: str) -> DataFrame:
    return screen.chip_members(tables.fund_records(spark, folder)).select("chip", "etf_code")


@catalog.query(
    "watchlist",
    q.given(q.FUNDS)
    + """SELECT code, name FROM funds
WHERE ord IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def watchlist(spark: SparkSession, folder: str) -> DataFrame:
    bought = tables.read(spark, folder, "events").where(F.col("event_type") == "purchase")
    codes = bought.select(tables.code_of("user_id").alias("code"))
    return screen.watchlist(tables.funds(spark, folder), codes).select("code", "name")


@catalog.query(
    "explore_page",
    q.given(*q.MARKET)
    + """SELECT row_number() OVER (ORDER BY trading_value DESC NULLS LAST, ord) AS position, code,
  trading_value AS sort_value
FROM quoted WHERE contains(lower(name), '1') OR contains(lower(code), '1')
ORDER BY position LIMIT 5""",
)
def explore_page(spark: SparkSession, folder: str) -> DataFrame:
    """One page of the explorer list: the limit is the feature."""
    page = screen.explore(tables.quoted_funds(spark, folder), query=" 1", sort="trading_value")
    return page.select(F.col("position").cast("bigint").alias("position"), "code", "sort_value")


_CONTENT = f"""content AS (
  SELECT event_id AS id, {q.case('event_type', tables.CONTENT_TYPES, "'other'")} AS type,
         event_type || ':' || event_id AS summary, ts AS published_at,
         {q.code('user_id')} AS fund_a, {q.code("json_extract_string(props, '$.k')")} AS fund_b
  FROM events),
named AS (
  SELECT id, type, summary, published_at, fund_a AS etf_id FROM content
  UNION ALL SELECT id, type, summary, published_at, fund_b FROM content WHERE fund_a <> fund_b)"""


@catalog.query(
    "content_feed",
    q.given(_CONTENT)
    + """SELECT row_number() OVER (ORDER BY published_at DESC, id) AS position, id, summary
FROM content WHERE type = 'news'""",
)
def content_feed(spark: SparkSession, folder: str) -> DataFrame:
    return content_ops.content_feed(tables.content(spark, folder), "news").select(
        "position", "id", "summary"
    )


@catalog.query(
    "content_by_fund",
    q.given(_CONTENT, q.FUNDS)
    + "SELECT code, n.id AS content_id, type, summary FROM named n JOIN funds f ON n.etf_id = f.id",
)
def content_by_fund(spark: SparkSession, folder: str) -> DataFrame:
    return content_ops.content_by_fund(
        tables.content(spark, folder), tables.funds(spark, folder)
    ).drop("published_at")


@catalog.query(
    "first_news",
    q.given(_CONTENT)
    + """SELECT etf_id, id AS content_id, summary FROM named WHERE type = 'news'
QUALIFY row_number() OVER (PARTITION BY etf_id ORDER BY id) = 1""",
)
def first_news(spark: SparkSession, folder: str) -> DataFrame:
    return content_ops.first_news(tables.content(spark, folder))


@catalog.query(
    "theme_representatives",
    q.given(q.FUNDS, q.STOCKS)
    + """, listed AS (
  SELECT theme_id, row_number() OVER (PARTITION BY theme_id ORDER BY net_assets DESC, id) - 1 AS place, id
  FROM funds QUALIFY place < 3)
SELECT theme_id, 'etf' AS kind, CAST(place AS INTEGER) AS place, id AS ref_id, f.name
FROM listed JOIN funds f USING (theme_id, id)
UNION ALL
SELECT theme_id, 'stock', CAST(place AS INTEGER), id, s.name FROM listed JOIN stocks s USING (id)""",
)
def theme_representatives(spark: SparkSession, folder: str) -> DataFrame:
    funds = tables.funds(spark, folder)
    largest = top_per_key(funds, "theme_id", [F.col("net_assets").desc(), F.col("id").asc()], 3, "place")
    # Three entries per theme.
    ordered = F.sort_array(F.collect_list(F.struct("place", "id")))
    ids = F.transform(ordered, lambda x: x["id"])
    themes = largest.groupBy(F.col("theme_id").alias("id")).agg(
        ids.alias("representative_etf_ids"), ids.alias("representative_stock_ids")
    )
    return screen.representatives(themes, funds, tables.stocks(spark, folder))
