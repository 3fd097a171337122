"""Queries of sources, sinks and single operators that no larger query reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import to_eok
from ..functions.names import market_size
from ..operators import bars as bar_ops
from ..operators import holdings as holding_ops
from ..operators import quality, screen, tagging
from ..operators.ordering import spread
from ..sources import readers, sinks, tables
from ..storage import materialize, new_path
from . import sql as q
from .registry import catalog


@catalog.query("won_units", "SELECT c_custkey AS id, floor(c_acctbal * 1000000.0 / 100000000.0 + 0.5) AS eok FROM customer")
def won_units(spark: SparkSession, folder: str) -> DataFrame:
    won = (F.col("c_acctbal") * 1000000.0).cast("string")
    return tables.read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), to_eok(won).alias("eok"))


@catalog.query("size_order", q.given(q.SNAPSHOT) + "SELECT code, coalesce(market_cap, net_assets) AS sort_value FROM snapshot")
def size_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.snapshot(spark, folder)
    return rows.select("code", market_size("market_cap", "net_assets").alias("sort_value"))


_SORTS = {"market_cap": "net_assets", "change_rate_1d": "change_rate_1d", "current_price": "current_price"}


@catalog.query(
    "explore_sorts",
    q.given(*q.MARKET)
    + "\nUNION ALL ".join(
        f"""SELECT * FROM (SELECT '{sort}' AS sort, row_number() OVER (ORDER BY {column} DESC NULLS LAST, ord) AS position,
  code, {column} AS sort_value FROM quoted) WHERE position <= 5"""
        for sort, column in _SORTS.items()
    ),
)
def explore_sorts(spark: SparkSession, folder: str) -> DataFrame:
    """First page of the explorer list in the other sort orders; the page is the feature."""
    quoted = tables.quoted_funds(spark, folder)
    pages = [screen.explore(quoted, sort=s).withColumn("sort", F.lit(s)) for s in _SORTS]
    rows = reduce(DataFrame.unionByName, [p.select("sort", "position", "code", "sort_value") for p in pages])
    return rows.withColumn("position", F.col("position").cast("bigint"))


_TRAILING = ("1W", "3M", "1Y", "3Y")


@catalog.query(
    "trailing_returns",
    q.given(
        q.TICKS, q.BARS,
        "backed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back FROM bars)",
        *[
            f"""ends_{p.lower()} AS (SELECT '{p}' AS period, code, count(*) AS bars, last(c ORDER BY back) AS first_close,
  first(c ORDER BY back) AS last_close FROM backed WHERE back <= {bar_ops.PERIODS[p][1]} GROUP BY code)"""
            for p in _TRAILING
        ],
    )
    + "\nUNION ALL ".join(
        f"""SELECT code, period, bars, first_close, last_close,
  CASE WHEN bars >= 2 THEN {q.pct('last_close', 'first_close')} END AS period_return FROM ends_{p.lower()}"""
        for p in _TRAILING
    ),
)
def trailing_returns(spark: SparkSession, folder: str) -> DataFrame:
    daily = tables.daily_bars(spark, folder)
    return reduce(DataFrame.unionByName, [bar_ops.period_return(daily, p) for p in _TRAILING])


@catalog.query(
    "edge_keys",
    q.given(q.HOLDINGS)
    + """SELECT 'pair' AS audited, count(*) AS repeated FROM (SELECT 1 FROM holdings GROUP BY etf_id, stock_id HAVING count(*) > 1)
UNION ALL SELECT 'rank', count(*) FROM (SELECT 1 FROM ranked GROUP BY etf_id, rank HAVING count(*) > 1)
UNION ALL SELECT 'line', count(*) FROM (
  SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_linenumber HAVING count(*) > 1)""",
)
def edge_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated (fund, stock) pairs and ranks in a fund; the last audit has many."""
    edges = materialize(tables.holdings(spark, folder), "edges")  # two audits read them
    placed = holding_ops.holding_ids(edges, [F.col("weight").desc(), F.col("stock_id").asc()])
    orders = tables.read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = tables.read(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    audits = [("pair", edges, ["etf_id", "stock_id"]), ("rank", placed, ["etf_id", "place"]), ("line", lines, ["o_custkey", "l_linenumber"])]
    found = [quality.duplicates(df, keys).agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(name).alias("audited"), "repeated") for name, df, keys in audits]
    return reduce(DataFrame.unionByName, found)


@catalog.query(
    "record_subset",
    q.given(q.RECORDS)
    + f"""SELECT etf_code, name FROM records
WHERE etf_code IN (SELECT {q.code('ps')} FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_returnflag = 'R'))""",
)
def record_subset(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.read(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    codes = lines.select(tables.code_of("l_partkey").alias("etf_code"))
    return tagging.subset(tables.fund_records(spark, folder), codes).select("etf_code", "name")


_LINES = f"""lines AS (
  SELECT {q.code('o_custkey')} AS etf_code, c_name AS etf_name, l_linenumber AS rank, {q.code('l_partkey')} AS holding_code,
         p_name || ', "' || p_type || '"' AS holding_name, l_quantity AS quantity, l_discount AS weight, l_linestatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey)"""
_CSV = {
    "etf_code": "etfCode", "etf_name": "etfName", "rank": "rank", "holding_code": "holdingCode",
    "holding_name": "holdingName", "quantity": "quantity", "weight": "weightPct", "status": "status",
}


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = tables.read(spark, folder, "customer").select("c_custkey", "c_name")
    part = tables.read(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    lines = tables.read(spark, folder, "lineitem")
    # The names of funds go to their orders, which are fewer than lines.
    n = orders.count()
    named = spread(orders, n, "o_custkey").join(spread(customer, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = lines.count()
    joined = spread(lines, n, "l_orderkey").join(spread(named, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = spread(joined, n, "l_partkey").join(spread(part, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        tables.code_of("o_custkey").alias("etf_code"), F.col("c_name").alias("etf_name"), F.col("l_linenumber").alias("rank"),
        tables.code_of("l_partkey").alias("holding_code"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("holding_name"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("weight"), F.col("l_linestatus").alias("status"),
    )


@catalog.query(
    "csv_round_trip",
    q.given(_LINES) + "SELECT etf_code, etf_name, CAST(rank AS INTEGER) AS rank, holding_code, holding_name, CAST(quantity AS DOUBLE) AS quantity, CAST(weight AS DOUBLE) AS weight, status FROM lines",
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings written as a report with quoted texts and read back."""
    path = new_path(spark, "report")
    sinks.write_csv_report(_lines(spark, folder).withColumnsRenamed(_CSV), path)
    return readers.read_holdings_csv(spark, path)


@catalog.query("jsonl_round_trip", q.given(_LINES) + "SELECT etf_code, holding_name, CAST(quantity AS DOUBLE) AS quantity FROM lines")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "lines")
    sinks.write_jsonl(_lines(spark, folder).select("etf_code", "holding_name", "quantity"), path)
    return readers.read_jsonl(spark, path, "etf_code string, holding_name string, quantity double")


@catalog.query(
    "document_round_trip",
    q.given(q.HOLDINGS) + "SELECT etf_id, rank - 1 AS pos, stock_id, weight FROM ranked WHERE rank <= 5",
)
def document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested documents of five holdings each, written and read back; five is the feature."""
    path = new_path(spark, "documents")
    ranked = holding_ops.top_holdings(tables.holdings(spark, folder), 5).select("etf_id", "rank", "stock_id", "weight")
    sinks.write_holdings_documents(ranked, path, 5, "etf_id")
    schema = "etf_id string, holdings array<struct<rank: int, stock_id: string, weight: double>>"
    nested = readers.read_jsonl(spark, path, schema)
    unfolded = nested.select("etf_id", F.posexplode("holdings").alias("pos", "h"))
    return unfolded.select("etf_id", F.col("pos").cast("bigint").alias("pos"), "h.stock_id", "h.weight")


@catalog.query(
    "breadth_audit",
    q.given(*q.MARKET)
    + """, counted AS (
  SELECT theme_id, count(*) FILTER (WHERE change_rate_1d > 0) AS advancers, count(*) FILTER (WHERE change_rate_1d < 0) AS decliners,
         count(*) FILTER (WHERE change_rate_1d = 0) AS unchanged, count(*) AS funds FROM quoted GROUP BY theme_id)
SELECT theme_id, advancers, decliners, unchanged FROM counted WHERE advancers + decliners + unchanged <> funds""",
)
def breadth_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Themes whose counts leave funds out, as those do that forget missing rates."""
    rate = F.col("change_rate_1d")
    summary = tables.quoted_funds(spark, folder).groupBy("theme_id").agg(
        F.count_if(rate > 0).alias("advancers"), F.count_if(rate < 0).alias("decliners"),
        F.count_if(rate == 0).alias("unchanged"), F.count(F.lit(1)).alias("funds"),
    )
    found = quality.breadth_violations(summary, F.col("funds"))
    return found.select("theme_id", "advancers", "decliners", "unchanged")
