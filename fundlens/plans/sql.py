"""SQL fragments shared by the reference queries (DuckDB dialect)."""

from __future__ import annotations

from ..sources.tables import FIRST_WORDS, SECOND_WORDS


def code(x: str) -> str:
    text = f"CAST({x} AS VARCHAR)"
    return f"(CASE WHEN length({text}) < 6 THEN lpad({text}, 6, '0') ELSE {text} END)"


def pct(current: str, base: str) -> str:
    return f"(floor(({current} - {base}) / nullif({base}, 0) * 10000.0 + 0.5) / 100.0)"


def half_up(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"floor({x} + 0.5)"
    scale = f"{10**digits}.0"
    return f"(floor({x} * {scale} + 0.5) / {scale})"


def exact_sum(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,{scale}))) AS DOUBLE)"


def exact_mean(x: str, scale: int = 4) -> str:
    return f"({exact_sum(x, scale)} / nullif(count({x}), 0))"


def case(x: str, values: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in values.items())
    return f"(CASE {whens} ELSE {default} END)"


def given(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def product_name(x: str) -> str:
    first = case(f"split_part({x}, ' ', 1)", FIRST_WORDS)
    second = case(f"split_part({x}, ' ', 2)", SECOND_WORDS)
    return f"({first} || ' ' || {second})"


TICKS = f"""ticks AS (
  SELECT {code('user_id')} AS code, ts, event_id AS tick_id, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume
  FROM events)"""

BARS = """bars AS (
  SELECT code, date_trunc('day', ts) AS ts,
         first(price ORDER BY ts, tick_id) AS o, max(price) AS h, min(price) AS l,
         last(price ORDER BY ts, tick_id) AS c, CAST(sum(volume) AS BIGINT) AS v, count(*) AS ticks
  FROM ticks GROUP BY ALL)"""

QUOTES = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) - 1 AS i,
         count(*) OVER (PARTITION BY code) AS n FROM bars),
closes AS (
  SELECT code,
         max(CASE WHEN i = 0 THEN c END) AS c0,
         max(CASE WHEN i = least(1, n - 1) THEN c END) AS c1,
         max(CASE WHEN i = least(5, n - 1) THEN c END) AS c5,
         max(CASE WHEN i = least(20, n - 1) THEN c END) AS c20,
         max(CASE WHEN i = 0 THEN c * v / 1.0 END) AS tv0,
         max(CASE WHEN i = 1 THEN c * v / 1.0 END) AS tv1
  FROM numbered GROUP BY code),
quotes AS (
  SELECT code, c0 AS price, c0 - c1 AS change, {pct('c0', 'c1')} AS change_rate,
         {pct('c0', 'c5')} AS return_1w, {pct('c0', 'c20')} AS return_1m,
         {half_up('tv0')} AS trading_value, {pct('tv0', 'tv1')} AS trading_value_change_rate
  FROM closes),
spreads AS (
  SELECT code, {pct('h', 'l')} AS volatility_score FROM numbered WHERE i = 0)"""

FUNDS = f"""funds AS (
  SELECT c_custkey AS ord, {code('c_custkey')} AS id, {code('c_custkey')} AS code, c_name AS name,
         n_name AS issuer, c_mktsegment AS theme_id, c_acctbal AS net_assets
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

QUOTED = """quoted AS (
  SELECT f.*, q.price AS current_price, q.change_rate AS change_rate_1d, q.return_1w, q.return_1m,
         q.trading_value, q.trading_value_change_rate, s.volatility_score
  FROM funds f LEFT JOIN quotes q USING (code) LEFT JOIN spreads s USING (code))"""

MARKET = (TICKS, BARS, QUOTES, FUNDS, QUOTED)

ROLLED = f"""base_themes AS (
  SELECT theme_id AS id, theme_id AS name, min(ord) AS ord, {exact_sum('net_assets')} AS trading_value
  FROM funds GROUP BY theme_id),
member_figures AS (
  SELECT theme_id,
         {half_up(exact_mean('change_rate_1d'), 2)} AS r1d,
         {half_up(exact_mean('return_1w'), 2)} AS r1w,
         {half_up(exact_mean('return_1m'), 2)} AS r1m,
         {half_up(exact_mean('trading_value_change_rate'), 2)} AS tvc,
         {half_up(exact_sum('trading_value'))} AS tv
  FROM quoted GROUP BY theme_id),
themes AS (
  SELECT b.ord, b.id, b.name, coalesce(r1d, 0.0) AS return_1d, coalesce(r1w, 0.0) AS return_1w,
         coalesce(r1m, 0.0) AS return_1m, coalesce(tv, b.trading_value) AS trading_value,
         coalesce(tvc, 0.0) AS trading_value_change_rate
  FROM base_themes b LEFT JOIN member_figures m ON b.id = m.theme_id)"""

SNAPSHOT = f"""order_totals AS (
  SELECT o_custkey, {exact_sum('o_totalprice')} AS total, max(o_totalprice) AS high,
         min(o_totalprice) AS low FROM orders GROUP BY o_custkey),
snapshot AS (
  SELECT {code('c_custkey')} AS code, c_name AS name, c_acctbal AS prev_close,
         {pct('high', 'low')} AS change_rate, {half_up('total / 1000.0')} AS trading_value,
         c_acctbal * 2.0 AS net_assets, low AS nav, total AS market_cap, c_mktsegment AS index_name
  FROM customer LEFT JOIN order_totals ON c_custkey = o_custkey)"""

UNIVERSE = f"""universe AS (
  SELECT f.id, f.code, f.name, f.theme_id, CAST(NULL AS DOUBLE) AS current_price,
         CAST(NULL AS DOUBLE) AS change_rate_1d, CAST(NULL AS DOUBLE) AS trading_value,
         coalesce(s.net_assets, f.net_assets) AS net_assets, s.nav, s.market_cap, s.index_name,
         s.prev_close, TRUE AS is_curated
  FROM funds f LEFT JOIN snapshot s USING (code)
  WHERE f.ord IN (SELECT user_id FROM events)
  UNION ALL
  SELECT 'etf-' || code, code, name, NULL, prev_close, change_rate, trading_value, net_assets, nav,
         market_cap, index_name, prev_close, FALSE
  FROM snapshot WHERE code NOT IN (SELECT {code('user_id')} FROM events))"""

LAST_ORDERS = f"""last_orders AS (
  SELECT {code('o_custkey')} AS code, o_totalprice AS price FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""

HOLDINGS = f"""amounts AS (
  SELECT {code('o_custkey')} AS etf_id, {code('l_partkey')} AS stock_id,
         sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
holdings AS (
  SELECT etf_id, stock_id,
         {half_up("CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY etf_id) AS DOUBLE) * 100", 2)}
           AS weight
  FROM amounts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY etf_id ORDER BY weight DESC, stock_id) AS rank FROM holdings)"""

STOCKS = f"""stocks AS (
  SELECT p_partkey AS ord, {code('p_partkey')} AS id, p_name AS name, p_type AS sector FROM part)"""

RECORDS = f"""records AS (
  SELECT p_partkey AS ord, {code('p_partkey')} AS etf_code, {product_name('p_name')} AS name,
         CASE WHEN p_size >= 40 THEN 'S&P 500 ' || p_type
              WHEN p_size <= 10 THEN 'NASDAQ100 ' || p_brand END AS benchmark_name,
         CASE p_type WHEN 'PROMO' THEN '매 1,2,3,4월 말일' WHEN 'ECONOMY' THEN '매월 15일' END AS schedule
  FROM part)"""
