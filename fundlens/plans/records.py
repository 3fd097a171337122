"""Queries over integrated metadata, coverage and cleaning rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, display, names
from ..operators import metadata as meta
from ..operators import quality, resolve
from ..operators import universe as universe_ops
from ..sources import readers, sinks, tables
from ..storage import new_path
from . import sql as q
from .registry import catalog

_DETAILS = f"""facts AS (
  SELECT {q.code('user_id')} AS etf_code, first(event_type ORDER BY ts, event_id) AS first_type,
         last(event_type ORDER BY ts, event_id) AS last_type, strftime(min(ts), '%Y-%m-%d') AS listing_date,
         CAST(max(ts) AS DATE) AS as_of, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         count(*) AS n, {q.half_up(q.exact_mean('value'), 2)} AS mean_value
  FROM events GROUP BY user_id),
details AS (
  SELECT etf_code, CASE WHEN n > 60 THEN 'Fund ' || etf_code END AS name,
         CASE WHEN first_type <> 'error' THEN first_type END AS issuer, listing_date,
         CASE WHEN last_type <> 'error' THEN last_type END AS benchmark_name,
         CASE WHEN first_type <> 'view' THEN mean_value END AS total_fee_pct,
         CASE WHEN purchases > 12 THEN '매월 15일' END AS distribution_text,
         CASE WHEN last_type = 'view' THEN '국내주식형' END AS type_text, as_of
  FROM facts)"""
_MASTER = f"""master AS (
  SELECT {q.code('c_custkey')} AS etf_code,
         CASE WHEN regexp_full_match({q.code('c_custkey')}, '[0-9]{{6}}') THEN 'krx_numeric'
              ELSE 'naver_internal_unresolved' END AS code_type,
         c_name || {q.case('c_mktsegment', tables.NAME_SUFFIXES, "''")} AS name
  FROM customer),
counts AS (
  SELECT {q.code('o_custkey')} AS etf_code, count(*) AS holdings_count FROM orders GROUP BY o_custkey)"""
_JOINED = """records AS (
  SELECT m.etf_code, m.code_type, coalesce(d.name, m.name) AS name, d.issuer, d.listing_date,
         d.benchmark_name, d.total_fee_pct, d.distribution_text, d.type_text,
         coalesce(c.holdings_count, 0) AS holdings_count,
         CASE WHEN contains(m.name, '액티브') THEN 'active ' ELSE '' END
           || CASE WHEN contains(m.name, '(H)') THEN 'hedged' ELSE '' END AS flags,
         array_to_string(list_filter([
           CASE WHEN contains(m.name, '액티브') THEN 'name_contains=액티브' END,
           CASE WHEN contains(m.name, '커버드콜') THEN 'name_contains=커버드콜' END,
           CASE WHEN contains(m.name, '(H)') THEN 'name_contains=(H) 환헤지 표기' END,
           CASE WHEN contains(m.name, '합성') THEN 'name_contains=합성(스왑) 구조' END],
           lambda x: x IS NOT NULL), ',') AS hints,
         contains(m.name, '커버드콜') AS covered_call,
         CASE WHEN d.distribution_text IS NOT NULL THEN
           CASE WHEN contains(d.distribution_text, '매월') THEN 'yes' ELSE 'no' END END AS monthly,
         CASE WHEN d.etf_code IS NOT NULL THEN 'success' ELSE 'not_collected' END AS collection_status
  FROM master m LEFT JOIN details d USING (etf_code) LEFT JOIN counts c USING (etf_code)
  WHERE d.etf_code IS NOT NULL OR c.holdings_count > 0)"""
_GROUPS = {
    "etf_code": "TRUE",
    "name": "name <> ''",
    "issuer": "issuer IS NOT NULL",
    "benchmark_name": "benchmark_name IS NOT NULL",
    "descriptions": "FALSE",
    "holdings": "holdings_count > 0",
    "strategy_facts": "type_text IS NOT NULL OR hints <> ''",
    "distribution": "distribution_text IS NOT NULL",
    "sector_country_weights": "FALSE",
    "fees_and_assets": "total_fee_pct IS NOT NULL",
}
_SCORE = " + ".join(
    ["CAST(0.0 AS DOUBLE)"]
    + [f"CASE WHEN {_GROUPS[g]} THEN CAST({w} AS DOUBLE) ELSE 0.0 END" for g, w in meta.FIELD_WEIGHTS.items()]
)
_COVERED = f"""covered AS (
  SELECT etf_code, name, {q.half_up('(' + _SCORE + ')', 3)} AS coverage_score,
    list_filter([{', '.join(f"CASE WHEN NOT ({c}) THEN '{g}' END" for g, c in _GROUPS.items())}],
      lambda x: x IS NOT NULL) AS missing_fields
  FROM records)"""
RECORDS = (_DETAILS, _MASTER, _JOINED)


def integrated(spark: SparkSession, folder: str) -> DataFrame:
    return meta.integrate(
        tables.fund_master(spark, folder),
        tables.details(spark, folder),
        tables.holding_counts(spark, folder),
    )


@catalog.query(
    "metadata_join",
    q.given(*RECORDS)
    + """SELECT etf_code, code_type, name, issuer, listing_date, benchmark_name, total_fee_pct, holdings_count,
  flags, hints, covered_call, monthly, collection_status FROM records""",
)
def metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    flags = F.concat(
        F.when(F.col("active"), "active ").otherwise(""),
        F.when(F.col("currency_hedged"), "hedged").otherwise(""),
    )
    return integrated(spark, folder).select(
        "etf_code", "code_type", "name", "issuer", "listing_date", "benchmark_name", "total_fee_pct",
        "holdings_count", flags.alias("flags"), F.array_join("name_hints", ",").alias("hints"),
        "covered_call", F.when(F.col("monthly"), "yes").when(~F.col("monthly"), "no").alias("monthly"),
        "collection_status",
    )


@catalog.query(
    "coverage_score",
    q.given(*RECORDS, _COVERED)
    + "SELECT etf_code, coverage_score, array_to_string(missing_fields, ',') AS missing_fields FROM covered",
)
def coverage_score(spark: SparkSession, folder: str) -> DataFrame:
    return meta.coverage(integrated(spark, folder)).select(
        "etf_code", "coverage_score", F.array_join("missing_fields", ",").alias("missing_fields")
    )


@catalog.query(
    "coverage_buckets",
    q.given(*RECORDS, _COVERED)
    + """SELECT count(*) FILTER (WHERE coverage_score >= 0.75) AS high,
  count(*) FILTER (WHERE coverage_score >= 0.45 AND coverage_score < 0.75) AS low,
  count(*) FILTER (WHERE coverage_score < 0.45) AS needs_more, count(*) AS records FROM covered""",
)
def coverage_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return meta.coverage_buckets(meta.coverage(integrated(spark, folder)))


@catalog.query(
    "field_coverage",
    q.given(*RECORDS)
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS field, count(*) FILTER (WHERE {c}) AS filled,
  floor(count(*) FILTER (WHERE {c}) / count(*) * 1000 + 0.5) / 10.0 AS coverage_pct FROM records"""
        for g, c in _GROUPS.items()
    ),
)
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return meta.field_coverage(meta.coverage(integrated(spark, folder)))


@catalog.query(
    "missing_fields",
    q.given(*RECORDS, _COVERED)
    + "SELECT etf_code, name, unnest(missing_fields) AS missing_field, coverage_score FROM covered",
)
def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    return meta.missing(meta.coverage(integrated(spark, folder)))


@catalog.query(
    "web_extract",
    q.given(*RECORDS)
    + """SELECT count(*) AS funds, count(issuer) AS issuer, count(listing_date) AS listing_date,
  count(total_fee_pct) AS total_fee_pct, CAST(0 AS BIGINT) AS beta,
  count(distribution_text) AS distribution_schedule, CAST(0 AS BIGINT) AS return_12m
FROM records WHERE coalesce(issuer, listing_date, distribution_text, CAST(total_fee_pct AS VARCHAR)) IS NOT NULL""",
)
def web_extract(spark: SparkSession, folder: str) -> DataFrame:
    return meta.field_counts(meta.web_extract(integrated(spark, folder)))


_VALUES = """given_values AS (
  SELECT etf_code, 'name' AS field, name AS value, 'master' AS source_id, 50 AS priority, 0.75 AS confidence FROM master
  UNION ALL SELECT etf_code, 'name', name, 'detail', 100, 0.85 FROM details
  UNION ALL SELECT etf_code, 'issuer', issuer, 'detail', 100, 0.85 FROM details
  UNION ALL SELECT etf_code, 'benchmark_name', benchmark_name, 'detail', 100, 0.85 FROM details
  UNION ALL SELECT etf_code, 'holdings', CAST(holdings_count AS VARCHAR), 'listing_file', 80, 0.7 FROM counts)"""


@catalog.query(
    "field_priority",
    q.given(_DETAILS, _MASTER, _VALUES)
    + """SELECT etf_code, field, value, source_id, priority, CAST(confidence AS DOUBLE) AS confidence
FROM given_values WHERE coalesce(value, '') <> ''
QUALIFY row_number() OVER (PARTITION BY etf_code, field ORDER BY priority DESC, source_id) = 1""",
)
def field_priority(spark: SparkSession, folder: str) -> DataFrame:
    master = meta.source_values(tables.fund_master(spark, folder), "master", {"name": "name"})
    fields = {c: c for c in ("name", "issuer", "benchmark_name")}
    detail = meta.source_values(tables.details(spark, folder), "detail", fields, F.col("as_of"))
    listing = meta.source_values(
        tables.holding_counts(spark, folder), "listing_file", {"holdings": "holdings_count"}
    )
    picked = resolve.pick_by_priority(master.unionByName(detail).unionByName(listing))
    return picked.select("etf_code", "field", "value", "source_id", "priority", "confidence")


_MORE = f"""more AS (
  SELECT d.*, CASE WHEN n > 55 THEN n * 100 END AS net_assets, CASE WHEN d.issuer = 'click' THEN 'LP ' || d.etf_code END AS liquidity_provider_text,
         CASE WHEN n > 50 THEN n END AS holdings, seen
  FROM details d JOIN (SELECT {q.code('user_id')} AS etf_code, count(*) AS n, CAST(max(ts) AS DATE) AS seen FROM events GROUP BY user_id) USING (etf_code)),
listed AS (
  SELECT {q.code('o_custkey')} AS etf_code, count(*) AS holdings, CAST(max(o_orderdate) AS DATE) AS seen FROM orders GROUP BY o_custkey)"""
_ALL_VALUES = "all_values AS (\n  SELECT etf_code, 'name' AS field, name AS value, 'master' AS source_id, CAST(NULL AS DATE) AS as_of, 50 AS priority FROM master\n" + "".join(
    f"  UNION ALL SELECT etf_code, '{f}', CAST({f} AS VARCHAR), 'detail', {'seen' if f in meta.DATED_FIELDS else 'NULL'}, 100 FROM more\n"
    for f in meta.PROVENANCE_FIELDS
) + "  UNION ALL SELECT etf_code, 'holdings', CAST(holdings AS VARCHAR), 'listing_file', seen, 80 FROM listed)"
_PICKED = """picked AS (
  SELECT *, source_id <> first_value(source_id) OVER (PARTITION BY etf_code, field ORDER BY priority DESC, source_id) AS overridden
  FROM all_values WHERE coalesce(value, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY etf_code, field
    ORDER BY CASE WHEN field = 'holdings' THEN as_of END DESC NULLS LAST, priority DESC, source_id) = 1)"""
_WIDE = ", ".join(
    f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(source_id) FILTER (WHERE field = '{f}') AS {f}_source"
    for f in meta.PROVENANCE_FIELDS
)


@catalog.query(
    "provenance_record",
    q.given(_DETAILS, _MASTER, _MORE, _ALL_VALUES, _PICKED)
    + f"""SELECT etf_code, {_WIDE},
  strftime(max(as_of) FILTER (WHERE field = 'net_assets'), '%Y-%m-%d') AS net_assets_as_of,
  strftime(max(as_of) FILTER (WHERE field = 'holdings'), '%Y-%m-%d') AS holdings_as_of,
  bool_or(overridden) FILTER (WHERE field = 'holdings') AS holdings_overridden
FROM picked GROUP BY etf_code""",
)
def provenance_record(spark: SparkSession, folder: str) -> DataFrame:
    """All ten fields of each fund with their sources; the newer holdings go before the better source."""
    fields = meta.PROVENANCE_FIELDS
    counts = tables.read(spark, folder, "events").groupBy(tables.code_of("user_id").alias("etf_code")).agg(F.count(F.lit(1)).alias("n"))
    detail = tables.details(spark, folder).join(counts, "etf_code").withColumns(
        {
            "net_assets": F.when(F.col("n") > 55, F.col("n") * 100),
            "liquidity_provider_text": F.when(F.col("issuer") == "click", F.concat(F.lit("LP "), F.col("etf_code"))),
            "holdings": F.when(F.col("n") > 50, F.col("n")),
        }
    )
    listed = tables.read(spark, folder, "orders").groupBy(tables.code_of("o_custkey").alias("etf_code")).agg(
        F.count(F.lit(1)).alias("holdings"), F.max("o_orderdate").cast("date").alias("as_of")
    )
    dated = {f: f for f in meta.DATED_FIELDS}
    values = [
        meta.source_values(tables.fund_master(spark, folder), "master", {"name": "name"}),
        meta.source_values(detail, "detail", {f: f for f in fields if f not in dated}),
        meta.source_values(detail, "detail", dated, F.col("as_of")),
        meta.source_values(listed, "listing_file", {"holdings": "holdings"}, F.col("as_of")),
    ]
    wide = resolve.provenance_record(reduce(DataFrame.unionByName, values), fields, recency=("holdings",))
    flat = [c for f in fields for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.source_id").alias(f"{f}_source"))]
    return wide.select(
        "etf_code", *flat,
        *[F.date_format(f"{f}.as_of", "yyyy-MM-dd").alias(f"{f}_as_of") for f in meta.DATED_FIELDS],
        F.col("holdings.overridden").alias("holdings_overridden"),
    )


@catalog.query(
    "holdings_lookup",
    f"""WITH holders AS (
  SELECT c_custkey AS ord, {q.code('c_custkey')} AS code, c_name AS name FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders)),
by_name AS (SELECT lower(name) AS k, first(code ORDER BY ord) AS code FROM holders GROUP BY k)
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, coalesce(h.code, n.code) AS holdings_code,
       CASE WHEN h.code IS NOT NULL THEN 'code' WHEN n.code IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by
FROM orders LEFT JOIN holders h ON h.code = {q.code('o_orderkey')}
LEFT JOIN by_name n ON n.k = 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')""",
)
def holdings_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys as requested codes, with a differently spaced fund name as second key."""
    orders = tables.read(spark, folder, "orders")
    customer = tables.read(spark, folder, "customer")
    holders = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        F.col("c_custkey").alias("ord"), tables.code_of("c_custkey").alias("code"),
        F.col("c_name").alias("name"),
    )
    name = F.concat(F.lit("CUSTOMER #"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    requests = orders.select(F.col("o_orderkey").cast("string").alias("request_id"), name.alias("name"))
    return universe_ops.lookup_holdings(requests, holders).drop("name")


_NUMBER = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _parsed(raw: str) -> str:
    bare = f"regexp_replace({raw}, '[,\\s\\x{{00a0}}%₩]', '', 'g')"
    return f"CASE WHEN regexp_full_match({bare}, {_NUMBER}) THEN TRY_CAST({bare} AS DOUBLE) END"


_RAW_VALUES = """raws AS (
  SELECT p_partkey, '₩ ' || p_retailprice || ' %' AS price,
    CASE WHEN p_size > 45 THEN ' - ' WHEN p_size > 40 THEN 'N/A' WHEN p_size > 35 THEN 'null'
         WHEN p_size > 30 THEN '1d' WHEN p_size > 25 THEN 'NaN' WHEN p_size > 20 THEN '0x10'
         WHEN p_size > 15 THEN '.5e1' WHEN p_size > 10 THEN '' ELSE '-1,0' || p_size || '.5' END AS odd,
    '  ' || p_name || chr(160) || ' ' || chr(10) || p_brand || ' ' AS label,
    p_retailprice - 1000 AS delta FROM part)"""


@catalog.query(
    "clean_values",
    q.given(_RAW_VALUES)
    + f"""SELECT p_partkey, {_parsed('price')} AS price, {_parsed('odd')} AS odd,
  CASE WHEN trim(odd) NOT IN ('', '-', 'N/A', 'null') THEN odd END AS kept,
  {_parsed('odd')} * 100 AS odd_pct,
  trim(regexp_replace(label, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS label,
  CAST(sign(delta) AS INTEGER) AS direction,
  greatest(0.0, least(1.0, delta / 500.0)) AS share FROM raws""",
)
def clean_values(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    odd = (
        F.when(size > 45, " - ").when(size > 40, "N/A").when(size > 35, "null").when(size > 30, "1d")
        .when(size > 25, "NaN").when(size > 20, "0x10").when(size > 15, ".5e1").when(size > 10, "")
        .otherwise(F.concat(F.lit("-1,0"), size.cast("string"), F.lit(".5")))
    )
    raws = tables.read(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("₩ "), F.col("p_retailprice").cast("string"), F.lit(" %")).alias("price"),
        odd.alias("odd"),
        F.concat(F.lit("  "), "p_name", F.lit("  \n"), "p_brand", F.lit(" ")).alias("label"),
        (F.col("p_retailprice") - 1000).alias("delta"),
    )
    return raws.select(
        "p_partkey",
        clean.parse_number("price").alias("price"),
        clean.parse_number("odd").alias("odd"),
        clean.nullify("odd").alias("kept"),
        clean.to_percent("odd", from_ratio=True).alias("odd_pct"),
        clean.clean_text("label").alias("label"),
        clean.sign_of("delta").alias("direction"),
        clean.clamp01(F.col("delta") / 500.0).alias("share"),
    )


@catalog.query(
    "code_normalize",
    """SELECT p_partkey,
  CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) BETWEEN 1 AND 6
       THEN lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 6, '0') END AS brand_code,
  upper(p_brand) AS brand_etf_code,
  CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END
    AS etf_code,
  CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'A' || p_partkey END AS asset_code,
  p_brand AS kept_code,
  CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END
    AS lookup_code,
  'krx_numeric' AS code_type,
  lower(regexp_replace(p_name, '\\s', '', 'g')) AS name_key FROM part""",
)
def code_normalize(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return tables.read(spark, folder, "part").select(
        "p_partkey",
        clean.normalize_code("p_brand").alias("brand_code"),
        clean.normalize_etf_code(F.concat(F.lit(" "), F.lower("p_brand"))).alias("brand_etf_code"),
        clean.normalize_etf_code(F.concat(key, F.lit(" "))).alias("etf_code"),
        clean.normalize_asset_code(F.concat(F.lit("A"), key)).alias("asset_code"),
        clean.normalize_asset_code(F.concat(F.lit(" "), "p_brand")).alias("kept_code"),
        clean.lookup_code(F.concat(F.lit("ETF-"), key)).alias("lookup_code"),
        names.code_type(tables.code_of("p_partkey")).alias("code_type"),
        clean.name_key("p_name").alias("name_key"),
    )


@catalog.query(
    "seoul_times",
    """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS instant,
  strftime(ts, '%Y-%m-%d') || 'T00:00:00+09:00' AS compact_day,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS epoch,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events""",
)
def seoul_times(spark: SparkSession, folder: str) -> DataFrame:
    stamped = tables.read(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        F.date_format("ts", "yyyyMMdd").alias("compact"),
    ).withColumn("ms", F.unix_millis(F.try_to_timestamp("iso")))
    return stamped.select(
        "event_id",
        clean.to_seoul_iso("iso").alias("instant"),
        clean.to_seoul_iso("compact").alias("compact_day"),
        clean.epoch_ms_to_seoul_iso("ms").alias("epoch"),
        clean.to_date_only("iso").cast("string").alias("day"),
    )


_HINTS = ", ".join(
    [
        "CASE WHEN regexp_extract(name, '(?i)([0-9](?:\\.[0-9])?)\\s*X', 1) <> '' THEN 'leverage=' || "
        "regexp_extract(name, '(?i)([0-9](?:\\.[0-9])?)\\s*X', 1) || 'X(명칭 표기)' END"
    ]
    + [f"CASE WHEN regexp_matches(name, '{pattern}') THEN '{hint}' END" for pattern, hint in names.NAME_HINTS]
)


@catalog.query(
    "name_hints",
    q.given(q.RECORDS)
    + f"""SELECT etf_code, array_to_string(list_filter([{_HINTS}], lambda x: x IS NOT NULL), ',') AS hints
FROM records""",
)
def name_hints(spark: SparkSession, folder: str) -> DataFrame:
    return tables.fund_records(spark, folder).select(
        "etf_code", F.array_join(names.name_hints("name"), ",").alias("hints")
    )


_BRANDS = {k: v for k, v in names.ISSUER_BY_BRAND.items() if len(k) <= 6}


@catalog.query(
    "classify_names",
    q.given(q.RECORDS)
    + f"""SELECT etf_code,
  CASE WHEN contains(name, '인버스') AND regexp_matches(name, '(?i)\\b2X\\b|2배|곱버스') THEN '-2X'
       WHEN contains(name, '인버스') THEN '-1X' WHEN contains(name, '레버리지') THEN '2X' ELSE 'ETF' END AS label,
  CASE WHEN contains(name, '인버스') THEN 'inv' WHEN contains(name, '레버리지') THEN 'lev' ELSE '' END AS class,
  CASE WHEN regexp_matches(name, '{"|".join(names.OVERSEAS_WORDS)}') THEN 'overseas' ELSE 'domestic' END AS region,
  substr(split_part(name, ' ', 1), 1, 6) AS brand,
  {q.case("substr(split_part(name, ' ', 1), 1, 6)", _BRANDS)} AS issuer,
  coalesce(contains(name, '커버드콜'), FALSE) AS covered_call,
  coalesce(regexp_matches(schedule, '매월|매\\s*1,\\s*2,\\s*3'), FALSE) AS monthly FROM records""",
)
def classify_names(spark: SparkSession, folder: str) -> DataFrame:
    return tables.fund_records(spark, folder).select(
        "etf_code",
        names.leverage_label("name").alias("label"),
        names.leverage_class("name").alias("class"),
        names.region_of("name").alias("region"),
        names.brand_token("name").alias("brand"),
        names.issuer_of(F.lit(None).cast("string"), "name").alias("issuer"),
        names.is_covered_call("name").alias("covered_call"),
        F.coalesce(names.pays_monthly("distribution_schedule_text"), F.lit(False)).alias("monthly"),
    )


@catalog.query(
    "display_text",
    f"""WITH raws AS (
  SELECT c_custkey, {q.half_up('c_acctbal / 1000.0', 2)} AS rate, floor(c_acctbal * 10) AS amount,
         floor(c_acctbal) AS price FROM customer)
SELECT c_custkey,
  CASE WHEN rate > 0 THEN '+' || format('{{:.2f}}', rate) || '%'
       WHEN rate < 0 THEN '-' || format('{{:.2f}}', abs(rate)) || '%' ELSE '0.00%' END AS rate_text,
  CASE WHEN amount < 0 THEN '정보 없음' WHEN amount < 10000 THEN format('{{:,}}', CAST(amount AS BIGINT)) || '억원'
       WHEN CAST(amount AS BIGINT) % 10000 = 0 THEN (CAST(amount AS BIGINT) // 10000) || '조원'
       ELSE (CAST(amount AS BIGINT) // 10000) || '조 ' || format('{{:,}}', CAST(amount AS BIGINT) % 10000) || '억원' END
    AS amount_text,
  format('{{:,}}', CAST(price AS BIGINT)) || '원' AS price_text,
  CASE WHEN rate > 0 THEN 'up-' WHEN rate < 0 THEN 'down-' ELSE 'flat' END ||
  CASE WHEN rate = 0 THEN '' WHEN abs(rate) >= 3 THEN '3' WHEN abs(rate) >= 1.5 THEN '2' ELSE '1' END AS tone,
  floor(price * (rate / 100.0) + 0.5) AS change_amount FROM raws""",
)
def display_text(spark: SparkSession, folder: str) -> DataFrame:
    raws = tables.read(spark, folder, "customer").select(
        "c_custkey",
        clean.half_up(F.col("c_acctbal") / 1000.0, 2).alias("rate"),
        F.floor(F.col("c_acctbal") * 10).cast("double").alias("amount"),
        F.floor("c_acctbal").cast("double").alias("price"),
    )
    return raws.select(
        "c_custkey",
        display.signed_percent("rate").alias("rate_text"),
        display.krw_text("amount").alias("amount_text"),
        display.price_text("price").alias("price_text"),
        display.heat_bucket("rate").alias("tone"),
        display.change_amount("price", "rate").alias("change_amount"),
    )


PHRASES = ("that of", "of the", "de la", "copyright", "License", "password", "http://", "@")


@catalog.query(
    "phrase_scan",
    " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS phrase FROM documents WHERE contains(text, '{p}')"
        for p in quality.BANNED_PHRASES + PHRASES
    ),
)
def phrase_scan(spark: SparkSession, folder: str) -> DataFrame:
    return quality.phrase_hits(
        tables.read(spark, folder, "documents"), "doc_id", "text", quality.BANNED_PHRASES + PHRASES
    )


@catalog.query(
    "page_extract",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
  nullif(regexp_extract(html, '(?s)<html[^>]*lang="([a-z]+)"', 1), '') AS lang,
  trim(regexp_replace(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '[\\s\\x{00a0}]+', ' ', 'g'))
    AS title,
  TRY_CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) AS tracker, length(html) AS chars
FROM pages""",
)
def page_extract(spark: SparkSession, folder: str) -> DataFrame:
    return readers.page_facts(tables.read(spark, folder, "pages"))


@catalog.query(
    "page_links",
    """WITH found AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS links FROM pages)
SELECT page_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links) AS href FROM found""",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return readers.page_links(tables.read(spark, folder, "pages"))


@catalog.query(
    "incremental_targets",
    f"""SELECT {q.code('doc_id')} AS etf_code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def incremental_targets(spark: SparkSession, folder: str) -> DataFrame:
    targets = tables.read(spark, folder, "documents").select(tables.code_of("doc_id").alias("etf_code"))
    done = tables.read(spark, folder, "labels").select(tables.code_of("doc_id").alias("etf_code"))
    return sinks.pending(targets, done)


@catalog.query(
    "scoring_ledger",
    f"""SELECT {q.code('doc_id')} AS etf_code,
  'sha256:' || sha256(CAST(to_json({{'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text}}) AS VARCHAR))
    AS input_hash, '1.0.0' AS taxonomy_version, '1.0.0' AS prompt_version FROM documents""",
)
def scoring_ledger(spark: SparkSession, folder: str) -> DataFrame:
    inputs = tables.read(spark, folder, "documents").withColumn("etf_code", tables.code_of("doc_id"))
    return sinks.scoring_ledger(inputs, ["doc_id", "lang", "source", "text"], "1.0.0", "1.0.0")


@catalog.query(
    "rescoring",
    f"""SELECT {q.code('d.doc_id')} AS etf_code FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NULL OR l.quality = 0""",
)
def rescoring(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to score: never scored, or scored under another taxonomy version."""
    documents = tables.read(spark, folder, "documents").withColumn("etf_code", tables.code_of("doc_id"))
    # Hashed where it is read: joins carry keys and hashes, not texts.
    current = sinks.scoring_ledger(documents, ["doc_id", "text"], "1.0.0", "1.0.0")
    labels = tables.read(spark, folder, "labels").select(tables.code_of("doc_id").alias("etf_code"), "quality")
    ledger = current.join(labels, "etf_code").withColumn(
        "taxonomy_version", F.when(F.col("quality") == 1, "1.0.0").otherwise("0.9.0")
    )
    return sinks.to_score(current, ledger).select("etf_code")


@catalog.query(
    "rescoring_ledger",
    f"""SELECT {q.code('d.doc_id')} AS etf_code,
  CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'older version' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0""",
)
def rescoring_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs in the ledger, the second given twice: all labelled documents, then the good ones anew."""
    documents = tables.read(spark, folder, "documents").withColumn("etf_code", tables.code_of("doc_id"))
    current = sinks.scoring_ledger(documents, ["doc_id", "text"], "1.0.0", "1.0.0")
    labels = tables.read(spark, folder, "labels").select(tables.code_of("doc_id").alias("etf_code"), "quality")
    first = current.join(labels, "etf_code").withColumns({"taxonomy_version": F.lit("0.9.0"), "scored_at": F.lit(1)})
    second = current.join(labels.where("quality = 1"), "etf_code").withColumn("scored_at", F.lit(2))
    ledger = sinks.ScoringLedger(spark, new_path(spark, "scores"), buckets=8)
    for run in (first, second, second):
        ledger.record(run.drop("quality"))
    known = ledger.table()
    due = sinks.to_score(current, known).select("etf_code")
    seen = known.select("etf_code", F.lit(True).alias("seen"))
    return due.join(seen, "etf_code", "left").select("etf_code", F.when(F.col("seen"), "older version").otherwise("new").alias("reason"))


@catalog.query(
    "run_ledger",
    """WITH results AS (
  SELECT CASE WHEN l.quality = 1 THEN 'cached' WHEN l.quality = 0 THEN 'success' WHEN n_chars < 400 THEN 'empty'
              ELSE 'failed' END AS status FROM documents LEFT JOIN labels l USING (doc_id)),
totals AS (
  SELECT count(*) AS requested, count(*) FILTER (WHERE status = 'cached') AS from_cache,
         count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'empty') AS empty,
         count(*) FILTER (WHERE status = 'failed') AS failed FROM results)
SELECT 'detail' AS source, *, floor((success + from_cache) / requested * 1000 + 0.5) / 10.0 AS success_rate
FROM totals""",
)
def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    quality_of = F.col("quality")
    results = tables.read(spark, folder, "documents").join(
        tables.read(spark, folder, "labels"), "doc_id", "left"
    ).select(
        F.when(quality_of == 1, "cached").when(quality_of == 0, "success")
        .when(F.col("n_chars") < 400, "empty").otherwise("failed").alias("status")
    )
    return sinks.run_summary(results, "detail", F.lit(None).cast("timestamp")).drop("generated_at")
