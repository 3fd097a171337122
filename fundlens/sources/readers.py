"""Readers: holdings files, master lists, provider documents, page corpora, snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.clean import clean_text, first_present, normalize_etf_code, parse_number, to_eok
from ..operators.ordering import with_position

ROW_MAP = "map<string,string>"
# Keys of a provider document that may hold its rows, in order.
ROW_KEYS = ("rows", "holdings", "data")
HOLDINGS_COLUMNS = ("etfCode", "holdingName", "weightPct", "status")

# Snapshot field -> (key in the raw row, conversion).
SNAPSHOT_KEYS = {
    "code": ("srtnCd", "text"),
    "isin": ("isinCd", "text"),
    "name": ("itmsNm", "text"),
    "prev_close": ("clpr", "number"),
    "change": ("vs", "number"),
    "change_rate": ("fltRt", "number"),
    "volume": ("trqu", "number"),
    "trading_value": ("trPrc", "eok"),
    "net_assets": ("nPptTotAmt", "eok"),
    "market_cap": ("mrktTotAmt", "eok"),
    "nav": ("nav", "number"),
    "index_name": ("bssIdxIdxNm", "text"),
    "index_close": ("bssIdxClpr", "number"),
    "listing_shares": ("stLstgCnt", "number"),
    "bas_dt": ("basDt", "text"),
}

# Detail field -> (page block, key), tried in order.
DETAIL_KEYS = {
    "name": (("summary_data", "CMP_KOR"),),
    "issuer": (("product_summary_data", "ISSUE_NM_KOR"), ("summary_data", "ISSUE_NM_KOR")),
    "benchmark_name": (("product_summary_data", "BASE_IDX_NM_KOR"), ("summary_data", "BASE_IDX_NM_KOR")),
    "listing_date": (("product_summary_data", "LIST_DT"),),
    "first_settle_date": (("product_summary_data", "FIRST_SETTLE_DT"),),
    "fiscal_period_text": (("product_summary_data", "FIN_PRD"),),
    "distribution_text": (("product_summary_data", "DIV_BASE_DT"),),
    "liquidity_provider_text": (("product_summary_data", "LP_NM_KOR"),),
    "type_text": (("summary_data", "ETF_TYP_SVC_NM"),),
    "fund_type_text": (("product_summary_data", "FUND_TYP"),),
}
# Number field -> where a detail reply has it.
DETAIL_NUMBERS = {
    "total_fee_pct": (("product_summary_data", "TOT_PAY"), ("summary_data", "TOT_PAY")),
    "net_assets": (("status_data", "MKT_VAL"),),
    "beta": (("status_data", "YR_BETA"),),
    "foreign_ownership_pct": (("status_data", "FRG_RT"),),
    "return_1m": (("status_data", "ERN1"),),
    "return_3m": (("status_data", "ERN3"),),
    "return_6m": (("status_data", "ERN6"),),
    "return_12m": (("status_data", "ERN12"),),
}
GRID_TYPE = "struct<grid_data:array<map<string,string>>>"


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Number rows from 0 in the order of their files' names, and of their place in a file.

    Spark deals splits to tasks by size, so the order of tasks is not that of files.  Rows that
    come from no file are numbered in the order of partitions.  The numbers are written once.
    """
    from_file = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    try:
        placed = df.withColumns(from_file)
    except AnalysisException:
        placed = df.withColumns({"_file": F.lit(""), "_block": F.lit(0).cast("bigint")})
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("_file").asc(), F.col("_block").asc(), F.col("_row").asc()]
    numbered = with_position(placed, order, name=name)
    return numbered.withColumn(name, F.col(name) - 1).drop("_file", "_block", "_row")


def read_holdings_csv(spark: SparkSession, path: str, keep_codes: bool = False) -> DataFrame:
    """Holdings file with quoted commas and an optional byte-order mark.

    ``keep_codes`` keeps the codes as written (upper-cased).  Without it numeric
    ones are padded and letters dropped, which may make codes collide; audit with
    :func:`fundlens.operators.quality.code_collisions`.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    absent = [c for c in HOLDINGS_COLUMNS if c not in names]
    if absent:
        raise ValueError(f"holdings file lacks columns {absent}; it has {list(names)}")

    def field(name: str) -> Column:
        return F.col(f"`{names[name]}`") if name in names else F.lit(None).cast("string")

    def code(name: str) -> Column:
        text = F.trim(field(name))
        if keep_codes:
            return F.when(text != "", F.upper(text))
        digits = F.regexp_replace(text, "[^0-9]", "")
        padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
        return F.when(text != "", F.when(digits != "", padded).otherwise(text))

    return raw.select(
        code("etfCode").alias("etf_code"),
        F.trim(F.coalesce(field("etfName"), F.lit(""))).alias("etf_name"),
        parse_number(field("rank")).cast("int").alias("rank"),
        code("holdingCode").alias("holding_code"),
        F.trim(field("holdingName")).alias("holding_name"),
        parse_number(field("quantity")).alias("quantity"),
        parse_number(field("weightPct")).alias("weight"),
        F.trim(F.coalesce(field("status"), F.lit(""))).alias("status"),
    )


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Listed items of a nested JSON reply, in list order."""
    item = "struct<itemcode:string,itemname:string,marketSum:double,nav:double>"
    schema = f"result struct<etfItemList:array<{item}>>"
    reply = spark.read.schema(schema).json(path, multiLine=True)
    return reply.select(F.posexplode("result.etfItemList").alias("ord", "item")).select(
        "ord",
        F.col("item.itemcode").alias("item_code"),
        F.col("item.itemname").alias("item_name"),
        F.col("item.marketSum").alias("reference_net_assets"),
        F.col("item.nav").alias("reference_nav"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one provider document each."""
    files = spark.read.text(path, wholetext=True)
    return parse_documents(files.select(F.col("value").alias("body")))


def parse_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """JSON provider documents -> header fields, rows and a fetch status.

    Rows are the array under the first of the known keys that holds one, or the
    document itself when it is an array.  A document without rows is marked
    NORMALIZATION_FAILED.  Of a repeated key the last one counts.
    """
    header = ("etfCode", "etfName", "baseDate")
    fields = documents.select("*", F.json_tuple(F.col(f"`{body}`"), *header, *ROW_KEYS).alias(*[f"_json_{k}" for k in (*header, *ROW_KEYS)]))

    def rows_in(text: Column) -> Column:
        return F.when(F.substring(F.trim(text), 1, 1) == "[", F.from_json(text, f"array<{ROW_MAP}>"))

    rows = F.coalesce(rows_in(F.col(f"`{body}`")), *[rows_in(F.col(f"_json_{key}")) for key in ROW_KEYS])
    opened = fields.withColumns(
        {
            "etf_code": clean_text("_json_etfCode"),
            "etf_name": clean_text("_json_etfName"),
            "raw_base_date": F.col("_json_baseDate"),
            "rows": rows,
        }
    ).withColumn(
        "fetch_status", F.when(F.col("rows").isNull(), "NORMALIZATION_FAILED").otherwise("OK")
    )
    return opened.drop(body, *[f"_json_{k}" for k in (*header, *ROW_KEYS)])


def document_rows(documents: DataFrame) -> DataFrame:
    """One raw row per holding, with its place in the document."""
    kept = [c for c in documents.columns if c != "rows"]
    return documents.select(*kept, F.posexplode("rows").alias("pos", "row"))


def block_pattern(name: str) -> str:
    """Pattern of an inline ``name = {...};`` object; blocks may span lines."""
    return rf"(?s){re.escape(name)}\s*=\s*(\{{.*?\}});"


def extract_pages(pages: DataFrame, blocks: Mapping[str, str], html: str = "html") -> DataFrame:
    """Inline object blocks of each page as typed columns; absent or broken ones are null."""
    found = {
        name: F.from_json(
            F.nullif(F.regexp_extract(html, block_pattern(name), 1), F.lit("")), schema
        )
        for name, schema in blocks.items()
    }
    return pages.withColumns(found).drop(html)


def page_metadata(pages: DataFrame) -> DataFrame:
    """Detail pages (etf_code, html) -> one metadata row per page."""
    names = ("summary_data", "status_data", "product_summary_data")
    parsed = extract_pages(pages, {**{n: ROW_MAP for n in names}, "CU_data": GRID_TYPE})

    def first(keys: tuple[tuple[str, str], ...]) -> Column:
        return F.coalesce(*[F.col(block)[key] for block, key in keys])

    grid = F.col("CU_data.grid_data")
    return parsed.select(
        "etf_code",
        *[first(keys).alias(c) for c, keys in DETAIL_KEYS.items()],
        *[parse_number(first(keys)).alias(c) for c, keys in DETAIL_NUMBERS.items()],
        F.get(grid, F.lit(0))["TRD_DT"].alias("as_of"),
    )


def page_holdings(pages: DataFrame) -> DataFrame:
    """Grid rows of detail pages that have a name and a weight."""
    parsed = extract_pages(pages, {"CU_data": GRID_TYPE})
    rows = parsed.select("etf_code", F.posexplode("CU_data.grid_data").alias("pos", "row"))
    return rows.select(
        "etf_code",
        (F.col("pos") + 1).alias("rank"),
        F.lit(None).cast("string").alias("code"),
        F.col("row")["STK_NM_KOR"].alias("name"),
        parse_number(F.col("row")["ETF_WEIGHT"]).alias("weight"),
        parse_number(F.col("row")["AGMT_STK_CNT"]).alias("quantity"),
        F.col("row")["TRD_DT"].alias("as_of"),
    ).where((F.col("name") != "") & F.col("weight").isNotNull())


def page_table_holdings(pages: DataFrame) -> DataFrame:
    """Holdings table of listing pages: linked name, quantity and weight cells."""
    table = F.regexp_extract("html", r'(?s)class="section etf_asset.*?<tbody>(.*?)</tbody>', 1)
    rows = F.filter(
        F.split(table, "</tr>"), lambda r: r.rlike(r'(?s)<td class="ctg[^"]*">\s*<a ')
    )
    cells = F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)
    exploded = pages.select("etf_code", F.posexplode(rows).alias("pos", "row"))

    def text(i: int) -> Column:
        return F.trim(F.regexp_replace(F.get(cells, F.lit(i)), "<[^>]+>", ""))

    return exploded.select(
        "etf_code",
        (F.col("pos") + 1).alias("rank"),
        F.regexp_extract("row", r'href="[^"]*code=([^"&]+)', 1).alias("code"),
        text(0).alias("name"),
        parse_number(text(1)).alias("quantity"),
        parse_number(text(2)).alias("weight"),
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Host, language, title and inline tracker number of web pages."""

    def group(pattern: str, source: str = "html") -> Column:
        return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))

    return pages.select(
        "page_id",
        group("^[a-z]+://([^/:?#]+)", "url").alias("host"),
        group('(?s)<html[^>]*lang="([a-z]+)"').alias("lang"),
        clean_text(group("(?s)<title>(.*?)</title>")).alias("title"),
        group(r"track\(([0-9]+)\)").try_cast("bigint").alias("tracker"),
        F.length("html").cast("bigint").alias("chars"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page in page order."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)
    return pages.select("page_id", F.posexplode(links).alias("pos", "href"))


def snapshot_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of paged snapshot replies; a page's item is an array or a single object."""
    item = F.trim(F.get_json_object(body, "$.response.body.items.item"))
    as_array = F.when(F.substring(item, 1, 1) == "{", F.concat(F.lit("["), item, F.lit("]"))).otherwise(item)
    return pages.select(F.explode(F.from_json(as_array, f"array<{ROW_MAP}>")).alias("row"))


def map_snapshot(rows: DataFrame) -> DataFrame:
    """Raw snapshot rows -> typed rows; amounts in units of 1e8 won.  Rows without a code go."""
    convert = {"text": clean_text, "number": parse_number, "eok": to_eok}
    typed = rows.select(
        *[
            convert[kind](first_present("row", [key])).alias(name)
            for name, (key, kind) in SNAPSHOT_KEYS.items()
        ]
    )
    return typed.where(F.col("code") != "")


def latest_snapshot(rows: DataFrame, key: str = "bas_dt") -> DataFrame:
    """Rows of the newest day."""
    newest = rows.agg(F.max(key).alias(key))
    return rows.join(newest, key, "left_semi")


def targets(codes: DataFrame, column: str = "code") -> DataFrame:
    return codes.select(normalize_etf_code(column).alias("etf_code")).distinct()
