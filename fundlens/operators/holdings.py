"""Holdings: normalizing provider rows, top-N lists, figures and derived references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import (
    clean_text,
    exact_sum,
    finite,
    half_up,
    not_finite,
    padded_asset_code,
    parse_number,
)
from ..functions.names import asset_type
from .ordering import first_by, top_per_key, with_position

# Keys under which providers send a field, the first present one counts.
ALIASES = {
    "code": (
        "assetCode", "종목코드", "티커", "isuCd", "isuSrtCd", "code", "shortCode", "단축코드",
        "ISIN", "isin",
    ),
    "name": ("assetName", "종목명", "한글종목명", "isuNm", "name", "itemName", "자산명"),
    "weight": ("weightPct", "비중", "weight", "구성비", "구성비중", "ratio"),
    "quantity": ("quantity", "수량", "주식수", "보유수량", "주식수량"),
    "contract": ("contractCount", "계약수", "계약수량", "contracts"),
    "market_value": ("marketValue", "금액", "평가금액", "시가평가금액", "평가액", "평가금액원"),
    "market": ("market", "시장", "시장구분", "exchange", "거래소"),
    "currency": ("currency", "통화", "통화코드", "ccy"),
    "rank": ("rank", "순위", "순번", "no"),
    "asset_type": ("assetType", "유형", "자산유형", "type", "종목유형", "구분", "종류"),
}
TOP_HOLDINGS = 10


def normalize_rows(raw: DataFrame, row: str = "row", pos: str = "pos") -> DataFrame:
    """Raw key-value rows -> common holding columns; other columns pass through.

    A blank weight stays null and a zero weight stays zero.  The rank falls back
    to the row's place in its document (``pos`` counts from 0).
    """
    kept = [c for c in raw.columns if c != row]
    found, picked = _picked(raw, row, kept)
    return _normalized(found, kept, picked, pos)


def normalize_columns(raw: DataFrame, pos: str = "pos") -> DataFrame:
    """:func:`normalize_rows` for a provider table with fixed columns.

    Which alias applies is known from the column names, so nothing is looked up
    per row.
    """
    aliases = {key for keys in ALIASES.values() for key in keys}
    kept = [c for c in raw.columns if c not in aliases]
    picked = {}
    for field, keys in ALIASES.items():
        given = next((key for key in keys if key in raw.columns), None)
        picked[field] = F.col(f"`{given}`").cast("string") if given else F.lit(None).cast("string")
    return _normalized(raw, kept, picked, pos)


def _picked(raw: DataFrame, row: str, kept: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """A table in which each field is at hand, as :func:`first_present` gives it for one field.

    Every key of a row is looked up once: its number orders keys by field, alias and place.
    Numbers are sorted in a lambda's step, which Spark compiles apart from the cleaning; in
    one method both are beyond the 8000 bytes up to which the JVM compiles.
    """
    field, alias = 40, 20  # bits before the number of the field and of the alias
    numbers = [(k, (i << field) + (j << alias)) for i, keys in enumerate(ALIASES.values()) for j, k in enumerate(keys)]
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("bigint") for pair in numbers for x in pair])
    other = F.lit(len(ALIASES) << field).cast("bigint")
    numbered = F.transform(F.map_keys(row), lambda key, place: F.coalesce(known[key], other) + place)
    ordered = raw.select(*kept, F.map_values(row).alias("_row_values"), F.sort_array(numbered).alias("_row_order"))
    fields = F.transform("_row_order", lambda n: F.shiftright(n, field).cast("int"))
    found = ordered.select("*", fields.alias("_row_fields"))

    def pick(i: int) -> Column:
        number = F.get("_row_order", F.array_position("_row_fields", F.lit(i)).cast("int") - 1)
        return F.get("_row_values", number.bitwiseAND(F.lit((1 << alias) - 1)).cast("int"))

    return found, {name: pick(i) for i, name in enumerate(ALIASES)}


def _normalized(raw: DataFrame, kept: list[str], picked: dict[str, Column], pos: str) -> DataFrame:
    # In three steps, since an expression used several times is evaluated once per
    # row only when it is a column of a projection below.
    texts = ("code", "name", "asset_type", "market", "currency")
    numbers = ("weight", "quantity", "contract", "market_value", "rank")
    chosen = raw.select(*kept, *[value.alias(f"_{f}") for f, value in picked.items()])
    cleaned = chosen.select(
        *kept,
        F.col("_code").alias("raw_asset_code"),
        *[clean_text(f"_{f}").alias(f"_{f}") for f in texts],
        *[parse_number(f"_{f}").alias(f"_{f}") for f in numbers],
    )
    whole_rank = F.when(F.col("_rank") < 0, F.ceil("_rank")).otherwise(F.floor("_rank"))
    return cleaned.select(
        *kept,
        padded_asset_code("_code").alias("asset_code"),
        F.col("_name").alias("asset_name"),
        asset_type("_asset_type").alias("asset_type"),
        F.col("_market").alias("market"),
        F.col("_currency").alias("currency"),
        F.col("_quantity").alias("quantity"),
        F.col("_contract").alias("contract_count"),
        F.col("_market_value").alias("market_value"),
        F.col("_weight").alias("weight_pct"),
        F.coalesce(whole_rank.cast("int"), F.col(pos).cast("int") + 1).alias("rank"),
        "raw_asset_code",
    )


def top_holdings(holding: DataFrame, n: int = TOP_HOLDINGS, keys: tuple[str, ...] = ("etf_id",)) -> DataFrame:
    """Largest ``n`` holdings per fund, ranked 1..n by weight."""
    tie = [c for c in ("ord", "stock_id", "asset_code", "name") if c in holding.columns][:1]
    order = [F.col("weight").desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    return top_per_key(holding.drop("rank"), keys, order, n, name="rank")


def top_weight_total(holding: DataFrame, n: int = TOP_HOLDINGS) -> DataFrame:
    """Weight of the ``n`` largest holdings together."""
    return top_holdings(holding, n).groupBy("etf_id").agg(
        half_up(exact_sum("weight", 4), 2).alias("top_weight")
    )


def holding_summary(holding: DataFrame, n: int = TOP_HOLDINGS) -> DataFrame:
    """Top ``n`` holdings per fund, blank weights last, with the fund's holding count."""
    counts = holding.groupBy("etf_id").agg(F.count(F.lit(1)).alias("total_count"))
    return top_holdings(holding, n).join(counts, "etf_id")


def kept_rows(rows: DataFrame) -> DataFrame:
    """Flag the rows of a holdings file that are usable; the others are only counted."""
    usable = (
        (F.trim("status") == "OK")
        & (F.coalesce("etf_code", F.lit("")) != "")
        & (F.coalesce(F.trim("holding_name"), F.lit("")) != "")
        & F.col("weight").isNotNull()
    )
    return rows.withColumn("kept", F.coalesce(usable, F.lit(False)))


def build_groups(rows: DataFrame, n: int = TOP_HOLDINGS) -> DataFrame:
    """Usable rows -> top ``n`` per fund, re-ranked by weight at two decimals."""
    rounded = kept_rows(rows).where("kept").withColumn("weight", half_up("weight", 2))
    return top_per_key(
        rounded.drop("rank", "kept"), "etf_code", [F.col("weight").desc(), F.col("ord").asc()], n, "rank"
    )


def group_counts(rows: DataFrame) -> DataFrame:
    """Kept and skipped rows, and funds with at least one kept row."""
    per_fund = kept_rows(rows).groupBy("etf_code").agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped")
    )
    return per_fund.agg(
        F.sum("kept").alias("kept"),
        F.sum("skipped").alias("skipped"),
        F.count_if(F.col("kept") > 0).alias("funds"),
    )


def fund_holdings(etf: DataFrame, holding: DataFrame, stock: DataFrame) -> DataFrame:
    """A fund's holdings with stock code and name; an unknown stock leaves these null."""
    names = first_by(stock, "id", F.col("ord").desc()).select(
        F.col("id").alias("stock_id"),
        F.col("code").alias("stock_code"),
        F.col("name").alias("stock_name"),
    )
    funds = etf.select(F.col("id").alias("etf_id"), "code").distinct()
    return holding.join(funds, "etf_id").join(names, "stock_id", "left").select(
        "code", "rank", "stock_code", "stock_name", "weight"
    )


def holding_figures(holding: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of valued, blank, bad and negative weights, their sum, and repeated assets.

    Rows are counted per asset first, which finds the repeats and lets a document
    with very many rows be combined before it moves.
    """
    weight = finite("weight_pct")
    shaped = "shape_errors" in holding.columns
    misshapen = F.size("shape_errors") > 0 if shaped else F.lit(False)
    per_asset = holding.groupBy(*keys, "asset_code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(weight).alias("valued"),
        F.count_if(not_finite("weight_pct")).alias("bad"),
        F.count_if(weight < 0).alias("negative"),
        F.count_if(misshapen).alias("misshapen"),
        exact_sum(weight, 4).alias("weight"),
    )
    repeated = F.col("asset_code").isNotNull() & (F.col("rows") > 1)
    return per_asset.groupBy(*keys).agg(
        F.sum("rows").alias("row_count"),
        F.sum("valued").alias("valued_count"),
        F.sum(F.col("rows") - F.col("valued") - F.col("bad")).alias("blank_count"),
        F.sum("bad").alias("bad_count"),
        F.sum("negative").alias("negative_count"),
        F.sum("misshapen").alias("misshapen_count"),
        exact_sum("weight", 4).alias("weight_sum"),
        F.count_if(repeated).alias("repeated_assets"),
    )


def related_funds(holding: DataFrame) -> DataFrame:
    """Funds holding each stock, in the order of their first edge, one row per pair.

    The long form is the working form: a popular stock has no bounded list.
    """
    first = holding.groupBy("stock_id", "etf_id").agg(F.min("ord").alias("ord"))
    return with_position(first, [F.col("ord").asc(), F.col("etf_id").asc()], by=["stock_id"]).drop("ord")


def holding_ids(holding: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Every holding of each fund with its place, by rank or in the given order.

    The long form has no bound on a fund's list; a big fund spreads over tasks.
    """
    order = order or [F.col("rank").asc(), F.col("stock_id").asc()]
    return with_position(holding, order, by=["etf_id"], name="place").select("etf_id", "place", "stock_id")


def backfill_codes(holding: DataFrame, other: DataFrame) -> DataFrame:
    """Fill blank holding codes by exact name from a second source of the same fund.

    Of several rows with one name in the second source the last one counts.
    """
    known = other.groupBy("etf_code", "name").agg(F.max_by("code", "ord").alias("_code"))
    return holding.join(known, ["etf_code", "name"], "left").withColumn(
        "code", F.coalesce("code", "_code")
    ).drop("_code")
