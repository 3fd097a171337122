"""Screens: rankings, theme views, search, filters, reverse lookup and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.display import bar_width, heat_bucket, relative_size
from ..functions.names import market_size
from .ordering import first_by, top, top_per_key, with_position, with_positions

# Ranking tab -> (ranking column, ascending).
RANKING_TABS = {
    "gainers": ("change_rate_1d", False),
    "losers": ("change_rate_1d", True),
    "volume": ("trading_value_change_rate", False),
    "volatility": ("volatility_score", False),
}
# Period -> theme return column.
PERIOD_RETURNS = {"1d": "return_1d", "1w": "return_1w", "1m": "return_1m"}
# Sort orders of the explorer list.
EXPLORER_SORTS = ("market_cap", "change_rate_1d", "trading_value", "current_price")
EXPLORER_PAGE = 5
RANKING_CARDS = 8
TOP_THEMES = 6

# Filter chip -> words looked for in the fund's name.
CHIP_KEYWORDS = {
    "게임/엔터/미디어": ("게임", "엔터", "미디어", "K-POP", "콘텐츠"),
    "IT": ("IT", "소프트웨어", "인터넷", "테크"),
    "의료/제약/바이오": ("바이오", "헬스", "제약", "의료"),
    "반도체": ("반도체", "AI반도체", "시스템반도체"),
    "전기차/2차전지": ("2차전지", "배터리", "전기차", "2차전지소부장"),
    "클린에너지": ("친환경", "태양광", "수소", "신재생", "클린"),
    "원자재": ("원유", "골드", "금", "구리", "원자재", "천연가스"),
    "자율주행/모빌리티": ("모빌리티", "자율주행", "로봇"),
    "테크/기술": ("테크", "나스닥", "빅테크"),
    "금융": ("은행", "금융", "증권", "보험"),
    "우주항공/방산": ("방산", "우주", "항공", "K-방산"),
    "AI전력/인프라": ("AI", "전력", "인프라", "데이터센터", "원자력"),
    "레버리지": ("레버리지",),
    "인버스": ("인버스",),
    "성장주": ("성장",),
    "가치주": ("가치", "밸류"),
    "부동산 리츠": ("리츠", "REIT", "부동산"),
    "경기소비재": ("소비재", "컨슈머"),
    "S&P500": ("S&P", "S&P500"),
    "나스닥100": ("나스닥", "나스닥100"),
    "밸류업": ("밸류업", "Value-up"),
    "한국 고배당": ("고배당", "배당"),
    "미국 배당성장": ("배당성장", "배당다우"),
    "커버드콜 배당": ("커버드콜",),
    "월배당": ("월배당",),
}


def _period_column(period: str) -> str:
    if period not in PERIOD_RETURNS:
        raise ValueError(f"unknown period: {period}")
    return PERIOD_RETURNS[period]


def ranked(etf: DataFrame, tab: str, limit: int | None = None) -> DataFrame:
    """Funds of a ranking tab with their rank; ``limit`` keeps the first cards only."""
    if tab not in RANKING_TABS:
        raise ValueError(f"unknown ranking tab: {tab}")
    column, ascending = RANKING_TABS[tab]
    key = F.col(column).asc() if ascending else F.col(column).desc()
    order = [key, F.col("trading_value").desc_nulls_last(), F.col("name").asc(), F.col("id").asc()]
    valued = first_by(etf, "id", F.col("ord").asc()).where(finite(column).isNotNull())
    if limit is not None:
        return top(valued, order, limit, name="rank")
    return with_position(valued, order, name="rank")


def heatmap(themes: DataFrame, period: str) -> DataFrame:
    """Themes by trading value with size class, tone and size relative to the largest."""
    column = _period_column(period)
    order = [F.col("trading_value").desc(), F.col("name").asc(), F.col("theme_id").asc()]
    shown = themes.select(
        F.col("id").alias("theme_id"), "name", F.col(column).alias("return_rate"), "trading_value"
    )
    largest = shown.agg(F.coalesce(F.max("trading_value"), F.lit(0.0)).alias("_largest")).scalar()
    placed = with_position(shown, order).withColumn("_largest", largest)
    size = F.when(F.col("position") <= 2, "lg").when(F.col("position") <= 6, "md").otherwise("sm")
    return placed.select(
        "position",
        "theme_id",
        "name",
        "return_rate",
        "trading_value",
        size.alias("size_class"),
        heat_bucket("return_rate").alias("tone"),
        relative_size("trading_value", "_largest").alias("relative_size"),
    )


def extremes(themes: DataFrame, period: str) -> DataFrame:
    """Strongest and weakest theme.

    Ties go to the higher trading value, then the smaller name, at both ends.
    """
    value = F.col(_period_column(period))
    tie = (-F.col("trading_value"), F.col("name"), F.col("id"))
    return themes.agg(
        F.min_by("id", F.struct(-value, *tie)).alias("strongest_id"),
        F.min_by("id", F.struct(value, *tie)).alias("weakest_id"),
    )


def all_extremes(themes: DataFrame) -> DataFrame:
    """:func:`extremes` of every period from one pass over the themes."""
    tie = (-F.col("trading_value"), F.col("name"), F.col("id"))
    ends = themes.agg(
        *[
            F.min_by("id", F.struct(sign * F.col(column), *tie)).alias(f"{period}_{end}")
            for period, column in PERIOD_RETURNS.items()
            for end, sign in (("strongest", -1), ("weakest", 1))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(period).alias("period"),
                F.col(f"{period}_strongest").alias("strongest_id"),
                F.col(f"{period}_weakest").alias("weakest_id"),
            )
            for period in PERIOD_RETURNS
        ]
    )
    return ends.select(F.inline(rows))


def top_themes(themes: DataFrame, n: int = TOP_THEMES) -> DataFrame:
    return top(themes, [F.col("trading_value").desc(), F.col("ord").asc()], n)


def market_summary(summaries: DataFrame, period: str) -> DataFrame:
    _period_column(period)
    return summaries.where(F.col("period") == period)


def by_theme(etf: DataFrame, theme_id: str | None) -> DataFrame:
    """Funds of one theme, first row per id; no theme gives no rows."""
    if not theme_id:
        return etf.limit(0)
    return first_by(etf.where(F.col("theme_id") == theme_id), "id", F.col("ord").asc())


def _contains_folded(c: Column | str, needle: str) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c).contains(needle.lower())


def search(etf: DataFrame, stock: DataFrame, theme: DataFrame, query: str | None) -> DataFrame:
    """Case-blind substring search: funds and stocks by name or code, themes by name."""
    needle = (query or "").strip()

    def hits(df: DataFrame, kind: str, with_code: bool) -> DataFrame:
        found = _contains_folded("name", needle)
        code = F.col("code") if with_code else F.lit(None).cast("string")
        if with_code:
            found = found | _contains_folded("code", needle)
        rows = df.where(found if needle else F.lit(False))
        return first_by(rows, "id", F.col("ord").asc()).select(
            F.lit(kind).alias("kind"), "id", code.alias("code"), "name"
        )

    return hits(etf, "etf", True).unionByName(hits(stock, "stock", True)).unionByName(
        hits(theme, "theme", False)
    )


def is_empty_query(query: str | None) -> bool:
    return not (query or "").strip()


def chip_condition(name: Column | str, chip: str) -> Column:
    """True when the name holds any word of the chip; an unknown chip stands for itself."""
    words = CHIP_KEYWORDS.get(chip, (chip,))
    upper = F.upper(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    condition = F.lit(False)
    for word in words:
        condition = condition | upper.contains(word.upper())
    return condition


def by_chip(etf: DataFrame, chip: str) -> DataFrame:
    return etf.where(chip_condition("name", chip))


def chip_members(etf: DataFrame) -> DataFrame:
    """Every (chip, fund) pair, from one pass over the funds."""
    chips = F.array(*[F.when(chip_condition("name", chip), chip) for chip in CHIP_KEYWORDS])
    return etf.withColumn("chip", F.explode(F.array_compact(chips)))


def watchlist(etf: DataFrame, codes: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(codes, DataFrame):
        return etf.join(codes.select("code").distinct(), "code", "left_semi")
    return etf.where(F.col("code").isin(list(codes)))


def explore(
    etf: DataFrame,
    watch: DataFrame | Sequence[str] | None = None,
    query: str | None = None,
    chip: str | None = None,
    sort: str = "market_cap",
    limit: int = EXPLORER_PAGE,
) -> DataFrame:
    """Explorer list: one of watch list, search or chip, one sort order, one page."""
    if sort not in EXPLORER_SORTS:
        raise ValueError(f"unknown sort order: {sort}")
    if watch is not None:
        rows = watchlist(etf, watch)
    elif not is_empty_query(query):
        needle = query.strip()
        rows = etf.where(_contains_folded("name", needle) | _contains_folded("code", needle))
    elif chip:
        rows = by_chip(etf, chip)
    else:
        rows = etf
    if sort == "market_cap":
        cap = F.col("market_cap") if "market_cap" in etf.columns else F.lit(None).cast("double")
        value = market_size(cap, F.col("net_assets"))
    else:
        value = finite(sort)
    return top(
        rows.withColumn("sort_value", value),
        [F.col("sort_value").desc_nulls_last(), F.col("ord").asc()],
        limit,
    )


def funds_by_stock(etf: DataFrame, holding: DataFrame, stock_id: str | None = None) -> DataFrame:
    """Funds holding a stock, or every stock when none is named, in display order.

    ``holding``: ord, etf_id, stock_id, weight, rank.  Of repeated edges the first
    counts; of repeated funds the last row counts.
    """
    if stock_id is not None:
        holding = holding.where(F.col("stock_id") == stock_id)
    edges = holding.groupBy("etf_id", "stock_id").agg(
        F.min_by("weight", "ord").alias("weight"), F.min_by("rank", "ord").alias("rank")
    )
    owner = first_by(etf, "id", F.col("ord").desc()).select(
        F.col("id").alias("etf_id"), "name", "trading_value"
    )
    rows = edges.join(owner, "etf_id")
    order = [
        F.col("weight").desc(),
        F.col("trading_value").desc_nulls_last(),
        F.col("name").asc(),
        F.col("etf_id").asc(),
    ]
    return with_positions(rows, {"position": order}, by=["stock_id"], totals={"widest": F.max("weight")})


def with_bars(rows: DataFrame) -> DataFrame:
    """Bar width of each fund's weight against the ``widest`` one of the same stock."""
    return rows.withColumn("bar_width", bar_width("weight", "widest")).drop("widest")


def compare(
    etf: DataFrame, holding: DataFrame, stock: DataFrame, ids: Sequence[str] | None = None
) -> DataFrame:
    """Figures of the chosen funds in the given order, or of every fund when none is named.

    Three holding names by rank, and the weight of the top two when there are two.
    """
    figures = ["net_assets", "trading_value", "total_fee", "return_1m"]
    funds = first_by(etf, "id", F.col("ord").asc())
    if ids is not None:
        chosen = list(dict.fromkeys(ids))
        holding = holding.where(F.col("etf_id").isin(chosen))
        funds = funds.where(F.col("id").isin(chosen)).withColumn(
            "position", F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col("id"))
        )
    else:
        funds = funds.withColumn("position", F.col("ord"))
    for name in figures:
        if name not in funds.columns:
            funds = funds.withColumn(name, F.lit(None).cast("double"))
    edge_order = [F.col("rank").asc(), F.col("stock_id").asc()]
    best = top_per_key(holding, "etf_id", edge_order, 3, name="_place")
    named = best.join(
        first_by(stock, "id", F.col("ord").desc()).select(
            F.col("id").alias("stock_id"), F.col("name").alias("stock_name")
        ),
        "stock_id",
        "left",
    )
    # At most three rows per fund are collected here.
    per_fund = named.groupBy("etf_id").agg(
        F.transform(
            F.sort_array(
                F.collect_list(F.when(F.col("stock_name").isNotNull(), F.struct("_place", "stock_name")))
            ),
            lambda edge: edge["stock_name"],
        ).alias("top_holding_names"),
        F.max(F.when(F.col("_place") == 1, F.col("weight"))).alias("_first"),
        F.max(F.when(F.col("_place") == 2, F.col("weight"))).alias("_second"),
    )
    return funds.join(per_fund, funds["id"] == per_fund["etf_id"], "left").select(
        "position",
        F.col("id").alias("etf_id"),
        "name",
        F.coalesce("top_holding_names", F.array().cast("array<string>")).alias("top_holding_names"),
        (F.col("_first") + F.col("_second")).alias("top2_concentration"),
        *figures,
    )


def representatives(themes: DataFrame, etf: DataFrame, stock: DataFrame) -> DataFrame:
    """Names of each theme's representative funds and stocks, in list order.

    Long form (theme_id, kind, place, id, name); ids without a match are skipped.
    """

    def named(kind: str, ids: str, target: DataFrame) -> DataFrame:
        listed = themes.select(
            F.col("id").alias("theme_id"), F.posexplode(ids).alias("place", "ref_id")
        )
        names = first_by(target, "id", F.col("ord").desc()).select(
            F.col("id").alias("ref_id"), "name"
        )
        return listed.join(names, "ref_id").select(
            "theme_id", F.lit(kind).alias("kind"), "place", "ref_id", "name"
        )

    return named("etf", "representative_etf_ids", etf).unionByName(
        named("stock", "representative_stock_ids", stock)
    )

