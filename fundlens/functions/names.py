"""Facts that can be read off a fund's name or schedule text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import BLANK, clean_text, col, finite, strip

# Asset types of the common holdings schema.
ASSET_TYPES = (
    "EQUITY", "ETF", "FUTURE", "OPTION", "SWAP", "BOND", "CASH", "CURRENCY",
    "REIT", "FUND", "DERIVATIVE", "OTHER", "UNKNOWN",
)

# A word edge that counts ASCII word characters only, so Hangul may touch the word.
WORD_START = "(?<![0-9A-Za-z_])"
WORD_END = "(?![0-9A-Za-z_])"

# Text -> asset type, the first match wins.
ASSET_TYPE_WORDS = (
    ("보통주|우선주|주식|주권|equity|stock|share", "EQUITY"),
    (f"상장지수|{WORD_START}etf{WORD_END}", "ETF"),
    ("선물|future", "FUTURE"),
    ("옵션|option", "OPTION"),
    ("스왑|swap", "SWAP"),
    ("국채|회사채|채권|bond", "BOND"),
    ("현금|예금|예치금|cash|원화현금|deposit", "CASH"),
    ("외화|통화|currency|usd|forex|fx", "CURRENCY"),
    ("리츠|reit", "REIT"),
    ("수익증권|펀드|fund", "FUND"),
    ("파생|derivative", "DERIVATIVE"),
)

# Brand -> asset manager.
ISSUER_BY_BRAND = {
    "KODEX": "삼성자산운용",
    "TIGER": "미래에셋자산운용",
    "KOSEF": "키움투자자산운용",
    "KBSTAR": "KB자산운용",
    "RISE": "KB자산운용",
    "ARIRANG": "한화자산운용",
    "HANARO": "NH아문디자산운용",
    "SOL": "신한자산운용",
    "ACE": "한국투자신탁운용",
    "PLUS": "한화자산운용",
    "TIMEFOLIO": "타임폴리오자산운용",
}

# Words of a name that point abroad.
OVERSEAS_WORDS = (
    "미국", "나스닥", "S&P", "글로벌", "해외", "차이나", "중국", "베트남", "유로",
    "일본", "인도", "선진국", "신흥",
)

# Fixed values: (pattern, text of the hint).
NAME_HINTS = (
    ("레버리지", "name_contains=레버리지"),
    ("인버스", "name_contains=인버스"),
    ("액티브", "name_contains=액티브"),
    ("커버드콜", "name_contains=커버드콜"),
    (r"\(H\)", "name_contains=(H) 환헤지 표기"),
    ("합성", "name_contains=합성(스왑) 구조"),
    ("만기매칭|목표전환", "name_contains=만기매칭/목표전환"),
)
# Patterns of a leverage factor and of a monthly schedule.
LEVERAGE_IN_NAME = r"(?i)([0-9](?:\.[0-9])?)\s*X"
MONTHLY_SCHEDULE = r"매월|매\s*1,\s*2,\s*3"


def asset_type(c: Column | str) -> Column:
    """Map a provider's cleaned wording to the asset type, ``UNKNOWN`` if nothing fits."""
    text = col(c)
    result = F.when(text.isNull(), "UNKNOWN").when(text.isin(*ASSET_TYPES), text)
    for pattern, kind in ASSET_TYPE_WORDS:
        result = result.when(text.rlike(f"(?i){pattern}"), kind)
    return result.otherwise("UNKNOWN")


def leverage_label(name: Column | str) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    doubled = name.rlike(f"(?i){WORD_START}2X{WORD_END}|2배|곱버스")
    return (
        F.when(name.contains("인버스") & doubled, "-2X")
        .when(name.contains("인버스"), "-1X")
        .when(name.contains("레버리지"), "2X")
        .otherwise("ETF")
    )


def leverage_class(name: Column | str) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    return F.when(name.contains("인버스"), "inv").when(name.contains("레버리지"), "lev").otherwise("")


def region_of(name: Column | str, words: tuple[str, ...] = OVERSEAS_WORDS) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    return F.when(name.rlike("|".join(words)), "overseas").otherwise("domestic")


def brand_token(name: Column | str) -> Column:
    """First word of the name, cut to six characters (longer brands stay unresolved)."""
    first = F.split(strip(F.coalesce(col(name), F.lit(""))), f"{BLANK}+")[0]
    return F.when(first == "", "ETF").otherwise(F.substring(first, 1, 6))


def issuer_of(issuer: Column | str, name: Column | str) -> Column:
    """Given issuer, else the one its brand stands for."""
    brands = F.create_map(*[F.lit(x) for pair in ISSUER_BY_BRAND.items() for x in pair])
    given = F.when(col(issuer) != "", col(issuer))
    return F.coalesce(given, brands[brand_token(name)])


def name_hints(name: Column | str) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    factor = F.regexp_extract(name, LEVERAGE_IN_NAME, 1)
    leverage = F.when(factor != "", F.concat(F.lit("leverage="), factor, F.lit("X(명칭 표기)")))
    rest = [F.when(name.rlike(pattern), hint) for pattern, hint in NAME_HINTS]
    return F.array_compact(F.array(leverage, *rest))


def code_type(code: Column | str) -> Column:
    return F.when(col(code).rlike("^[0-9]{6}$"), "krx_numeric").otherwise(
        "naver_internal_unresolved"
    )


def pays_monthly(schedule: Column | str) -> Column:
    """Null when there is no schedule text."""
    return F.when(F.length(col(schedule)) > 0, col(schedule).rlike(MONTHLY_SCHEDULE))


def is_covered_call(name: Column | str) -> Column:
    return F.coalesce(col(name).contains("커버드콜"), F.lit(False))


def name_flag(name: Column | str, pattern: str) -> Column:
    """True when the pattern occurs, else null: absence of a word proves nothing."""
    return F.when(col(name).rlike(pattern), F.lit(True))


def market_size(market_cap: Column | str, net_assets: Column | str) -> Column:
    """Sort value of the size order: market cap, else net assets."""
    return F.coalesce(finite(market_cap), finite(net_assets))


def token_estimate(chars: Column | str) -> Column:
    return F.ceil(col(chars) / F.lit(2.2)).cast("bigint")
