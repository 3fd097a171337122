"""Texts and buckets shown to a reader of the screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import col, finite, half_up

# Fixed value: text shown in place of a missing number.
NO_INFORMATION = "정보 없음"


def signed_percent(c: Column | str) -> Column:
    value = finite(c)
    text = F.concat(F.format_string("%.2f", F.abs(value)), F.lit("%"))
    return (
        F.when(value > 0, F.concat(F.lit("+"), text))
        .when(value < 0, F.concat(F.lit("-"), text))
        .when(value == 0, "0.00%")
        .otherwise(NO_INFORMATION)
    )


def _grouped(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("#,##0.###"))


def krw_text(c: Column | str) -> Column:
    """Amount in units of 1e8 won as 조/억원 text."""
    value = finite(c)
    jo = F.floor(value / 10000).cast("string")
    rest = F.pmod(value, F.lit(10000.0))
    return (
        F.when(value.isNull() | (value < 0), NO_INFORMATION)
        .when(value < 10000, F.concat(_grouped(value), F.lit("억원")))
        .when(rest == 0, F.concat(jo, F.lit("조원")))
        .otherwise(F.concat(jo, F.lit("조 "), _grouped(rest), F.lit("억원")))
    )


def price_text(c: Column | str) -> Column:
    value = finite(c)
    return F.coalesce(F.concat(_grouped(value), F.lit("원")), F.lit(NO_INFORMATION))


def heat_bucket(rate: Column | str) -> Column:
    rate = finite(rate)
    level = F.when(F.abs(rate) >= 3, "3").when(F.abs(rate) >= 1.5, "2").otherwise("1")
    return (
        F.when(rate > 0, F.concat(F.lit("up-"), level))
        .when(rate < 0, F.concat(F.lit("down-"), level))
        .otherwise("flat")
    )


def relative_size(value: Column | str, largest: Column | str) -> Column:
    """Share of the largest value, 0 when there is nothing to compare with."""
    value = F.coalesce(col(value), F.lit(0.0))
    return F.when(col(largest) > 0, value / col(largest)).otherwise(0.0)


def bar_width(weight: Column | str, largest: Column | str) -> Column:
    """Bar length in percent of the longest bar, at least 4."""
    longest = F.greatest(F.coalesce(col(largest), F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(4.0), half_up(col(weight) / longest * 100))


def change_amount(price: Column | str, rate: Column | str) -> Column:
    return half_up(col(price) * (col(rate) / F.lit(100.0)))
