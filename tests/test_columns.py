"""Cleaning, naming and display rules, with the expected values of the feed contract."""

import pytest
from pyspark.sql import functions as F

from fundlens.functions import clean, display, names


def test_nullify_and_numbers(one):
    values = [None, "", " - ", "N/A", "null", "1,234", "12.5%", "₩ 1,000", "abc", "1d", "NaN",
              "Infinity", "0x10", ".5", "5.", "-1e3", "+7", "1e999", "0"]
    assert one(clean.parse_number("x"), values) == [
        None, None, None, None, None, 1234.0, 12.5, 1000.0, None, None, None,
        None, None, 0.5, 5.0, -1000.0, 7.0, None, 0.0,
    ]
    assert one(clean.nullify("x"), [" a ", " ", " - "]) == [" a ", None, None]


def test_codes(one):
    assert one(clean.normalize_code("x"), ["5930", "A005930", "1234567", "abc", "-"]) == [
        "005930", "005930", None, None, None]
    assert one(clean.normalize_etf_code("x"), ["5930", "0000d0", " 069500 ", "", None, "1234567"]) == [
        "005930", "0000D0", "069500", "", "", "1234567"]
    assert one(clean.normalize_asset_code("x"), ["5930", "A5930", "AAPL", "US0378331005", "A1234567", " K2 F "]) == [
        "005930", "005930", "AAPL", "US0378331005", "A1234567", "K2 F"]
    assert one(clean.lookup_code("x"), ["ETF-069500", "abc", "12345678"]) == ["069500", "ABC", "12345678"]
    assert one(names.code_type("x"), ["069500", "0167A0"]) == ["krx_numeric", "naver_internal_unresolved"]


def test_dates_and_delay(one, spark):
    values = ["20260710", "2026-07-10", "2026-07-10T06:30:00Z", "2026-07-10T15:30:00+09:00", "soon", "-"]
    midnight = "2026-07-10T00:00:00+09:00"
    afternoon = "2026-07-10T15:30:00+09:00"
    assert one(clean.to_seoul_iso("x"), values) == [midnight, midnight, afternoon, afternoon, None, None]
    assert [str(d) if d else None for d in one(clean.to_date_only("x"), values[:3])] == ["2026-07-10"] * 3
    assert one(clean.epoch_ms_to_seoul_iso("x"), [0], "bigint") == ["1970-01-01T09:00:00+09:00"]
    now = F.lit("2026-07-10T00:10:29Z").cast("timestamp")
    stamps = F.col("x").cast("timestamp")
    assert one(clean.delay_minutes(stamps, now), ["2026-07-10T00:00:00Z", "2026-07-10T01:00:00Z"]) == [10, 0]
    assert one(clean.is_delayed(stamps, now, 15), ["2026-07-10T00:00:00Z", None]) == [False, False]


def test_session_zone_does_not_matter(spark, one):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(clean.to_seoul_iso("x"), ["2026-07-10T06:30:00Z"]) == ["2026-07-10T15:30:00+09:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rounding_is_half_up(one):
    assert one(clean.half_up("x"), [-2.5, 2.5, -0.4], "double") == [-2.0, 3.0, 0.0]
    assert one(clean.pct_change(F.lit(100000.0), "x"), [98000.0, 95000.0, 80000.0, 0.0, None], "double") == [
        2.04, 5.26, 25.0, None, None]
    assert one(clean.to_eok("x"), ["50000000000", "100,000,000", "-"]) == [500.0, 1.0, None]
    assert one(clean.clamp01("x"), [-1.0, 0.3, 7.0, float("nan"), None], "double") == [0.0, 0.3, 1.0, None, None]
    assert one(clean.sign_of("x"), [3.0, -2.0, 0.0, None], "double") == [1, -1, 0, None]


def test_exact_sum(spark):
    values = [0.1] * 10 + [-1.25, 1e12 + 0.37]
    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    total, mean = rows.agg(clean.exact_sum("x", 4), clean.exact_mean("x", 4)).first()
    assert total == 1000000000000.12
    assert mean == total / 12
    assert rows.where("x > 1e15").agg(clean.exact_sum("x", 4)).first()[0] is None

    def sums(values, scale):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(clean.exact_sum("x", scale), clean.exact_mean("x", scale)).first()

    nan = float("nan")
    assert sums([1e-5] * 1000, 5) == (0.01, 1e-5)
    assert sums([5e18, 5e18], 4) == (1e19, 5e18)
    assert sums([1e19], 4) == (1e19, 1e19)
    assert sums([nan, 2.0, float("inf"), None], 4) == (2.0, 2.0)
    assert sums([nan, None], 4) == (None, None)
    for values in ([1e-5], [1e30]):
        with pytest.raises(Exception, match="does not fit"):
            sums(values, 4)


def test_not_finite_is_missing(one):
    nan, inf = float("nan"), float("inf")
    assert one(clean.half_up("x", 2), [nan, inf, -inf, None, 2.675, 1e300], "double") == [None, None, None, None, 2.68, 1e300]
    assert one(clean.half_up("x"), [nan, -2.5, 1e19], "double") == [None, -2.0, 1e19]
    assert one(clean.pct_change("x", F.lit(2.0)), [nan, inf, None, 3.0], "double") == [None, None, None, 50.0]
    assert one(clean.pct_change(F.lit(3.0), "x"), [nan, inf, 0.0], "double") == [None, None, None]


def test_all_blanks(one):
    assert one(clean.clean_text("x"), ["\u3000a\u2003 b\ufeff", "\u2003-\u2003", "\u2028"]) == ["a b", None, None]
    assert one(clean.name_key("x"), ["A\u3000B\u202fC"]) == ["abc"]


def test_text_and_alias(one, spark):
    assert one(clean.clean_text("x"), [" a  \n b ", "-", None]) == ["a b", None, None]
    assert one(clean.name_key("x"), [" KODEX 200 ", None]) == ["kodex200", ""]
    rows = spark.createDataFrame([({"b": "2", "c": "3"},), ({"a": None, "b": "2"},), ({"z": "1"},)], "row map<string,string>")
    assert [r[0] for r in rows.select(clean.first_present("row", ["a", "b", "c"])).collect()] == ["2", None, None]


def test_asset_types(one):
    values = ["EQUITY", "보통주", "KODEX ETF형", "선물", "스왑", "회사채", "원화현금", "USD", "리츠", "수익증권", "파생", "x", None]
    assert one(names.asset_type("x"), values) == [
        "EQUITY", "EQUITY", "ETF", "FUTURE", "SWAP", "BOND", "CASH", "CURRENCY", "REIT", "FUND", "DERIVATIVE",
        "UNKNOWN", "UNKNOWN"]


def test_names(one):
    values = ["KODEX 인버스 2X", "TIGER 인버스", "KODEX 레버리지", "ACE 미국나스닥100", "200선물인버스2X레", None]
    assert one(names.leverage_label("x"), values) == ["-2X", "-1X", "2X", "ETF", "-2X", "ETF"]
    assert one(names.leverage_class("x"), values) == ["inv", "inv", "lev", "", "inv", ""]
    assert one(names.region_of("x"), values[:4]) == ["domestic", "domestic", "domestic", "overseas"]
    issuers = one(names.issuer_of(F.lit(None).cast("string"), "x"), ["KODEX 200", "ARIRANG 고배당", "", "SOL"])
    assert issuers == ["삼성자산운용", None, None, "신한자산운용"]
    hints = one(names.name_hints("x"), ["KODEX 코스닥150레버리지 1.5X(H)", "KODEX 200"])
    assert hints == [
        ["leverage=1.5X(명칭 표기)", "name_contains=레버리지", "name_contains=(H) 환헤지 표기"], []]
    assert one(names.pays_monthly("x"), ["매월 말일", "매 1, 2, 3월", "매 1,4,7,10월", None]) == [True, True, False, None]
    assert one(names.token_estimate("x"), [22, 23], "int") == [10, 11]


def test_display(one):
    assert one(display.signed_percent("x"), [1.234, -0.45, 0.0, None, float("nan")], "double") == [
        "+1.23%", "-0.45%", "0.00%", "정보 없음", "정보 없음"]
    assert one(display.krw_text("x"), [12345.0, 3420.0, 10000.0, None, -1.0], "double") == [
        "1조 2,345억원", "3,420억원", "1조원", "정보 없음", "정보 없음"]
    assert one(display.price_text("x"), [10250.0, None], "double") == ["10,250원", "정보 없음"]
    assert one(display.heat_bucket("x"), [0.0, 1.49, 1.5, -3.0, None], "double") == [
        "flat", "up-1", "up-2", "down-3", "flat"]
    assert one(display.bar_width("x", F.lit(50.0)), [50.0, 1.0, 25.0], "double") == [100.0, 4.0, 50.0]
    assert one(display.relative_size("x", F.lit(4.0)), [1.0, None], "double") == [0.25, 0.0]
    assert one(display.change_amount(F.lit(10000.0), "x"), [1.2], "double") == [120.0]


def test_exact_sum_of_many_sizes(spark):
    import random
    from decimal import Decimal
    from fractions import Fraction

    rng = random.Random(6)
    for scale in (0, 2, 4, 6):
        values = [float(Decimal(rng.randrange(-(10**k), 10**k)).scaleb(-scale)) for k in range(1, 20 - scale) for _ in range(40)]
        # Beyond 53 bits a double's shortest decimal is what counts.
        exact = float(sum(Fraction(Decimal(repr(v))) for v in values))
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double").repartition(7)
        assert df.agg(clean.exact_sum("x", scale)).first()[0] == exact
    assert spark.createDataFrame([(None,)], "x double").agg(clean.exact_sum("x", 4)).first()[0] is None
    assert spark.createDataFrame([(-0.25,), (0.25,)], "x double").agg(clean.exact_sum("x", 2)).first()[0] == 0.0
    tiny = spark.range(1000).select(F.lit(1e-10).alias("x"))
    with pytest.raises(Exception, match="does not fit"):
        tiny.agg(clean.exact_sum("x", 4)).collect()
    near = spark.createDataFrame([(0.1 + 0.2,)], "x double")
    assert near.agg(clean.exact_sum("x", 4)).first()[0] == 0.3
