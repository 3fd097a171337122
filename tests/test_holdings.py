"""Holdings, screens over them, quality checks and resolution."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundlens.operators import content, holdings, quality, resolve, screen

ROW = "etf_code string, provider string, pos int, row map<string,string>"
EDGES = "ord long, etf_id string, stock_id string, weight double, rank int"
STOCKS = "ord long, id string, code string, name string"
FUNDS = (
    "ord long, id string, code string, name string, theme_id string, trading_value double, net_assets double, "
    "total_fee double, return_1m double"
)


@pytest.fixture
def funds(spark):
    return spark.createDataFrame(
        [
            (0, "etf-a", "111111", "Alpha ETF", "theme-semi", 3000.0, 12000.0, 0.12, 7.5),
            (1, "etf-b", "222222", "Beta ETF", "theme-semi", 9000.0, 5000.0, 0.2, 1.2),
            (2, "etf-c", "333333", "Gamma ETF", "theme-ai", 1000.0, 8000.0, 0.15, 4.4),
            (3, "etf-a", "111111", "Alpha ETF", "theme-semi", 3000.0, 12000.0, 0.12, 7.5),
        ],
        FUNDS,
    )


@pytest.fixture
def edges(spark):
    rows = [
        ("etf-a", "samsung", 20.0, 1), ("etf-a", "hynix", 10.0, 2), ("etf-a", "naver", 5.0, 3),
        ("etf-b", "hynix", 35.0, 1), ("etf-b", "samsung", 35.0, 2), ("etf-c", "naver", 9.0, 1),
        ("missing", "samsung", 90.0, 1), ("etf-b", "samsung", 1.0, 9),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDGES)


@pytest.fixture
def stocks(spark):
    return spark.createDataFrame(
        [(0, "samsung", "005930", "삼성전자"), (1, "hynix", "000660", "SK하이닉스"), (2, "naver", "035420", "NAVER")],
        STOCKS,
    )


def test_reverse_lookup(funds, edges):
    rows = screen.funds_by_stock(funds, edges, "samsung").orderBy("position").collect()
    assert [(r.etf_id, r.weight, r.rank) for r in rows] == [("etf-b", 35.0, 2), ("etf-a", 20.0, 1)]
    assert screen.funds_by_stock(funds, edges, "nobody").count() == 0
    everything = screen.with_bars(screen.funds_by_stock(funds, edges))
    assert everything.count() == 6
    assert everything.where("stock_id = 'samsung' and etf_id = 'etf-a'").first().bar_width == 57.0


def test_comparison(funds, edges, stocks):
    distinct = edges.where("ord < 7")
    got = screen.compare(funds, distinct, stocks, ["etf-b", "missing", "etf-a", "etf-b", "etf-c"])
    rows = got.orderBy("position").collect()
    assert [(r.etf_id, r.top_holding_names, r.top2_concentration) for r in rows] == [
        ("etf-b", ["SK하이닉스", "삼성전자"], 70.0),
        ("etf-a", ["삼성전자", "SK하이닉스", "NAVER"], 30.0),
        ("etf-c", ["NAVER"], None),
    ]
    assert screen.compare(funds, distinct, stocks).count() == 3


def test_search_theme_and_chips(spark, funds, stocks):
    themes = spark.createDataFrame([(0, "theme-semi", "반도체")], "ord long, id string, name string")

    def found(query):
        return {(r.kind, r.id) for r in screen.search(funds, stocks, themes, query).collect()}

    assert found("   ") == set() and screen.is_empty_query("  ")
    assert found(" alpha ") == {("etf", "etf-a")}
    assert found("전자") == {("stock", "samsung")}
    assert found("005930") == {("stock", "samsung")}
    assert found("반도") == {("theme", "theme-semi")}
    assert [r.id for r in screen.by_theme(funds, "theme-semi").orderBy("ord").collect()] == ["etf-a", "etf-b"]
    assert screen.by_theme(funds, "").count() == 0
    named = spark.createDataFrame([("a", "KODEX ai전력"), ("b", "TIGER 은행")], "code string, name string")
    assert [r.code for r in screen.by_chip(named, "AI전력/인프라").collect()] == ["a"]
    assert [r.code for r in screen.by_chip(named, "tiger").collect()] == ["b"]
    assert {(r.chip, r.code) for r in screen.chip_members(named).collect()} == {("AI전력/인프라", "a"), ("금융", "b")}
    page = screen.explore(funds.dropDuplicates(["id"]), sort="trading_value", limit=2).orderBy("position")
    assert [r.id for r in page.collect()] == ["etf-b", "etf-a"]
    assert screen.watchlist(funds, ["222222"]).count() == 1
    with pytest.raises(ValueError):
        screen.explore(funds, sort="name")


def test_content(spark, funds):
    items = spark.createDataFrame(
        [("c", "news", "s3", dt.datetime(2026, 7, 1), ["etf-a", "etf-a"]),
         ("a", "news", "s1", dt.datetime(2026, 7, 2), ["etf-b"]),
         ("b", "news", "s2", dt.datetime(2026, 7, 1), ["etf-a", "etf-b"]),
         ("d", "disclosure", "s4", dt.datetime(2026, 7, 3), ["etf-c"])],
        "id string, type string, summary string, published_at timestamp, related_etf_ids array<string>",
    )
    feed = content.content_feed(items, "news").orderBy("position").collect()
    assert [r.id for r in feed] == ["a", "b", "c"]
    assert {(r.etf_id, r.summary) for r in content.first_news(items).collect()} == {("etf-a", "s2"), ("etf-b", "s1")}
    assert content.content_by_fund(items, funds).count() == 5
    assert [r.content_id for r in content.content_by_fund(items, funds, "333333").collect()] == ["d"]
    with pytest.raises(ValueError):
        content.content_feed(items, "video")


def test_representatives(spark, funds, stocks):
    themes = spark.createDataFrame(
        [("theme-semi", ["etf-b", "gone", "etf-a"], ["hynix"])],
        "id string, representative_etf_ids array<string>, representative_stock_ids array<string>",
    )
    rows = screen.representatives(themes, funds, stocks).orderBy("kind", "place").collect()
    assert [(r.kind, r.name) for r in rows] == [("etf", "Beta ETF"), ("etf", "Alpha ETF"), ("stock", "SK하이닉스")]


def test_normalization(spark):
    raw = spark.createDataFrame(
        [
            ("1", "P", 0, {"종목코드": "5930", "종목명": " 삼성전자 ", "유형": "주식", "비중": "30.5", "수량": "1,250,000", "순위": "1"}),
            ("1", "P", 1, {"assetCode": "AAPL", "assetName": "Apple", "type": "EQUITY", "weight": "0", "currency": "USD"}),
            ("1", "P", 2, {"종목코드": "K2F", "종목명": "코스피200선물", "유형": "선물", "계약수": "1,200", "수량": None, "비중": "-"}),
        ],
        ROW,
    )
    a, b, c = holdings.normalize_rows(raw).orderBy("pos").collect()
    assert (a.asset_code, a.asset_name, a.asset_type, a.weight_pct, a.quantity, a.rank, a.raw_asset_code) == (
        "005930", "삼성전자", "EQUITY", 30.5, 1250000.0, 1, "5930")
    assert (b.asset_code, b.currency, b.weight_pct, b.rank) == ("AAPL", "USD", 0.0, 2)
    assert (c.asset_type, c.contract_count, c.quantity, c.weight_pct, c.rank) == ("FUTURE", 1200.0, None, None, 3)
    wide = spark.createDataFrame([("1", 0, "5930", "x", "12%")], "etf_code string, pos int, `종목코드` string, `종목명` string, `비중` string")
    w = holdings.normalize_columns(wide).first()
    assert (w.asset_code, w.weight_pct, w.rank, w.asset_type) == ("005930", 12.0, 1, "UNKNOWN")


HOLDING = "etf_code string, asset_code string, asset_name string, asset_type string, weight_pct double"


def business(spark, rows):
    table = spark.createDataFrame([("069500", *r) for r in rows], HOLDING)
    documents = spark.createDataFrame([("069500", dt.date(2026, 7, 13), "MOCK")], "etf_code string, base_date date, provider string")
    return quality.check_business(documents, table, ["etf_code"]).first()


def test_business_check(spark):
    ok = business(spark, [("005930", "삼성전자", "EQUITY", 60.0), ("000660", "SK하이닉스", "EQUITY", 40.0)])
    assert (ok.business_status, ok.business_errors, ok.business_warnings) == ("OK", [], [])
    assert business(spark, []).business_status == "EMPTY"
    assert business(spark, []).business_errors == ["holdings:empty"]
    blank = business(spark, [("1", "a", "EQUITY", None), ("2", "b", "EQUITY", None)])
    assert (blank.business_status, blank.business_errors) == ("WEIGHT_MISSING", [])
    partial = business(spark, [("1", "a", "EQUITY", 50.0), ("2", "b", "EQUITY", None)])
    assert partial.business_status == "PARTIAL" and "weight:some_blank" in partial.business_warnings
    leveraged = business(spark, [("K2F", "선물", "FUTURE", -100.0), ("KRW", "현금", "CASH", 220.0), ("KRW", "현금", "CASH", 0.0)])
    assert leveraged.business_errors == []
    assert leveraged.business_warnings == ["weight:negative", "asset:repeated", "weight:sum_off"]
    bad = business(spark, [("1", "a", "EQUITY", float("inf")), ("2", "b", "EQUITY", float("nan"))])
    assert bad.business_errors == ["weight:not_finite"]


def attempts_and_rows(spark, outcomes):
    """One document; per provider either a failed fetch status or rows of (code, name, weight)."""
    attempts, rows = [], []
    for listed, (provider, what) in enumerate(outcomes):
        fetched = isinstance(what, list)
        attempts.append(("069500", dt.date(2026, 7, 13), provider, listed, "OK" if fetched else what))
        rows += [("069500", provider, c, n, "EQUITY", w) for c, n, w in what] if fetched else []
    a = spark.createDataFrame(attempts, "etf_code string, base_date date, provider string, listed int, fetch_status string")
    r = spark.createDataFrame(rows, "etf_code string, provider string, asset_code string, asset_name string, asset_type string, weight_pct double")
    return a, r


GOOD = [("005930", "삼성전자", 60.0), ("000660", "SK하이닉스", 40.0)]


def resolved(spark, *outcomes):
    a, r = attempts_and_rows(spark, outcomes)
    return resolve.resolve_holdings(resolve.check_attempts(a, r, ["etf_code"]), ["etf_code"])


def test_provider_fallback(spark):
    first = resolved(spark, ("PYKRX", GOOD), ("KRX_DIRECT", GOOD)).first()
    assert (first.provider, first.is_fallback, first.status, first.attempted_providers) == ("PYKRX", False, "OK", ["PYKRX"])
    second = resolved(spark, ("PYKRX", "NOT_IMPLEMENTED"), ("KRX_DIRECT", GOOD)).first()
    assert (second.provider, second.is_fallback, second.total_count) == ("KRX_DIRECT", True, 2)
    assert [tuple(f) for f in second.provider_failures] == [("PYKRX", "NOT_IMPLEMENTED")]
    ordered = resolved(spark, ("ISSUER", "NOT_IMPLEMENTED"), ("SEIBRO", GOOD), ("PYKRX", "NOT_IMPLEMENTED")).first()
    assert (ordered.provider, ordered.attempted_providers) == ("SEIBRO", ["PYKRX", "SEIBRO"])
    none = resolved(spark, ("PYKRX", "NOT_IMPLEMENTED"), ("KRX_DIRECT", "REQUEST_FAILED")).first()
    assert (none.status, none.total_count, len(none.provider_failures)) == ("UNRESOLVED", 0, 2)
    assert none.attempted_providers == ["PYKRX", "KRX_DIRECT"] and not none.is_fallback
    misshapen = resolved(spark, ("PYKRX", [("005930", None, 50.0)]), ("KRX_DIRECT", GOOD))
    assert misshapen.first().provider == "KRX_DIRECT"
    assert tuple(resolve.diagnostics(misshapen, ["etf_code"]).first()) == ("069500", 0, "PYKRX", "INVALID_SCHEMA")
    unlisted = resolved(spark, ("MOCK", GOOD), ("ISSUER", "EMPTY")).first()
    assert unlisted.attempted_providers == ["ISSUER", "MOCK"]
    status = resolve.collection_status(resolved(spark, ("MOCK", GOOD)), ["etf_code"]).first()
    assert (status.is_resolved, status.attempted_providers) == (True, "MOCK")


def test_document_shape(spark):
    documents = spark.createDataFrame(
        [("1.0.0", "069500", "x", "2026-07-13", "MOCK", None), ("1", "12", "", None, "OTHER", "x")],
        "schema_version string, etf_code string, etf_name string, base_date string, provider string, source_type string",
    )
    good, bad = quality.check_document_shape(documents).collect()
    assert good.document_errors == []
    assert bad.document_errors == [
        "schema_version:pattern", "etf_code:pattern", "etf_name:missing", "base_date:pattern", "provider:enum", "source_type:enum"]


@pytest.mark.parametrize(
    "requested, anchor, days, lookback, expected",
    [
        ("2026-07-10", None, ["2026-07-10"], None, ("2026-07-10", 0, "EXACT")),
        ("2026-07-11", None, ["2026-07-08", "2026-07-01"], None, ("2026-07-08", 3, "RESOLVED_PRIOR")),
        ("2026-07-11", None, [], None, (None, 7, "UNRESOLVED")),
        ("2026-07-11", None, ["2026-07-08"], 2, (None, 2, "UNRESOLVED")),
        ("2026-07-11", None, ["2026-07-12"], None, (None, 7, "UNRESOLVED")),
        (None, "2026-07-10", ["2026-07-10"], None, ("2026-07-10", 0, "EXACT")),
    ],
)
def test_base_dates(spark, requested, anchor, days, lookback, expected):
    parse = lambda d: dt.date.fromisoformat(d) if d else None
    requests = spark.createDataFrame(
        [("069500", parse(requested), parse(anchor), lookback)],
        "etf_code string, requested_date date, anchor_date date, lookback_days int",
    )
    available = spark.createDataFrame([("069500", parse(d)) for d in days] + [("000001", parse("2026-07-11"))], "etf_code string, date date")
    got = resolve.resolve_base_date(requests, available).first()
    assert (str(got.resolved_base_date) if got.resolved_base_date else None, got.lookback_days, got.date_status) == expected
    assert got.requested_date == parse(requested)


def test_base_dates_of_any_look_back_in_one_table(spark):
    day = dt.date(2026, 7, 1)
    requests = spark.createDataFrame(
        [("1", day, 30, True), ("1", day, 400, None), ("1", day, 0, True), ("1", day, None, True), ("1", day, 9, False), (None, day, 5, True), ("2", None, 1, True)],
        "etf_code string, requested_date date, lookback_days int, attempted boolean",
    )
    available = spark.createDataFrame(
        [("1", dt.date(2026, 6, 5)), ("1", dt.date(2026, 6, 5)), ("1", None), (None, day), ("2", dt.date(1999, 1, 1))], "etf_code string, date date"
    )
    got = resolve.resolve_base_date(requests.repartition(5), available, today=F.lit(dt.date(1999, 1, 2)))
    assert sorted((r.etf_code or "", str(r.resolved_base_date), r.lookback_days or 0, r.date_status) for r in got.collect()) == [
        ("", "None", 5, "UNRESOLVED"), ("1", "2026-06-05", 26, "RESOLVED_PRIOR"), ("1", "2026-06-05", 26, "RESOLVED_PRIOR"),
        ("1", "None", 0, "NOT_ATTEMPTED"), ("1", "None", 0, "UNRESOLVED"), ("1", "None", 7, "UNRESOLVED"), ("2", "1999-01-01", 1, "RESOLVED_PRIOR")]


def test_base_dates_copy_no_date(spark, monkeypatch):
    """What is written has one row per fund and day, whatever the look-back."""
    written = []
    real = resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, label: written.append(real(df, label)) or written[-1])
    requests = spark.createDataFrame([("1", dt.date(2026, 7, d % 20 + 1), 4000) for d in range(500)], "etf_code string, requested_date date, lookback_days int")
    available = spark.createDataFrame([("1", dt.date(2020, 1, d + 1)) for d in range(30)], "etf_code string, date date")
    got = resolve.resolve_base_date(requests, available)
    assert written[0].count() == 50 and {str(r.resolved_base_date) for r in got.collect()} == {"2020-01-30"}


def _documents(spark):
    """Three documents: settled by the first provider, by the second, by none; and one of an unlisted provider."""
    attempts = spark.createDataFrame(
        [(d, p, i) for d in ("000001", "000002", "000003", "000004") for i, p in enumerate(["MOCK", "SEIBRO", "PYKRX", "KRX_DIRECT"])],
        "etf_code string, provider string, listed int",
    )
    rows = []
    for p in ("PYKRX", "KRX_DIRECT", "SEIBRO", "MOCK"):
        rows.append(("000001", p, "000660", "a", "50"))
        if p != "PYKRX":
            rows.append(("000002", p, "000660", "a", "60"))
        if p == "MOCK":
            rows.append(("000004", p, "000660", "a", "1"))
        else:
            rows.append(("000004", p, "000660", None, "1"))
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "etf_code string, provider string, code string, name string, weight string, pos int")
    return attempts, raw


def test_rounds_agree_with_judging_everything(spark):
    attempts, raw = _documents(spark)
    whole = resolve.resolve_holdings(resolve.check_attempts(attempts, holdings.normalize_columns(raw), ["etf_code"]), ["etf_code"])
    rounds = resolve.resolve_in_rounds(attempts, raw, holdings.normalize_columns, ["etf_code"])
    assert sorted(rounds.collect(), key=str) == sorted(whole.collect(), key=str)
    found = {r.etf_code: (r.provider, r.status, r.is_fallback) for r in rounds.collect()}
    assert found == {
        "000001": ("PYKRX", "OK", False), "000002": ("KRX_DIRECT", "OK", True),
        "000003": ("MOCK", "UNRESOLVED", False), "000004": ("MOCK", "OK", True)}
    won = resolve.winning_rows(rounds, raw, ["etf_code"])
    assert sorted((r.etf_code, r.provider) for r in won.collect()) == [("000001", "PYKRX"), ("000002", "KRX_DIRECT"), ("000004", "MOCK")]


def test_later_rounds_normalize_open_documents_only(spark):
    attempts, raw = _documents(spark)
    seen = []

    def counted(rows):
        seen.append(sorted(r.etf_code for r in rows.collect()))
        return holdings.normalize_columns(rows)

    resolve.resolve_in_rounds(attempts, raw, counted, ["etf_code"]).collect()
    assert seen == [["000001", "000004"], ["000002", "000004"], ["000004"], ["000004"]]


def test_no_attempts(spark):
    attempts, raw = _documents(spark)
    assert resolve.resolve_in_rounds(attempts.limit(0), raw, holdings.normalize_columns, ["etf_code"]).collect() == []


def test_capability_modes(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    live = spark.createDataFrame([("a", 1.0)], "code string, price double")
    mock = spark.createDataFrame([("a", 9.0), ("b", 9.0)], "code string, price double")

    def run(mode):
        rows = resolve.resolve_capability(keys, [("live", live)], mock, mode)
        return {r.code: (r.price, r.source, r.is_fallback, r.status) for r in rows.collect()}

    assert run("hybrid") == {"a": (1.0, "live", False, "ok"), "b": (9.0, "mock", True, "ok"), "c": (None, "none", False, "unavailable")}
    assert run("live")["b"] == (None, "none", False, "unavailable")
    assert run("mock")["a"] == (9.0, "mock", False, "ok")
    with pytest.raises(ValueError):
        run("other")


def test_priority_choice_backfill_and_conflicts(spark):
    values = spark.createDataFrame(
        [("1", "name", "A", "master", 50, dt.date(2026, 7, 9)), ("1", "name", "B", "detail", 100, dt.date(2026, 7, 1)),
         ("1", "issuer", None, "detail", 100, None)],
        "etf_code string, field string, value string, source_id string, priority int, as_of date",
    )
    assert [r.value for r in resolve.pick_by_priority(values).collect()] == ["B"]
    assert [r.value for r in resolve.pick_by_priority(values, recency=("name",)).collect()] == ["A"]
    schema = "etf_code string, rank int, name string, code string, ord int"
    a = spark.createDataFrame([("1", 1, "x", None, 0), ("1", 2, "y", None, 1), ("2", 1, "x", None, 2)], schema)
    b = spark.createDataFrame([("1", 1, "y", "c1", 0), ("1", 2, "x", "c2", 1), ("1", 3, "x", "c3", 2), ("3", 1, "z", "c4", 3)], schema)
    chosen = resolve.choose_holdings(a, b, ("detail", "file"))
    assert {(r.etf_code, r.holdings_source) for r in chosen.collect()} == {("1", "detail"), ("2", "detail"), ("3", "file")}
    filled = {(r.etf_code, r.name): r.code for r in holdings.backfill_codes(a.drop("ord"), b).collect()}
    assert filled == {("1", "x"): "c3", ("1", "y"): "c1", ("2", "x"): None}
    found = resolve.conflicts(a, b, ("detail", "file")).collect()
    assert [(r.etf_code, r.selected_count, r.other_count, r.differing_places) for r in found] == [("1", 2, 3, 3)]
    assert resolve.conflicts(a, a, ("detail", "file")).count() == 0


def test_holdings_groups(spark):
    rows = spark.createDataFrame(
        [(0, "069500", "KODEX", 5, "1", "a", 1.004, "OK"), (1, "069500", "KODEX", 1, "2", "b", 9.0, "OK"),
         (2, "069500", "KODEX", 1, "3", "", 9.0, "OK"), (3, "1", "x", 1, "3", "c", None, "OK"),
         (4, "2", "x", 1, "3", "c", 1.0, "EMPTY_NO_TABLE")],
        "ord int, etf_code string, etf_name string, rank int, holding_code string, holding_name string, weight double, status string",
    )
    groups = holdings.build_groups(rows).orderBy("rank").collect()
    assert [(r.holding_name, r.weight, r.rank) for r in groups] == [("b", 9.0, 1), ("a", 1.0, 2)]
    assert tuple(holdings.group_counts(rows).first()) == (2, 3, 1)


def test_integrity_checks(spark, funds, edges, stocks):
    assert [tuple(r) for r in quality.fk_violations(edges, "etf_id", funds, "id").collect()] == [("missing", 1)]
    assert [tuple(r) for r in quality.duplicates(edges, ["etf_id", "stock_id"]).collect()] == [("etf-b", "samsung", 2)]
    assert quality.weight_violations(edges.withColumn("weight", F.col("weight") - 5)).count() == 2
    summary = spark.createDataFrame(
        [("1d", 1, 2, 3, 2.0, 1.0), ("1w", 1, 2, 4, 1.0, 2.0)],
        "period string, advancers int, decliners int, unchanged int, strongest_return double, weakest_return double",
    )
    bad = quality.breadth_violations(summary, 6).collect()
    assert [(r.period, r.violations) for r in bad] == [("1w", ["counts", "extremes"])]
    derived = holdings.holding_ids(edges.where("ord < 7"))
    assert [r.stock_id for r in derived.where("etf_id = 'etf-b'").orderBy("place").collect()] == ["hynix", "samsung"]
    found = quality.array_mismatch(derived.where("place <= 2"), derived).collect()
    assert [(r.etf_id, r.differing_places) for r in found] == [("etf-a", derived.where("etf_id = 'etf-a' and place > 2").count())]
    related = holdings.related_funds(edges).where("stock_id = 'samsung'").orderBy("position")
    assert [r.etf_id for r in related.collect()] == ["etf-a", "etf-b", "missing"]
    texts = spark.createDataFrame([(1, "오늘의 추천 ETF 목록"), (2, "사실만 적음")], "id int, text string")
    assert [tuple(r) for r in quality.phrase_hits(texts, "id", "text").collect()] == [(1, "추천 ETF")]
    codes = spark.createDataFrame([("0104N0",), ("1040",), ("5930",)], "code string")
    assert [(r.padded, r.raw_codes) for r in quality.code_collisions(codes, "code").collect()] == [("001040", 2)]


def test_statuses(spark):
    states = spark.createDataFrame(
        [("a", "ok"), ("a", "stale"), ("b", "unavailable"), ("b", None), ("c", "ok"), ("c", "partial"), ("d", "ok")],
        "k string, status string",
    )
    assert {r.k: r.status for r in quality.combine_status(states, ["k"]).collect()} == {
        "a": "stale", "b": "unavailable", "c": "partial", "d": "ok"}
    rolled = spark.createDataFrame([("x", "OK"), ("x", "EMPTY"), ("y", "PARTIAL")], "g string, status string")
    got = {r.group_name: (r.success_pct, r.passes_gate) for r in quality.status_rollup(rolled, "g").collect()}
    assert got == {"x": (50.0, False), "y": (100.0, True), "ALL": (66.67, False)}
