"""Bars, quotes, universe, themes and rankings."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from fundlens.operators import bars, ordering, screen, universe
from fundlens.storage import scratch_root

BAR = "code string, ts timestamp, o double, h double, l double, c double, v double, ord long"


def day(n):
    return dt.datetime(2026, 7, 31) - dt.timedelta(days=n)


def history(closes, volumes=None, code="069500"):
    return [
        (code, day(i), c, c, c, c, (volumes or {}).get(i, 1e6), i) for i, c in enumerate(closes)
    ]


def test_quotes_from_daily_bars(spark):
    closes = [90000.0] * 22
    closes[0], closes[1], closes[5], closes[20] = 100000.0, 98000.0, 95000.0, 80000.0
    rows = history(closes, {0: 12e6, 1: 1e7})
    q = bars.quotes(spark.createDataFrame(rows, BAR)).first()
    assert (q.price, q.change_rate, q.return_1w, q.return_1m) == (100000.0, 2.04, 5.26, 25.0)
    assert (q.trading_value, q.trading_value_change_rate) == (12000.0, 22.45)


def test_quotes_fall_back_to_the_oldest_bar_and_need_a_price(spark):
    table = spark.createDataFrame(history([99000.0, 95000.0]) + history([5.0], code="000001"), BAR)
    prices = spark.createDataFrame(
        [("069500", 100000.0, day(0)), ("999999", None, None), ("000001", 10.0, day(0))],
        "code string, price double, ts timestamp",
    )
    q = {r.code: r for r in bars.quotes(table, prices).collect()}
    assert (q["069500"].change_rate, q["069500"].return_1m) == (5.26, 5.26)
    assert q["999999"].price is None and q["999999"].change_rate is None
    assert q["000001"].change_rate == 100.0
    assert q["000001"].trading_value_change_rate is None


def test_bar_windows(spark):
    rows = history([float(c) for c in (5, 4, 3, 2, 1)]) + [("069500", day(2), 9.0, 9.0, 9.0, 9.0, 1.0, 99)]
    table = spark.createDataFrame(rows, BAR)
    last = bars.last_bars(table, 3, ordinal="ord").orderBy("position").collect()
    assert [(r.c, r.position) for r in last] == [(3.0, 1), (4.0, 2), (5.0, 3)]
    clean = spark.createDataFrame(history([float(c) for c in (5, 4, 3, 2, 1)]), BAR)
    assert [r.c for r in bars.downsample(clean, 3).orderBy("ts").collect()] == [1.0, 4.0, 5.0]
    assert [r.cum_return for r in bars.cumulative_return(clean).orderBy("ts").collect()] == [0.0, 100.0, 200.0, 300.0, 400.0]
    assert [r.scaled for r in bars.scaled(clean).orderBy("ts").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert bars.period_return(clean, "1W").first().period_return == 400.0
    with pytest.raises(ValueError):
        bars.last_bars(clean, 1)
    with pytest.raises(ValueError):
        bars.period_return(clean, "2Y")


ETF = (
    "ord long, id string, code string, name string, theme_id string, current_price double, change_rate_1d double, "
    "return_1w double, return_1m double, trading_value double, trading_value_change_rate double, "
    "volatility_score double, net_assets double, total_fee double"
)


def etf(ord, id, name, rate, value, volume=1.0, volatility=1.0, theme="theme-semi", code="111111"):
    return (ord, id, code, name, theme, 1.0, rate, 1.0, 1.0, value, volume, volatility, 10.0, 0.1)


def test_ranking_ties_nulls_and_duplicates(spark):
    table = spark.createDataFrame(
        [
            etf(0, "tie-a", "Beta Tie", 1.0, 100.0),
            etf(1, "tie-b", "Alpha Tie", 1.0, 100.0),
            etf(2, "tie-c", "Aardvark Tie", 1.0, None),
            etf(3, "none", "No rate", None, 100.0),
            etf(4, "tie-a", "Beta Tie", 9.0, 100.0),
            etf(5, "low", "Low", -3.0, 1.0),
        ],
        ETF,
    )

    def ids(tab, **kw):
        return [r.id for r in screen.ranked(table, tab, **kw).orderBy("rank").collect()]

    assert ids("gainers") == ["tie-b", "tie-a", "tie-c", "low"]
    assert ids("losers") == ["low", "tie-b", "tie-a", "tie-c"]
    assert ids("gainers", limit=2) == ["tie-b", "tie-a"]
    with pytest.raises(ValueError, match="unknown ranking tab"):
        screen.ranked(table, "bad")


THEME = (
    "ord long, id string, name string, return_1d double, return_1w double, return_1m double, "
    "trading_value double, trading_value_change_rate double"
)
THEMES = [
    (0, "theme-semi", "Semi", 3.0, 1.0, 7.0, 100.0, 0.0),
    (1, "theme-ai", "AI", 3.0, 4.0, -1.0, 100.0, 0.0),
    (2, "theme-car", "Car", -2.0, -3.0, 9.0, 50.0, 0.0),
]


def test_theme_views(spark):
    themes = spark.createDataFrame(THEMES, THEME)
    heat = screen.heatmap(themes, "1d").orderBy("position").collect()
    assert [(r.theme_id, r.return_rate, r.size_class, r.tone) for r in heat] == [
        ("theme-ai", 3.0, "lg", "up-3"), ("theme-semi", 3.0, "lg", "up-3"), ("theme-car", -2.0, "md", "down-2")]
    assert [r.relative_size for r in heat] == [1.0, 1.0, 0.5]
    assert tuple(screen.extremes(themes, "1d").first()) == ("theme-ai", "theme-car")
    assert screen.extremes(themes, "1m").first().weakest_id == "theme-ai"
    assert tuple(screen.extremes(themes.limit(0), "1d").first()) == (None, None)
    with pytest.raises(ValueError, match="unknown period"):
        screen.heatmap(themes, "1y")


def test_rollup_and_breadth(spark):
    themes = spark.createDataFrame(THEMES, THEME)
    members = spark.createDataFrame(
        [etf(0, "a", "A", 1.0, 10.4), etf(1, "b", "B", 2.01, 10.2), etf(2, "c", "C", None, None),
         etf(3, "d", "D", -1.0, None, theme="theme-ai")],
        ETF,
    )
    rolled = {r.id: r for r in universe.theme_rollup(themes, members).collect()}
    assert rolled["theme-semi"].return_1d == 1.51  # mean 1.505 rounds half up
    assert rolled["theme-semi"].trading_value == 21.0
    assert (rolled["theme-ai"].return_1d, rolled["theme-ai"].trading_value) == (-1.0, 100.0)
    assert rolled["theme-car"].return_1d == -2.0
    summary = universe.breadth(members, themes).first()
    assert (summary.advancers, summary.decliners, summary.unchanged) == (2, 1, 1)
    # equal returns: the first theme of the table stays
    assert (summary.strongest_theme_id, summary.weakest_theme_id) == ("theme-semi", "theme-car")


def test_universe_merge_and_overlays(spark):
    curated = spark.createDataFrame(
        [etf(0, "etf-001", "KODEX 200", 1.0, 5.0, code="069500")], ETF
    )
    snapshot = spark.createDataFrame(
        [("069500", "KODEX 200", 10000.0, 1.01, 1.0, 500.0, 10001.0, None, "idx"),
         ("900001", "새 ETF A", 10000.0, 1.01, 1.0, 500.0, 10001.0, 500.0, "idx"),
         ("900002", "새 ETF B", 0.0, 1.01, 1.0, 500.0, 10001.0, 500.0, "")],
        "code string, name string, prev_close double, change_rate double, trading_value double, "
        "net_assets double, nav double, market_cap double, index_name string",
    )
    merged = universe.merge_universe(curated, snapshot)
    rows = {r.code: r for r in merged.collect()}
    assert len(rows) == 3
    assert (rows["069500"].net_assets, rows["069500"].theme_id, rows["069500"].market_cap) == (500.0, "theme-semi", None)
    thin = rows["900001"]
    assert (thin.id, thin.theme_id, thin.current_price, thin.is_curated) == ("etf-900001", None, 10000.0, False)
    prices = spark.createDataFrame([("900001", 10200.0), ("900002", 5.0)], "code string, price double")
    live = {r.code: r for r in universe.overlay_thin(merged.where("not is_curated"), prices).collect()}
    assert (live["900001"].current_price, live["900001"].change_rate_1d) == (10200.0, 2.0)
    assert live["900002"].change_rate_1d == 1.01  # no previous close to compare with
    quotes = spark.createDataFrame(
        [("069500", None, 3.0, None, None, float("nan"), None)],
        "code string, price double, change_rate double, return_1w double, return_1m double, "
        "trading_value double, trading_value_change_rate double",
    )
    q = universe.overlay(curated, quotes).first()
    assert (q.current_price, q.change_rate_1d, q.trading_value) == (1.0, 3.0, 5.0)
    assert tuple(universe.overlay_stats(curated, quotes).first()) == (1, 1, 0)
    parts = universe.overlay(merged.where("is_curated"), quotes).unionByName(
        universe.overlay_thin(merged.where("not is_curated"), prices)
    )
    at_once = universe.overlay_universe(merged, quotes, prices)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, parts.collect()))


def test_master_list(spark):
    items = spark.createDataFrame(
        [(0, " 069500", "A"), (1, "0167a0", "B"), (2, "069500", "C")], "ord long, item_code string, item_name string"
    )
    rows = universe.master_list(items).orderBy("ord").collect()
    assert [(r.etf_code, r.name, r.code_type) for r in rows] == [
        ("069500", "A", "krx_numeric"), ("0167A0", "B", "naver_internal_unresolved")]
    assert tuple(universe.master_counts(items).first()) == (2, 1, 1, 1)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_with_a_hot_group(spark, coalesce):
    """One group with most of the rows: positions are right and its rows spread over partitions."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, coalesce)
    try:
        check_positions(spark, spread=coalesce == "false")
    finally:
        spark.conf.set(setting, "true")


def check_positions(spark, spread):
    rows = spark.range(0, 20000, numPartitions=6).select(
        F.when(F.col("id") < 15000, "hot").otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(50)))).alias("k"),
        F.pmod(F.hash("id"), F.lit(100)).alias("v"),
        "id",
    )
    placed = ordering.with_position(rows, [F.col("v").desc(), F.col("id").asc()], by=["k"])
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, -r.v, r.id)):
        expected.setdefault(r.k, []).append(r.id)
    got = {}
    for r in placed.orderBy("k", "position").collect():
        assert r.position == len(got.setdefault(r.k, [])) + 1
        got[r.k].append(r.id)
    assert got == expected
    whole = ordering.with_position(rows, [F.col("id").desc()]).orderBy("position").collect()
    assert [(r.position, r.id) for r in whole] == [(i + 1, 19999 - i) for i in range(20000)]
    if spread:
        newest = max(pathlib.Path(scratch_root(spark).removeprefix("file:")).glob("fundlens-sorted-*"), key=lambda p: p.stat().st_mtime)
        assert len(list(newest.glob("part-*"))) > 4


def test_top_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(100).select(F.pmod("id", F.lit(3)).alias("k"), "id")
    plan = ordering.top_per_key(rows, "k", [F.col("id").asc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final
