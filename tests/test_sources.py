"""Readers, sinks and streams over temporary files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fundlens import storage
from fundlens.operators import holdings
from fundlens.sources import readers, sinks, upserts
from fundlens.streaming import ticks as stream_ops

CSV = (
    "﻿etfCode,etfName,rank,holdingCode,holdingName,quantity,weightPct,status\n"
    '69500,"KODEX ""200"", plus",1,5930,삼성전자,"6,978",30.5%,OK\n'
    "0167a0,새 상품,,,,,,EMPTY_NO_TABLE\n"
)


def test_holdings_csv(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text(CSV, encoding="utf-8")
    rows = readers.read_holdings_csv(spark, str(path)).collect()
    first = rows[0]
    assert (first.etf_code, first.etf_name, first.rank, first.holding_code, first.quantity, first.weight) == (
        "069500", 'KODEX "200", plus', 1, "005930", 6978.0, 30.5)
    assert rows[1].etf_code == "001670" and rows[1].weight is None
    kept = readers.read_holdings_csv(spark, str(path), keep_codes=True).collect()
    assert [r.etf_code for r in kept] == ["69500", "0167A0"]
    numbered = readers.with_ordinal(readers.read_holdings_csv(spark, str(path)))
    assert [r.etf_name for r in holdings.build_groups(numbered).collect()] == ['KODEX "200", plus']
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_holdings_csv(spark, str(bad))


def test_master_and_jsonl(spark, tmp_path):
    path = tmp_path / "master.json"
    path.write_text(json.dumps({"result": {"etfItemList": [
        {"itemcode": "069500", "itemname": "KODEX 200", "marketSum": 7, "nav": 1.5}, {"itemcode": "0167A0", "itemname": "B"}]}}, indent=1))
    rows = readers.read_master(spark, str(path)).orderBy("ord").collect()
    assert [(r.item_code, r.item_name, r.reference_net_assets) for r in rows] == [("069500", "KODEX 200", 7.0), ("0167A0", "B", None)]
    out = str(tmp_path / "lines")
    sinks.write_jsonl(spark.createDataFrame([(1, "가")], "id int, name string"), out)
    assert [tuple(r) for r in readers.read_jsonl(spark, out, "id int, name string").collect()] == [(1, "가")]


def test_provider_documents(spark, tmp_path):
    bodies = {
        "a": {"etfCode": "069500", "etfName": " KODEX  200 ", "baseDate": "20260713", "rows": [{"종목코드": "5930", "종목명": "삼성전자", "비중": 30.5, "순위": 1}]},
        "b": {"holdings": [{"assetCode": "AAPL", "assetName": "Apple"}], "rows": "none"},
        "c": [{"code": "K2F", "name": "x"}],
        "d": {"nope": True},
        "e": {"data": []},
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    documents = readers.read_raw_documents(spark, str(tmp_path))
    assert sorted(r.fetch_status for r in documents.collect()) == ["NORMALIZATION_FAILED", "OK", "OK", "OK", "OK"]
    rows = holdings.normalize_rows(readers.document_rows(documents)).collect()
    assert sorted((r.asset_code, r.asset_name, r.weight_pct, r.rank) for r in rows) == [
        ("005930", "삼성전자", 30.5, 1), ("AAPL", "Apple", None, 1), ("K2F", "x", None, 1)]
    named = documents.where("etf_code is not null").first()
    assert (named.etf_code, named.etf_name, named.raw_base_date) == ("069500", "KODEX 200", "20260713")


PAGE = """<html><script>
var summary_data = {"CMP_KOR": "KODEX 200", "TOT_PAY": "0.15",
 "ETF_TYP_SVC_NM": "국내주식형"};
var product_summary_data = {"ISSUE_NM_KOR": "삼성", "LIST_DT": "20021014"};
var status_data = {"MKT_VAL": "1,234", "YR_BETA": "-"};
var CU_data = {"grid_data": [{"STK_NM_KOR": "삼성전자", "ETF_WEIGHT": "30.5", "AGMT_STK_CNT": "6,978", "TRD_DT": "2026.07.13"},
 {"STK_NM_KOR": "현금", "ETF_WEIGHT": "-"}]};
</script></html>"""
TABLE = """<div class="section etf_asset"><table><tbody>
<tr><td class="ctg"><a href="/item/main.naver?code=005930">삼성전자</a></td><td>6,978</td><td class="per">30.50%</td></tr>
<tr class="line"><td colspan="3"></td></tr>
<tr><td class="ctg"><a href="/item/main.naver?code=000660">SK하이닉스</a></td><td>1</td><td>8%</td></tr>
</tbody></table></div>"""


def test_pages(spark):
    pages = spark.createDataFrame([("069500", PAGE), ("1", "<html></html>"), ("2", "summary_data = {broken};")], "etf_code string, html string")
    meta = {r.etf_code: r for r in readers.page_metadata(pages).collect()}
    row = meta["069500"]
    assert (row.name, row.issuer, row.total_fee_pct, row.net_assets, row.beta, row.type_text, row.as_of) == (
        "KODEX 200", "삼성", 0.15, 1234.0, None, "국내주식형", "2026.07.13")
    assert meta["1"].name is None and meta["2"].name is None
    held = readers.page_holdings(pages).collect()
    assert [(r.rank, r.name, r.weight, r.quantity) for r in held] == [(1, "삼성전자", 30.5, 6978.0)]
    listing = spark.createDataFrame([("069500", TABLE), ("1", "<p>")], "etf_code string, html string")
    rows = readers.page_table_holdings(listing).orderBy("rank").collect()
    assert [(r.rank, r.code, r.name, r.quantity, r.weight) for r in rows] == [
        (1, "005930", "삼성전자", 6978.0, 30.5), (2, "000660", "SK하이닉스", 1.0, 8.0)]


def snapshot_page(item):
    return (json.dumps({"response": {"body": {"items": {"item": item}}}}, ensure_ascii=False),)


def test_snapshot(spark):
    raw = {"basDt": "20260713", "srtnCd": "069500", "itmsNm": "KODEX 200", "clpr": "10000", "trPrc": "100000000", "nPptTotAmt": "50000000000", "bssIdxIdxNm": "지수"}
    pages = spark.createDataFrame(
        [snapshot_page([raw, {**raw, "srtnCd": None}]), snapshot_page({**raw, "srtnCd": "900001"}), snapshot_page([{**raw, "basDt": "20260710", "srtnCd": "1"}])],
        "body string",
    )
    rows = readers.latest_snapshot(readers.map_snapshot(readers.snapshot_rows(pages))).orderBy("code").collect()
    assert [(r.code, r.prev_close, r.net_assets, r.trading_value, r.nav) for r in rows] == [
        ("069500", 10000.0, 500.0, 1.0, None), ("900001", 10000.0, 500.0, 1.0, None)]


def test_sinks(spark, tmp_path):
    held = spark.createDataFrame([("1", i, f"n{i}", 10.0 - i) for i in range(1, 13)] + [("2", 1, "x", None)], "etf_code string, rank int, name string, weight double")
    path = str(tmp_path / "documents")
    sinks.write_holdings_documents(held, path)
    rows = {r.etf_code: r.holdings for r in spark.read.json(path).collect()}
    assert [h.name for h in rows["1"]] == [f"n{i}" for i in range(1, 11)] and len(rows["2"]) == 1
    report = str(tmp_path / "report")
    sinks.write_csv_report(spark.createDataFrame([('a "b", c', None)], "x string, y string").coalesce(1), report)
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text == 'x,y\n"a ""b"", c",\n'


TICK = "code string, ts timestamp, tick_id long, price double, volume long"


def write_ticks(spark, path, rows):
    spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(path))


def at(hour, minute=0, day=1):
    return dt.datetime(2026, 7, day, hour, minute)


def test_stream_bars_close_with_the_watermark(spark, tmp_path):
    write_ticks(spark, tmp_path / "t", [("a", at(9), 1, 5.0, 1), ("a", at(9, 30), 2, 7.0, 2), ("a", at(9, 30), 3, 6.0, 2), ("b", at(12), 4, 1.0, 1)])
    stream = spark.readStream.schema(TICK).parquet(str(tmp_path / "t"))
    bars = stream_ops.run_to_table(stream_ops.stream_bars(stream, "1 hour", "1 hour"), "bars").collect()
    assert [(r.code, r.o, r.h, r.l, r.c, r.v, r.ticks) for r in bars] == [("a", 5.0, 7.0, 5.0, 6.0, 5, 3)]


def test_stream_latest_merges_batches_and_repeats_safely(spark, tmp_path):
    source = tmp_path / "t"
    write_ticks(spark, source, [("a", at(9), 1, 5.0, 1), ("b", at(10), 2, 1.0, 1)])
    latest = stream_ops.LatestQuotes(spark)
    stream = spark.readStream.schema(TICK).parquet(str(source))
    checkpoint = storage.new_path(spark, "test-latest")
    latest.start(stream, checkpoint).awaitTermination()
    write_ticks(spark, source, [("a", at(11), 3, 8.0, 1), ("b", at(8), 4, 9.0, 1), ("c", at(1), 5, 3.0, 1)])
    latest.start(stream, checkpoint).awaitTermination()
    expected = {"a": 8.0, "b": 1.0, "c": 3.0}
    assert {r.code: r.price for r in latest.table().collect()} == expected
    again = stream_ops.LatestQuotes(spark, latest.path)  # a restarted driver
    again.upsert(spark.createDataFrame([("d", at(2), 6, 4.0, 1)], TICK), 2)
    again.upsert(spark.createDataFrame([("d", at(2), 6, 4.0, 1)], TICK), 2)
    assert {r.code: r.price for r in again.table().collect()} == {**expected, "d": 4.0}
    stale = stream_ops.stale_keys(again.table(), F.lit(at(11, 10)), 3600)
    assert {r.code for r in stale.collect()} == {"b", "c", "d"}


def test_latest_quotes_rewrite_touched_buckets_only(spark):
    latest = stream_ops.LatestQuotes(spark, buckets=16)
    rows = [(f"c{i}", at(9), i, float(i), 1) for i in range(200)]
    latest.upsert(spark.createDataFrame(rows, TICK), 0)
    assert len(latest._manifest(0)["versions"]) == 16
    change = spark.createDataFrame([("c7", at(10), 900, 70.0, 1), ("c7", at(10), 901, 71.0, 1), ("c9", at(8), 902, 9.9, 1)], TICK)

    def files():
        return {f for b in range(16) for f in storage.folder_names(spark, f"{latest.path}/bucket={b}")}

    for _ in range(2):  # the batch and its repetition
        latest.upsert(change, 1)
        versions = latest._manifest(1)["versions"]
        assert 1 <= sum(v == 1 for v in versions.values()) <= 2
        assert files() == {"version=0", "version=1"}
    written = [b for b in range(16) if "version=1" in storage.folder_names(spark, f"{latest.path}/bucket={b}")]
    assert [str(b) for b in written] == sorted((b for b, v in versions.items() if v == 1), key=int)
    assert all(len([n for n in storage.folder_names(spark, f"{latest.path}/bucket={b}/version=1") if n.startswith("part")]) == 1 for b in written)
    expected = {code: price for code, _, _, price, _ in rows} | {"c7": 71.0}
    assert {r.code: r.price for r in latest.table().collect()} == expected
    latest.upsert(spark.createDataFrame([], TICK), 2)
    latest.upsert(spark.createDataFrame([(None, at(1), 1, 5.0, 1)], TICK), 3)
    again = stream_ops.LatestQuotes(spark, latest.path, buckets=3)  # the stored number of buckets counts
    assert {r.code: r.price for r in again.table().collect()} == expected | {None: 5.0}
    assert again.versions() == [2, 3]
    touched = {b for b in range(16) if storage.folder_names(spark, f"{latest.path}/bucket={b}") == ["version=1"]}
    assert touched  # what no manifest names any more is gone


def test_half_a_batch_is_not_seen(spark):
    latest = stream_ops.LatestQuotes(spark, buckets=4)
    latest.upsert(spark.createDataFrame([("a", at(9), 1, 1.0, 1)], TICK), 0)
    real = upserts.write_text

    def lost(*_):
        raise RuntimeError("driver lost")

    upserts.write_text = lost
    try:
        with pytest.raises(RuntimeError):
            latest.upsert(spark.createDataFrame([("a", at(10), 2, 2.0, 1)], TICK), 1)
    finally:
        upserts.write_text = real
    assert [r.price for r in latest.table().collect()] == [1.0]
    latest.upsert(spark.createDataFrame([("a", at(10), 2, 2.0, 1)], TICK), 1)
    assert [r.price for r in latest.table().collect()] == [2.0]


def test_stale_watch_over_two_restarts(spark, tmp_path):
    source, checkpoint, path = tmp_path / "t", storage.new_path(spark, "test-stale"), storage.new_path(spark, "test-stale-out")
    source.mkdir()
    stream = spark.readStream.schema(TICK).parquet(str(source))
    watched = stream_ops.watch_stale(stream, 3600, "10 minutes", forget_seconds=86400)

    def run(rows):
        write_ticks(spark, source, rows)
        with stream_ops.rocksdb(spark):
            table = stream_ops.run_to_table(watched, "stale", path, checkpoint)
        return sorted((r.code, r.state, r.at.strftime("%d %H:%M")) for r in table.collect())

    first = run([("a", at(9), 1, 1.0, 1), ("a", at(9, 59), 2, 1.0, 1), ("b", at(9, 5), 3, 1.0, 1), ("b", at(12), 4, 1.0, 1)])
    # b was silent from 9:05; a's silence is past the limit at 10:59.
    assert first == [("a", "stale", "01 10:59"), ("b", "stale", "01 10:05")]
    second = run([("a", at(13), 5, 1.0, 1), ("c", at(14, 30), 6, 1.0, 1)])
    assert second == sorted([*first, ("a", "returned", "01 13:00"), ("a", "stale", "01 14:00"), ("b", "returned", "01 12:00"), ("b", "stale", "01 13:00")])
    third = run([("a", at(9, 30), 7, 1.0, 1), ("c", at(2, day=3), 8, 1.0, 1)])  # too late for a
    assert third == sorted([*second, ("c", "stale", "01 15:30")])


def test_stream_dedup(spark, tmp_path):
    rows = [("a", at(9), 1, 5.0, 1), ("a", at(9), 1, 5.0, 1), ("a", at(9), 2, 5.0, 1)]
    write_ticks(spark, tmp_path / "t", rows)
    write_ticks(spark, tmp_path / "t", rows[:1])
    stream = spark.readStream.schema(TICK).parquet(str(tmp_path / "t"))
    once = stream_ops.run_to_table(stream_ops.stream_dedup(stream), "dedup")
    assert sorted(r.tick_id for r in once.collect()) == [1, 2]


class Named:
    """A session whose cluster names a shared folder."""

    def __init__(self, settings, master="yarn"):
        self.settings, self.master, self.sparkContext = settings, master, self

    def getConf(self):
        return self.settings


def test_scratch_folder_comes_from_the_session(spark):
    assert storage.scratch_root(Named({"spark.checkpoint.dir": "s3a://shared/scratch/"})) == "s3a://shared/scratch"
    assert storage.materialize(spark.range(3), "here").count() == 3
    assert any(n.startswith("fundlens-here") for n in storage.folder_names(spark, storage.scratch_root(spark)))


def test_scratch_tables_can_be_released(spark):
    table = storage.materialize(spark.range(2), "gone")
    assert table.count() == 2
    assert storage.release(spark) >= 1
    assert not any(n.startswith("fundlens-gone") for n in storage.folder_names(spark, storage.scratch_root(spark)))
