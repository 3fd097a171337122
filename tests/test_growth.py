"""Work that was done several times over, which only larger tables showed."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from fundlens.functions import clean
from fundlens.operators import documents as document_ops
from fundlens.operators import holdings as holding_ops
from fundlens.operators import ordering, quality
from fundlens.plans import catalog, trips
from fundlens.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_parsed_once(spark, folder):
    bodies = ['{"etfCode":"1","holdings":[{"a":1}]', '{"etfCode":"2","rows":7,"data":[{"a":"x"},{"a":null}]}', '[{"a":2.50}]', "{}", "", None, '"rows"']
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    parsed = readers.parse_documents(docs)
    assert parsed.columns == ["id", "etf_code", "etf_name", "raw_base_date", "rows", "fetch_status"]
    found = {r.id: r for r in parsed.collect()}
    assert [i for i, r in found.items() if r.fetch_status == "OK"] == [1, 2]
    assert (found[1].etf_code, found[1].rows, found[2].rows) == ("2", [{"a": "x"}, {"a": None}], [{"a": "2.5"}])
    assert "get_json_object" not in plan(parsed)
    assert "get_json_object" not in plan(catalog.plans["raw_document_rows"](spark, folder))


def test_holdings_are_unfolded_once(spark):
    document = {"holdings": [{"assetCode": "A", "assetName": "", "assetType": "EQUITY"}, 5, None, [1], {}]}
    docs = spark.createDataFrame([(1, json.dumps(document))], "id int, body string")
    errors = document_ops.check_raw_documents(docs, ["id"])
    of_items = errors.where(F.startswith("path", F.lit("$.holdings[]")))
    at = "$.holdings[]"
    want = {(at, "type", 3), (f"{at}.assetName", "minLength", 1), *((f"{at}.{n}", "required", 1) for n in ("assetCode", "assetName", "assetType"))}
    assert {(r["path"], r["error"], r["count"]) for r in of_items.collect()} == want
    assert plan(errors).count("Generate explode") == 2  # holdings and attempted providers


def test_edges_are_summed_once(spark, folder):
    assert plan(catalog.plans["edge_keys"](spark, folder)).count("l_extendedprice") == 1  # that of the table itself, unused


def test_dates_are_found_once(spark, folder):
    assert "l_shipdate" not in plan(catalog.plans["dated_conflicts"](spark, folder))


def test_positions_in_several_orders(spark):
    rows = spark.range(24000).selectExpr("if(id < 15000, null, id % 50) AS k", "id", "hash(id) % 7 AS v")
    orders = {"up": [F.col("id").asc()], "by_v": [F.col("v").desc(), F.col("id").asc()]}
    placed = ordering.with_positions(rows, orders, ["k"], totals={"most": F.max("id")}).collect()
    groups = {}
    for r in placed:
        groups.setdefault(r.k, []).append(r)
    assert len(placed) == 24000 and len(groups) == 51
    for group in groups.values():
        assert [r.up for r in sorted(group, key=lambda r: r.id)] == list(range(1, len(group) + 1))
        assert [r.by_v for r in sorted(group, key=lambda r: (-r.v, r.id))] == list(range(1, len(group) + 1))
        assert {r.most for r in group} == {max(r.id for r in group)}


def test_both_places_come_from_one_table(spark, folder):
    rows = spark.createDataFrame([("f", "a", 1, 1), ("f", "b", 2, None), ("f", "c", 3, 2), ("g", "a", 1, 1)], "etf_id string, stock_id string, place int, stored_place int")
    assert [tuple(r) for r in quality.place_mismatch(rows).collect()] == [("f", 2)]
    assert "Join" not in plan(catalog.plans["array_audit"](spark, folder))


def test_widest_weights_need_no_join(spark, folder):
    assert "Join" not in plan(catalog.plans["funds_by_stock"](spark, folder))


def test_lists_are_named_and_ranked_once(spark, folder):
    assert plan(catalog.plans["name_code_backfill"](spark, folder)).count("Join") == 1


def longest_method(df) -> int:
    """Bytes of the longest method that Spark generates; the JVM compiles up to 8000."""
    package = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_rows_are_normalized_by_compiled_methods(spark, folder):
    assert longest_method(catalog.plans["normalized_rows"](spark, folder)) < 8000


def test_fields_are_picked_by_the_first_alias_there_is(spark):
    rows = [
        {"x": "1", "code": "A", "assetCode": None, "비중": "5%", "name": "n"}, {"isin": "B", "ISIN": "C", "no": "2", "순번": "3"},
        {}, None, {"ratio": "1", "구성비": "2", "종류": "주식", "통화": "KRW", "거래소": "K", "ccy": "USD", "금액": "9", "계약": "0"},
    ]
    raw = spark.createDataFrame(list(enumerate(rows)), "pos int, row map<string,string>")
    found, picked = holding_ops._picked(raw, "row", ["pos"])
    mine = found.select("pos", *[c.alias(f) for f, c in picked.items()]).orderBy("pos").collect()
    each = raw.select("pos", *[clean.first_present("row", keys).alias(f) for f, keys in holding_ops.ALIASES.items()])
    assert mine == each.orderBy("pos").collect()
    assert (mine[0].code, mine[0].weight, mine[1].code, mine[1].rank) == (None, "5%", "C", "3")


def test_references_are_counted_without_a_join(spark, folder):
    used = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,), (4,)], "a int")
    known = spark.createDataFrame([(2,), (None,), (2,), (4,), (9,)], "b int")
    for rows in (0, 30 * ordering.ROWS_PER_TASK):
        found = quality.fk_violations(used, "a", known, "b", rows)
        assert {tuple(r) for r in found.collect()} == {(1, 2), (None, 2), (3, 1)}
        assert found.schema.simpleString() == "struct<value:int,rows:bigint>"
    # Tasks grow with the rows, so that what one holds does not.
    assert found.rdd.getNumPartitions() == 31
    assert "Join" not in plan(catalog.plans["fk_audit"](spark, folder))


def test_joined_lines_are_dealt_by_their_number(spark, folder, monkeypatch):
    few = trips._lines(spark, folder)
    assert "RepartitionByExpression" not in plan(few)
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 100)
    many = trips._lines(spark, folder)
    assert many.count() == few.count() and many.exceptAll(few).isEmpty()
    n = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() // 100 + 1 for t in ("orders", "lineitem")}
    dealt = [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan(many))]
    assert sorted(dealt) == sorted([n["orders"]] * 2 + [n["lineitem"]] * 4)
