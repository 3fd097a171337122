"""Structural check of raw documents, field by field."""

import json

from fundlens.operators import documents

GOOD = {
    "schemaVersion": "1.0.0", "etfCode": "069500", "etfName": "x", "baseDate": "2026-07-13", "generatedAt": "2026-07-13T00:00:00+09:00",
    "source": {"provider": "PYKRX", "sourceType": None, "isFallback": False},
    "collection": {"status": "OK", "attemptedProviders": ["PYKRX"], "message": None},
    "holdings": [{"assetCode": "005930", "assetName": "a", "assetType": "EQUITY", "weightPct": 0, "quantity": 1.5, "rank": 1.0, "market": None}],
    "diagnostics": {"anything": [1, {"goes": True}]}, "dateResolution": None,
}


def errors(spark, *bodies):
    table = spark.createDataFrame([(i, b if isinstance(b, str | None) else json.dumps(b)) for i, b in enumerate(bodies)], "id int, body string")
    return sorted((r.id, r.path, r.error, r["count"]) for r in documents.check_raw_documents(table, ["id"]).collect())


def test_good_and_broken(spark):
    assert errors(spark, GOOD, None, "", "{", "[]", "3", "null") == [
        (1, "$", "json", 1), (2, "$", "json", 1), (3, "$", "json", 1), (4, "$", "type", 1), (5, "$", "type", 1), (6, "$", "type", 1)]


def test_every_kind_of_error(spark):
    row = {"assetCode": "", "assetType": "SHARE", "weightPct": "5", "rank": 1.5, "isin": None, "quantity": True}
    bad = GOOD | {
        "schemaVersion": "1", "etfCode": 69500, "etfName": "", "baseDate": None, "extra": {"deep": 1}, "source": [], "diagnostics": "x",
        "collection": {"status": "FINE", "attemptedProviders": ["PYKRX", "ME", None, 4]},
        "holdings": [row, row, 7, None, GOOD["holdings"][0]], "dateResolution": {"lookbackDays": "7", "more": 1, "status": "EXACT"},
    }
    del bad["generatedAt"]
    h, c = "$.holdings[]", "$.collection.attemptedProviders[]"
    assert errors(spark, bad) == sorted((0, *e) for e in [
        ("$.schemaVersion", "pattern", 1), ("$.etfCode", "type", 1), ("$.etfName", "minLength", 1), ("$.baseDate", "type", 1),
        ("$.extra", "additionalProperties", 1), ("$.source", "type", 1), ("$.diagnostics", "type", 1), ("$.generatedAt", "required", 1),
        ("$.collection.status", "enum", 1), (c, "enum", 1), (c, "type", 2), ("$.dateResolution.lookbackDays", "type", 1),
        ("$.dateResolution.more", "additionalProperties", 1), (h, "type", 2), (f"{h}.assetCode", "minLength", 2), (f"{h}.assetName", "required", 2),
        (f"{h}.assetType", "enum", 2), (f"{h}.weightPct", "type", 2), (f"{h}.rank", "type", 2), (f"{h}.isin", "additionalProperties", 2),
        (f"{h}.quantity", "type", 2)])


def test_no_documents(spark):
    assert documents.check_raw_documents(spark.createDataFrame([], "id int, body string"), ["id"]).collect() == []
