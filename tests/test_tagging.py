"""Tagging, metadata, batches, samples and ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundlens.operators import metadata, quality, resolve, tagging
from fundlens.sources import sinks

SCORE = "etf_code string, tag_id string, score double, confidence double, source string, evidence array<string>"


def test_rules(spark):
    records = spark.createDataFrame(
        [
            ("1", "KODEX 레버리지", None, None), ("2", "TIGER 2X레", None, None), ("3", "ACE 지수", "S&P 500 TR", "매 1, 2, 3월"),
            ("4", "KODEX 200", "코스피 200", "매 1,4,7,10월"), ("5", "ACE S&P500 인버스", "S&P 500", None),
        ],
        "etf_code string, name string, benchmark_name string, distribution_schedule_text string",
    )
    tags = tagging.rule_tags(records)
    assert {(r.etf_code, r.tag_id) for r in tags.collect()} == {
        ("1", "strategy.leverage"), ("2", "strategy.leverage"), ("3", "strategy.sp500"), ("3", "dividend.monthly"),
        ("5", "strategy.sp500"), ("5", "strategy.inverse")}
    evidence = {(r.etf_code, r.tag_id): r.evidence for r in tags.collect()}
    assert evidence[("3", "strategy.sp500")] == ['benchmark_name="S&P 500 TR" matched /S&P\\s*500/i']
    assert evidence[("5", "strategy.sp500")][0].startswith('name="')
    assert tuple(tagging.rule_counts(records, tags).first()) == (5, 4)


def test_merge_ladder(spark):
    rule = spark.createDataFrame(
        [("1", "t.rule", 1.0, 0.5, "rule", ["r"]), ("1", "t.sure", 1.0, 1.0, "rule", ["r"]), ("1", "t.same", 1.0, 1.0, "rule", ["r"]),
         ("1", "t.weak", 0.9, 0.5, "rule", ["r"]), ("1", "t.tie", 0.9, 0.7, "rule", ["r"])],
        SCORE,
    )
    model = spark.createDataFrame(
        [("2", "t.model", 0.4, 0.4, "model", ["m"]), ("1", "t.sure", 0.5, 0.9, "model", ["m"]), ("1", "t.same", 1.0, 0.995, "model", ["m"]),
         ("1", "t.weak", 0.6, 0.8, "model", ["m"]), ("1", "t.tie", 0.1, 0.7, "model", ["m"])],
        SCORE,
    )
    tags, conflicts = tagging.merge_tags(rule, model)
    got = {r.tag_id: (r.score, r.confidence, r.evidence, r.merged_from) for r in tags.collect()}
    assert got == {
        "t.rule": (1.0, 0.5, ["r"], ["rule"]),
        "t.model": (0.4, 0.4, ["m"], ["model"]),
        "t.sure": (1.0, 1.0, ["r", "m"], ["rule", "model(evidence_only)"]),
        "t.same": (1.0, 1.0, ["r", "m"], ["rule", "model(evidence_only)"]),
        "t.weak": (0.6, 0.8, ["m"], ["rule", "model"]),
        "t.tie": (0.9, 0.7, ["r"], ["rule"]),
    }
    assert {(r.tag_id, r.selected_source, r.reason) for r in conflicts.collect()} == {
        ("t.sure", "rule", "certain_rule"), ("t.weak", "model", "greater_confidence"), ("t.tie", "rule", "greater_confidence")}


def test_filter_map_and_leftovers(spark):
    taxonomy = spark.createDataFrame(
        [("a", 0.6, 0.5, True), ("off", 0.0, 0.0, False)],
        "id string, minimum_score double, minimum_confidence double, enabled boolean",
    )
    tags = spark.createDataFrame(
        [("1", "a", 0.6, 0.5), ("2", "a", 0.9, 0.5), ("3", "a", 0.9, 0.8), ("4", "a", 0.5, 0.9), ("4", "off", 1.0, 1.0), ("5", "gone", 1.0, 1.0)],
        "etf_code string, tag_id string, score double, confidence double",
    )
    funds = spark.createDataFrame([(str(i), i % 2 == 0) for i in range(1, 8)], "etf_code string, is_scored boolean")
    ordered = tagging.filter_map(tags, taxonomy).orderBy("position").collect()
    assert [(r.etf_code, r.position) for r in ordered] == [("3", 1), ("2", 2), ("1", 3)]
    assert [r.etf_code for r in tagging.low_confidence(tags, taxonomy).collect()] == ["4"]
    assert {(r.etf_code, r.reason) for r in tagging.unclassified(funds, tags, taxonomy).collect()} == {
        ("4", "below_minimums"), ("5", "below_minimums"), ("6", "scored_without_tags"), ("7", "not_scored")}
    totals = tagging.tagging_totals(funds, tags, taxonomy).first()
    assert (totals.tagged_funds, totals.low_confidence_rows, totals.unclassified_funds, totals.active_filters) == (3, 1, 4, 1)
    assert len(tagging.TAXONOMY) == 25 and tagging.taxonomy(spark).where("enabled").count() == 25


def test_score_check(spark):
    taxonomy = spark.createDataFrame([("a",), ("b",)], "id string")
    expected = spark.createDataFrame([("b1", "1"), ("b1", "2"), ("b1", "3")], "batch_id string, etf_code string")
    results = spark.createDataFrame(
        [("b1", "1", 0, "a", 1.7, 0.5), ("b1", "1", 1, "a", 0.1, 0.1), ("b1", "2", 0, "zzz", 1.0, 1.0), ("b1", "2", 1, None, 1.0, 1.0),
         ("b1", "2", 2, "b", None, 1.0), ("b1", "2", 3, "b", 0.5, -1.0), ("b1", "9", 0, "a", 1.0, 1.0)],
        "batch_id string, etf_code string, pos int, tag_id string, score double, confidence double",
    )
    checked = quality.check_scores(results, taxonomy, expected)
    got = {(r.etf_code, r.pos): (r.verdict, r.score_01, r.confidence_01) for r in checked.collect()}
    assert got == {
        ("1", 0): ("ok", 1.0, 0.5), ("1", 1): ("warning:duplicate_tag", 0.1, 0.1), ("2", 0): ("error:unknown_tag", 1.0, 1.0),
        ("2", 1): ("error:bad_item", 1.0, 1.0), ("2", 2): ("error:bad_number", None, 1.0), ("2", 3): ("ok", 0.5, 0.0),
        ("9", 0): ("refused:unexpected_code", 1.0, 1.0)}
    gaps = tagging.batch_gaps(results, expected)
    assert {(r.etf_code, r.gap) for r in gaps.collect()} == {("3", "missing"), ("9", "unexpected")}
    state = tagging.batch_states(checked, gaps, expected).first()
    assert (state.errors, state.warnings, state.missing, state.unexpected, state.state) == (3, 1, 1, 1, "needs_review")
    assert [r.etf_code for r in tagging.accepted_scores(checked).collect()] == ["1"]


def test_reviews_replace_all_scores(spark):
    scores = spark.createDataFrame([("1", "a", 1.0, 1.0), ("2", "a", 1.0, 1.0), ("3", "a", 1.0, 1.0)], "etf_code string, tag_id string, score double, confidence double")
    reviews = spark.createDataFrame(
        [(0, "1", [("x", 0.1, 0.1)]), (1, "1", [("b", 0.5, 0.5), ("c", 0.6, 0.6)]), (2, "2", []), (3, "9", [("z", 1.0, 1.0)])],
        "ord int, etf_code string, corrected array<struct<tag_id:string,score:double,confidence:double>>",
    )
    assert {(r.etf_code, r.tag_id) for r in tagging.apply_reviews(scores, reviews).collect()} == {("1", "b"), ("1", "c"), ("3", "a")}


def test_sampling_takes_each_record_once(spark):
    names = ["KODEX 반도체", "TIGER 반도체 AI", "KODEX 인버스 레버리지", "KODEX 레버리지", "TIGER 합성 액티브"]
    records = spark.createDataFrame([(i, str(i), n) for i, n in enumerate(names)], "ord long, etf_code string, name string")
    categories = (("반도체", "반도체", None), ("다시", "반도체", "AI"), ("AI", r"\bAI\b", None), ("레버리지", "레버리지", None), ("인버스", "인버스", None))
    picks = tagging.sample_by_category(records, categories, "복합").orderBy("place").collect()
    assert [(r.category, r.etf_code) for r in picks] == [
        ("반도체", "0"), ("다시", None), ("AI", "1"), ("레버리지", "2"), ("인버스", None), ("복합", "4")]


def test_batches(spark):
    records = spark.range(37).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("etf_code"))
    done = spark.createDataFrame([("batch-0006", "done"), ("batch-0005", "pending")], "batch_id string, status string")
    sizes = {r.batch_id: r["count"] for r in tagging.assign_batches(records, 15, 5).groupBy("batch_id").count().collect()}
    assert sizes == {"batch-0005": 15, "batch-0006": 15, "batch-0007": 7}
    left = tagging.assign_batches(records, 15, 5, done).select("batch_id").distinct().collect()
    assert {r.batch_id for r in left} == {"batch-0005", "batch-0007"}


def test_candidates(spark):
    rows = spark.createDataFrame(
        [("AI", "sector", "1", 0.5, 0.7), ("AI", "sector", "1", 0.7, 9.0), ("AI", "sector", "2", None, 0.2), ("AI", "other", "2", 1.0, 1.0), (None, "sector", "2", 1.0, 1.0)],
        "label string, category string, etf_code string, score double, confidence double",
    )
    got = [tuple(r) for r in tagging.candidate_rollup(quality.candidate_tags(rows)).collect()]
    assert got == [("AI", "sector", 2, 0.4, 0.6333)]


def test_metadata_and_coverage(spark):
    master = spark.createDataFrame(
        [("1", "krx_numeric", "KODEX 액티브(H)"), ("2", "krx_numeric", "KODEX 200"), ("3", "krx_numeric", "없음")],
        "etf_code string, code_type string, name string",
    )
    detail = spark.createDataFrame([("1", "이름", "발행사", "지수", 0.15, "매월")], "etf_code string, name string, issuer string, benchmark_name string, total_fee_pct double, distribution_text string")
    counts = spark.createDataFrame([("2", 10, "listing_file")], "etf_code string, holdings_count long, holdings_source string")
    records = metadata.integrate(master, detail, counts)
    rows = {r.etf_code: r for r in records.collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].name, rows["1"].active, rows["1"].currency_hedged, rows["1"].monthly) == ("이름", True, True, True)
    assert (rows["2"].active, rows["2"].monthly, rows["2"].collection_status) == (None, None, "not_collected")
    covered = metadata.coverage(records)
    scores = {r.etf_code: (r.coverage_score, r.missing_fields) for r in covered.collect()}
    assert scores["1"] == (0.55, ["descriptions", "holdings", "sector_country_weights"])
    assert scores["2"][0] == 0.35
    assert tuple(metadata.coverage_buckets(covered).first()) == (0, 1, 1, 2)
    assert metadata.missing(covered).count() == 3 + 7
    pct = {r.field: r.coverage_pct for r in metadata.field_coverage(covered).collect()}
    assert pct["holdings"] == 50.0 and pct["name"] == 100.0
    assert sum(metadata.FIELD_WEIGHTS.values()) == pytest.approx(1.0)
    extract = metadata.web_extract(records)
    body = metadata.as_compact_json(extract, "etf_code").collect()
    assert [(r.etf_code, "beta" in r.body, '"issuer":"발행사"' in r.body) for r in body] == [("1", False, True)]
    assert metadata.field_counts(extract).first().funds == 1
    ledger = spark.createDataFrame([("1",)], "etf_code string")
    forecast = tagging.work_forecast(covered, ledger).first()
    assert (forecast.total, forecast.already_scored, forecast.remaining, forecast.batches) == (2, 1, 1, 1)


def test_compact_records_and_stats(spark):
    records = spark.createDataFrame([("1", "A", None), ("2", "B", "x")], "etf_code string, name string, issuer string")
    holding = spark.createDataFrame(
        [("1", i, f"c{i}", f"n{i}", float(i) if i else None) for i in range(12)],
        "etf_code string, rank int, code string, name string, weight double",
    )
    rows = {r.etf_code: r.body for r in tagging.compact_records(records, holding).collect()}
    assert rows["1"].count('"code"') == 10 and '"issuer":null' in rows["1"]
    assert rows["1"].index("n11") < rows["1"].index("n10")
    stats = tagging.input_stats(spark.createDataFrame([("x" * 22,), ("y" * 11,)], "body string")).first()
    assert tuple(stats) == (2, 33, 15, 17, 8)


def test_ledgers(spark, tmp_path):
    inputs = spark.createDataFrame([("1", "a"), ("2", "b")], "etf_code string, text string")
    current = sinks.scoring_ledger(inputs, ["etf_code", "text"], "1.0.0", "1.0.0")
    assert current.first().input_hash.startswith("sha256:")
    changed = inputs.withColumn("text", F.when(F.col("etf_code") == "2", "c").otherwise(F.col("text")))
    fresh = sinks.scoring_ledger(changed, ["etf_code", "text"], "1.0.0", "1.0.0")
    assert [r.etf_code for r in sinks.to_score(fresh, current).collect()] == ["2"]
    assert sinks.pending(inputs, inputs.where("etf_code = '1'")).count() == 1
    assert sinks.pending(inputs, inputs, force=True).count() == 2
    results = spark.createDataFrame([("success",), ("cached",), ("failed",)], "status string")
    path = str(tmp_path / "ledger")
    for _ in range(2):
        sinks.append_run(results, path, "detail", F.lit("2026-07-14").cast("timestamp"))
    runs = spark.read.parquet(path).collect()
    assert len(runs) == 2 and runs[0].success_rate == 66.7
    for _ in range(2):  # the same run again
        sinks.append_run(results, path, "detail", F.lit("2026-07-15").cast("timestamp"), "run-3")
    assert spark.read.parquet(path).count() == 3


def test_scoring_ledger_keeps_one_entry_per_fund(spark, tmp_path):
    kind = "etf_code string, input_hash string, taxonomy_version string, prompt_version string, scored_at long"
    ledger = sinks.ScoringLedger(spark, str(tmp_path / "scores"), buckets=4)
    ledger.record(spark.createDataFrame([(f"f{i}", "h", "1", "1", 1) for i in range(20)], kind))
    second = spark.createDataFrame([("f3", "new", "1", "1", 2), ("f4", "late", "1", "1", 0)], kind)
    for _ in range(3):
        ledger.record(second)
        rows = {r.etf_code: r.input_hash for r in ledger.table().collect()}
        assert ledger.table().count() == len(rows) == 20
        assert (rows["f3"], rows["f4"], rows["f5"]) == ("new", "h", "h")
    assert ledger.versions() == [2, 3]


def test_provenance_record_has_source_date_and_override(spark):
    day = dt.date
    rows = [
        ("f1", "name", "A", "master", None, 50, 0.75), ("f1", "name", "B", "detail", None, 100, 0.85),
        ("f1", "holdings", "10", "detail", day(2026, 7, 1), 100, 0.85), ("f1", "holdings", "12", "listing_file", day(2026, 7, 3), 80, 0.7),
        ("f2", "holdings", "9", "detail", day(2026, 7, 3), 100, 0.85), ("f2", "holdings", "8", "listing_file", None, 80, 0.7),
        ("f3", "name", None, "detail", None, 100, 0.85), ("f3", "beta", "1", "detail", None, 100, 0.85),
    ]
    values = spark.createDataFrame(rows, "etf_code string, field string, value string, source_id string, as_of date, priority int, confidence double").repartition(4)
    found = {r.etf_code: r for r in resolve.provenance_record(values, ["name", "holdings"], recency=("holdings",)).collect()}
    assert found["f1"].name.value == "B" and not found["f1"].name.overridden
    assert (found["f1"].holdings.value, found["f1"].holdings.as_of, found["f1"].holdings.overridden) == ("12", day(2026, 7, 3), True)
    assert (found["f2"].name, found["f2"].holdings.value, found["f2"].holdings.overridden) == (None, "9", False)
    assert (found["f3"].name, found["f3"].holdings) == (None, None)
    plain = {r.etf_code: r for r in resolve.provenance_record(values, ["holdings"]).collect()}
    assert plain["f1"].holdings.value == "10" and not plain["f1"].holdings.overridden
