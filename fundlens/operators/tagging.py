"""Tagging: rules, merging with a second scorer, thresholds, batches and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import exact_sum, half_up
from ..functions.names import name_hints, token_estimate
from .ordering import first_by, top_per_key, with_position

BATCH_SIZE = 15


@dataclass(frozen=True)
class TagRule:
    tag_id: str
    match_fields: tuple[str, ...]
    pattern: str
    flags: str
    score: float
    confidence: float


# The rules for facts that a text states literally.
TAG_RULES = (
    TagRule("strategy.leverage", ("name",), r"레버리지|(\d(?:\.\d)?)\s*X\b", "i", 1.0, 1.0),
    TagRule("strategy.inverse", ("name",), "인버스", "", 1.0, 1.0),
    TagRule("strategy.sp500", ("name", "benchmark_name"), r"S&P\s*500", "i", 1.0, 0.95),
    TagRule("strategy.nasdaq100", ("name", "benchmark_name"), r"나스닥\s*100|NASDAQ\s*100", "i", 1.0, 0.95),
    TagRule("strategy.reit", ("name", "benchmark_name"), "리츠|REIT", "i", 0.9, 0.85),
    TagRule("dividend.covered_call", ("name",), "커버드콜", "", 1.0, 1.0),
    TagRule(
        "dividend.monthly", ("name", "distribution_schedule_text"),
        r"먼슬리|월배당|매\s*1,\s*2,\s*3", "", 0.85, 0.7,
    ),
)

# Id, category, label, minimum score, minimum confidence.
TAXONOMY = (
    ("sector.game_entertainment_media", "sector", "게임/엔터/미디어", 0.65, 0.5),
    ("sector.it", "sector", "IT", 0.65, 0.5),
    ("sector.healthcare_bio_pharma", "sector", "의료/제약/바이오", 0.65, 0.5),
    ("sector.semiconductor", "sector", "반도체", 0.65, 0.5),
    ("sector.ev_battery", "sector", "전기차/2차전지", 0.65, 0.5),
    ("sector.clean_energy", "sector", "클린에너지", 0.65, 0.5),
    ("sector.commodities", "sector", "원자재", 0.6, 0.5),
    ("sector.autonomous_mobility", "sector", "자율주행/모빌리티", 0.65, 0.5),
    ("sector.tech_general", "sector", "테크/기술", 0.7, 0.55),
    ("sector.financials", "sector", "금융", 0.65, 0.5),
    ("sector.aerospace_defense", "sector", "우주항공/방산", 0.65, 0.5),
    ("sector.ai_power_infrastructure", "sector", "AI전력/인프라", 0.65, 0.5),
    ("strategy.leverage", "strategy", "레버리지", 0.9, 0.8),
    ("strategy.inverse", "strategy", "인버스", 0.9, 0.8),
    ("strategy.growth", "strategy", "성장주", 0.6, 0.45),
    ("strategy.value", "strategy", "가치주", 0.6, 0.45),
    ("strategy.reit", "strategy", "부동산 리츠", 0.7, 0.6),
    ("strategy.consumer_discretionary", "strategy", "경기소비재", 0.65, 0.5),
    ("strategy.sp500", "strategy", "S&P500", 0.9, 0.85),
    ("strategy.nasdaq100", "strategy", "나스닥100", 0.9, 0.85),
    ("strategy.value_up", "strategy", "밸류업", 0.75, 0.6),
    ("dividend.korea_high_dividend", "dividend", "한국 고배당", 0.65, 0.5),
    ("dividend.us_dividend_growth", "dividend", "미국 배당성장", 0.65, 0.5),
    ("dividend.covered_call", "dividend", "커버드콜 배당", 0.8, 0.7),
    ("dividend.monthly", "dividend", "월배당", 0.85, 0.75),
)
TAXONOMY_VERSION = "1.0.0"

# Words that disqualify a plain product, and (category, pattern, excluded).
NOISE = "커버드콜|레버리지|인버스|합성|타겟|액티브"
SAMPLE_CATEGORIES = (
    ("국내 대표지수", r"(?i)^(KODEX|TIGER)\s*200$", None),
    ("미국 대표지수", r"(?i)S&P\s*500", NOISE),
    ("반도체", "반도체", NOISE),
    ("AI", r"\bAI\b", "반도체"),
    ("바이오", "바이오", NOISE),
    ("게임·엔터·미디어", "게임|엔터|미디어|콘텐츠", None),
    ("전기차·2차전지", "2차전지|전기차|배터리", None),
    ("클린에너지", "클린에너지|태양광|풍력|수소", None),
    ("원자재", "골드|금현물|은현물|원유|구리|원자재", None),
    ("금융", "금융|증권|은행", "배당"),
    ("방산·우주항공", "방산|우주", None),
    ("AI 전력·인프라", "전력.*AI|AI.*전력|데이터센터", None),
    ("레버리지", "레버리지", None),
    ("인버스", "인버스", None),
    ("성장", "성장", "배당"),
    ("가치", "가치", None),
    ("리츠", "(?i)리츠|REIT", None),
    ("밸류업", "밸류업", None),
    ("고배당", "고배당", "커버드콜|미국"),
    ("배당성장", "배당성장|배당다우존스", None),
    ("월배당", "(?i)월배당|먼슬리", None),
    ("커버드콜", "커버드콜", None),
    ("채권", "채권", "액티브|커버드콜"),
    ("만기매칭 채권", "만기매칭|목표전환", None),
    ("액티브", "액티브", None),
)
COMPLEX_CATEGORY = "복합(이름만으로 분류 어려움)"


def java_pattern(pattern: str, flags: str = "") -> str:
    """Regex with ASCII word edges, since Java counts Hangul as word characters."""
    edge = (
        "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    )
    return ("(?i)" if "i" in flags else "") + pattern.replace(r"\b", edge)


def taxonomy(spark: SparkSession) -> DataFrame:
    schema = "id string, category string, label string, minimum_score double, minimum_confidence double"
    return spark.createDataFrame(list(TAXONOMY), schema).withColumn("enabled", F.lit(True))


def rule_tags(records: DataFrame, rules: Sequence[TagRule] = TAG_RULES) -> DataFrame:
    """Tags whose rule matches, each with the first matching field as evidence."""

    def tag(rule: TagRule) -> Column:
        pattern = java_pattern(rule.pattern, rule.flags)
        field = reduce(
            lambda rest, f: F.when(F.col(f).rlike(pattern), f).otherwise(rest),
            reversed(rule.match_fields),
            F.lit(None).cast("string"),
        )
        text = reduce(
            lambda rest, f: F.when(field == f, F.col(f)).otherwise(rest),
            reversed(rule.match_fields),
            F.lit(None).cast("string"),
        )
        evidence = F.concat(
            field, F.lit('="'), text, F.lit(f'" matched /{rule.pattern}/{rule.flags}')
        )
        return F.when(
            field.isNotNull(),
            F.struct(
                F.lit(rule.tag_id).alias("tag_id"),
                F.lit(float(rule.score)).alias("score"),
                F.lit(float(rule.confidence)).alias("confidence"),
                F.lit("rule").alias("source"),
                F.array(evidence).alias("evidence"),
            ),
        )

    tags = F.array_compact(F.array(*[tag(rule) for rule in rules]))
    return records.select("etf_code", F.inline(tags))


def rule_counts(records: DataFrame, tags: DataFrame) -> DataFrame:
    """Records, and how many of them some rule tagged."""
    tagged = tags.select("etf_code", F.lit(1).alias("_tagged")).distinct()
    return records.select("etf_code").join(tagged, "etf_code", "left").agg(
        F.count(F.lit(1)).alias("records"), F.count("_tagged").alias("tagged")
    )


def apply_reviews(scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """A reviewer's corrected list replaces all of a fund's scores, even by nothing.

    ``reviews``: ord, etf_code, corrected (array of structs with the score columns).  Where
    both tables have a batch_id, a review counts for that batch only.
    """
    key = ["etf_code"]
    if "batch_id" in scores.columns and "batch_id" in reviews.columns:
        key = ["batch_id", "etf_code"]
    last = first_by(reviews, key, F.col("ord").desc())
    untouched = scores.join(last.select(*key), key, "left_anti")
    scored = scores.select(*key).distinct()
    corrected = last.join(scored, key, "left_semi").select(*key, F.inline("corrected"))
    return untouched.unionByName(corrected, allowMissingColumns=True)


def latest_scores(scores: DataFrame) -> DataFrame:
    """Of several batches that scored a fund, the scores of the last one by batch_id."""
    last = scores.groupBy("etf_code").agg(F.max("batch_id").alias("batch_id"))
    return scores.join(last, ["etf_code", "batch_id"], "left_semi")


def merge_tags(
    rule: DataFrame, model: DataFrame, model_label: str = "model", unique: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Merge two scorers per (fund, tag): the merged tags and the conflicts.

    A rule at score 1 and confidence 1 stays and takes over the other's evidence;
    otherwise the strictly greater confidence of the model wins.  A side with a
    batch_id counts by its last batch per fund; of repeated tags the most confident counts.
    ``unique`` says that both sides have one row per fund and tag, which spares looking for
    repeats; with it a repeated tag would be merged once per row.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        if "batch_id" in df.columns:
            df = latest_scores(df)
        parts = F.struct("confidence", "score", "source", "evidence")
        if unique:
            return df.select("etf_code", "tag_id", parts.alias(mark))
        best = F.max(parts)
        return df.groupBy("etf_code", "tag_id").agg(best.alias(mark))

    pairs = side(rule, "r").join(side(model, "m"), ["etf_code", "tag_id"], "full")
    r, m = F.col("r"), F.col("m")
    both = r.isNotNull() & m.isNotNull()
    certain = (r["score"] == 1) & (r["confidence"] == 1)
    apart = (F.abs(r["score"] - m["score"]) > 0.01) | (F.abs(r["confidence"] - m["confidence"]) > 0.01)
    model_wins = both & ~certain & (m["confidence"] > r["confidence"])
    case = (
        F.when(m.isNull(), "rule_only")
        .when(r.isNull(), "model_only")
        .when(certain, "rule_certain")
        .when(model_wins, "model_stronger")
        .otherwise("rule_kept")
    )
    merged_from = (
        F.when(F.col("case") == "model_only", F.array(F.lit(model_label)))
        .when(F.col("case") == "rule_certain", F.array(F.lit("rule"), F.lit(f"{model_label}(evidence_only)")))
        .when(F.col("case") == "model_stronger", F.array(F.lit("rule"), F.lit(model_label)))
        .otherwise(F.array(F.lit("rule")))
    )
    none = F.array().cast("array<string>")
    evidence = F.when(
        F.col("case") == "rule_certain",
        F.concat(F.coalesce(r["evidence"], none), F.coalesce(m["evidence"], none)),
    ).otherwise(F.when(F.col("case").isin("model_only", "model_stronger"), m["evidence"]).otherwise(r["evidence"]))
    cased = pairs.withColumn("case", case)
    winner = F.when(F.col("case").isin("model_only", "model_stronger"), m).otherwise(r)
    tags = cased.select(
        "etf_code",
        "tag_id",
        winner["score"].alias("score"),
        winner["confidence"].alias("confidence"),
        winner["source"].alias("source"),
        evidence.alias("evidence"),
        merged_from.alias("merged_from"),
        "case",
    )
    contested = F.col("case").isin("model_stronger", "rule_kept") | ((F.col("case") == "rule_certain") & apart)
    chosen, other = F.when(model_wins, m).otherwise(r), F.when(model_wins, r).otherwise(m)
    conflicts = cased.where(contested).select(
        "etf_code",
        "tag_id",
        F.when(model_wins, model_label).otherwise("rule").alias("selected_source"),
        chosen["score"].alias("selected_score"),
        chosen["confidence"].alias("selected_confidence"),
        other["score"].alias("other_score"),
        other["confidence"].alias("other_confidence"),
        F.when(F.col("case") == "rule_certain", "certain_rule").otherwise("greater_confidence").alias("reason"),
    )
    return tags, conflicts


def judged(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tags the taxonomy enables, with ``passes`` saying whether both minimums are met."""
    minimums = taxonomy.where("enabled").select(
        F.col("id").alias("tag_id"), "minimum_score", "minimum_confidence"
    )
    passes = (F.col("score") >= F.col("minimum_score")) & (
        F.col("confidence") >= F.col("minimum_confidence")
    )
    return tags.join(minimums, "tag_id").withColumn("passes", passes)


def filter_map(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Funds that pass each tag's minimums, best first within the tag."""
    passing = judged(tags, taxonomy).where("passes").select("tag_id", "etf_code", "score", "confidence")
    order = [F.col("score").desc(), F.col("confidence").desc(), F.col("etf_code").asc()]
    return with_position(passing, order, by=["tag_id"])


def low_confidence(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return judged(tags, taxonomy).where(~F.col("passes")).select(
        "etf_code", "tag_id", "score", "confidence", "minimum_score", "minimum_confidence"
    )


def unclassified(funds: DataFrame, tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Funds without a passing tag, and why.  ``funds``: etf_code, is_scored."""
    per_fund = tags.groupBy("etf_code").agg(F.count(F.lit(1)).alias("_tags"))
    passing = judged(tags, taxonomy).where("passes").select("etf_code").distinct()
    rest = funds.join(passing, "etf_code", "left_anti").join(per_fund, "etf_code", "left")
    reason = (
        F.when(F.col("_tags") > 0, "below_minimums")
        .when(F.col("is_scored"), "scored_without_tags")
        .otherwise("not_scored")
    )
    return rest.select("etf_code", reason.alias("reason"))


def tag_counts(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Passing and failing funds per tag."""
    return (
        judged(tags, taxonomy)
        .groupBy("tag_id")
        .agg(F.count_if("passes").alias("funds"), F.count_if(~F.col("passes")).alias("low_confidence"))
    )


def tagging_totals(funds: DataFrame, tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Active filters, tagged, low-confidence and unclassified counts."""
    per_fund = judged(tags, taxonomy).groupBy("etf_code").agg(
        F.count_if("passes").alias("_passing"), F.count_if(~F.col("passes")).alias("_low")
    )
    totals = funds.select("etf_code").join(per_fund, "etf_code", "left").agg(
        F.count_if(F.col("_passing") > 0).alias("tagged_funds"),
        F.coalesce(F.sum("_low"), F.lit(0)).alias("low_confidence_rows"),
        F.count_if(F.coalesce("_passing", F.lit(0)) == 0).alias("unclassified_funds"),
    )
    active = tag_counts(tags, taxonomy).agg(F.count_if(F.col("funds") > 0).alias("active_filters"))
    both = totals.unionByName(active, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def batch_gaps(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Codes a batch lacks and codes nobody asked for."""
    key = ["batch_id", "etf_code"]
    seen, asked = results.select(*key).distinct(), expected.select(*key).distinct()
    lacking = asked.join(seen, key, "left_anti").withColumn("gap", F.lit("missing"))
    extra = seen.join(asked, key, "left_anti").withColumn("gap", F.lit("unexpected"))
    return lacking.unionByName(extra)


def batch_states(checked: DataFrame, gaps: DataFrame, batches: DataFrame) -> DataFrame:
    """``done`` when nothing is missing, unexpected or wrong, else ``needs_review``."""
    wrong = checked.groupBy("batch_id").agg(
        F.count_if(F.col("verdict").startswith("error")).alias("errors"),
        F.count_if(F.col("verdict").startswith("warning")).alias("warnings"),
    )
    open_codes = gaps.groupBy("batch_id").agg(
        F.count_if(F.col("gap") == "missing").alias("missing"),
        F.count_if(F.col("gap") == "unexpected").alias("unexpected"),
    )
    counts = ["errors", "warnings", "missing", "unexpected"]
    joined = batches.select("batch_id").distinct().join(wrong, "batch_id", "left").join(
        open_codes, "batch_id", "left"
    ).fillna(0, counts)
    clean = (F.col("errors") == 0) & (F.col("missing") == 0) & (F.col("unexpected") == 0)
    return joined.withColumn("state", F.when(clean, "done").otherwise("needs_review"))


def accepted_scores(checked: DataFrame) -> DataFrame:
    """Kept scores of funds without any error; the others wait for review."""
    faulty = checked.where(F.col("verdict").startswith("error")).select("batch_id", "etf_code").distinct()
    return checked.where(F.col("verdict") == "ok").join(faulty, ["batch_id", "etf_code"], "left_anti")


def candidate_rollup(candidates: DataFrame) -> DataFrame:
    """Matched funds and average numbers per candidate label."""
    # One row per (label, category, fund) first: a hot label is combined before it moves.
    per_fund = candidates.groupBy("label", "category", "etf_code").agg(
        F.count(F.lit(1)).alias("_n"),
        exact_sum("score", 6).alias("_score"),
        exact_sum("confidence", 6).alias("_confidence"),
    )
    n = F.sum("_n")
    return per_fund.groupBy("label", "category").agg(
        F.count(F.lit(1)).alias("matched_funds"),
        half_up(exact_sum("_score", 6) / n, 4).alias("average_score"),
        half_up(exact_sum("_confidence", 6) / n, 4).alias("average_confidence"),
    )


def sample_by_category(
    records: DataFrame,
    categories: Sequence[tuple[str, str, str | None]] = SAMPLE_CATEGORIES,
    extra: str | None = COMPLEX_CATEGORY,
) -> DataFrame:
    """First record of each category that no earlier category took.

    ``records``: ord, etf_code, name.  With k categories, the first k candidates
    of each are enough to decide, so the sequential part sees at most k * k rows.
    ``extra`` adds a last category for names with two or more hints.  Of the columns
    holdings_count, benchmark_name and type_text those that are there must not all be empty.
    """
    facts = [c for c in ("holdings_count", "benchmark_name", "type_text") if c in records.columns]
    if facts:
        records = records.where(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("0")) for c in facts]).isNotNull())
    tests = []
    for _, pattern, excluded in categories:
        hit = F.col("name").rlike(java_pattern(pattern))
        tests.append(hit & ~F.col("name").rlike(java_pattern(excluded)) if excluded else hit)
    labels = [label for label, _, _ in categories]
    if extra:
        tests.append(F.size(name_hints("name")) >= 2)
        labels.append(extra)
    places = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]))
    matched = records.select("ord", "etf_code", "name", F.explode(places).alias("place"))
    first = top_per_key(matched, "place", [F.col("ord").asc()], len(labels))
    lists = first.groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("ord", "etf_code", "name"))).alias("candidates")
    )
    everything = lists.agg(F.map_from_entries(F.collect_list(F.struct("place", "candidates"))).alias("by_place"))
    pick_type = "struct<used:array<string>,picks:array<struct<place:int,etf_code:string,name:string>>>"
    start = F.from_json(F.lit('{"used":[],"picks":[]}'), pick_type)

    def choose(state: Column, place: Column) -> Column:
        free = F.filter(
            F.coalesce(F.col("by_place")[place], F.expr("cast(array() as array<struct<ord:bigint,etf_code:string,name:string>>)")),
            lambda c: ~F.array_contains(state["used"], c["etf_code"]),
        )
        hit = F.get(free, F.lit(0))
        picked = F.struct(
            place.alias("place"), hit["etf_code"].alias("etf_code"), hit["name"].alias("name")
        )
        used = F.when(hit.isNull(), state["used"]).otherwise(
            F.array_append(state["used"], F.coalesce(hit["etf_code"], F.lit("")))
        )
        return F.struct(used.alias("used"), F.array_append(state["picks"], picked).alias("picks")).cast(pick_type)

    order = F.array(*[F.lit(i) for i in range(len(labels))])
    chosen = everything.select(F.aggregate(order, start, choose)["picks"].alias("picks"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("place") + 1)
    return chosen.select(F.inline("picks")).select(
        "place", label.alias("category"), "etf_code", "name"
    )


def assign_batches(
    records: DataFrame, size: int = BATCH_SIZE, start: int = 1, done: DataFrame | None = None
) -> DataFrame:
    """Consecutive batches of ``size`` records in input order, finished ones left out."""
    placed = with_position(records, [F.col("ord").asc()], name="_place")
    number = F.floor((F.col("_place") - 1) / size).cast("bigint") + start
    named = placed.withColumn(
        "batch_id", F.concat(F.lit("batch-"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")))
    ).drop("_place")
    if done is not None:
        finished = done.where(F.col("status") == "done").select("batch_id").distinct()
        named = named.join(finished, "batch_id", "left_anti")
    return named


def subset(records: DataFrame, codes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Records with one of the given codes, and of those the first ``limit`` in input order."""
    if codes is not None:
        records = records.join(codes.select("etf_code").distinct(), "etf_code", "left_semi")
    return records if limit is None else records.orderBy("ord").limit(limit)


def compact_records(records: DataFrame, holdings: DataFrame, n: int = 10) -> DataFrame:
    """Scorer input: one JSON text per fund with its ``n`` largest holdings."""
    best = top_per_key(
        holdings, "etf_code", [F.coalesce("weight", F.lit(0.0)).desc(), F.col("rank").asc()], n, "_place"
    )
    lists = best.groupBy("etf_code").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_place", "code", "name", "weight"))),
            lambda h: F.struct(h["code"].alias("code"), h["name"].alias("name"), h["weight"].alias("weight")),
        ).alias("holdings")
    )
    body = F.to_json(F.struct(*records.columns, "holdings"), {"ignoreNullFields": "false"})
    return records.join(lists, "etf_code", "left").select("etf_code", body.alias("body"))


def input_stats(inputs: DataFrame, text: str = "body") -> DataFrame:
    """Size of the scorer's input in characters and estimated tokens."""
    chars = F.length(text).cast("bigint")
    totals = inputs.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"),
        F.coalesce(F.sum(token_estimate(chars)), F.lit(0)).alias("total_tokens"),
    )

    def mean(c: str) -> Column:
        return F.coalesce(half_up(F.col(c) / F.nullif(F.col("records"), F.lit(0))), F.lit(0.0)).cast("bigint")

    return totals.select(
        "records", "total_chars", "total_tokens",
        mean("total_chars").alias("avg_chars"), mean("total_tokens").alias("avg_tokens"),
    )


def work_forecast(covered: DataFrame, ledger: DataFrame, batch: int = BATCH_SIZE) -> DataFrame:
    """Coverage buckets, what is scored already, and the batches still to run."""
    scored = ledger.select("etf_code", F.lit(1).alias("_scored")).distinct()
    score = F.col("coverage_score")
    totals = covered.select("etf_code", "coverage_score").join(scored, "etf_code", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(score >= 0.75).alias("high"),
        F.count_if((score >= 0.45) & (score < 0.75)).alias("low"),
        F.count_if(F.coalesce(score < 0.45, F.lit(True))).alias("needs_more"),
        F.count("_scored").alias("already_scored"),
    )
    remaining = F.col("total") - F.col("already_scored")
    return totals.withColumn("remaining", remaining).withColumn(
        "batches", F.ceil(F.col("remaining") / batch).cast("bigint")
    )

