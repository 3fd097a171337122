"""Queries over tags, scorer batches and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata as meta
from ..operators import quality, tagging
from ..sources import tables
from . import records as record_plans
from . import sql as q
from .registry import catalog

_SCHEDULED = "renamed AS (SELECT *, schedule AS distribution_schedule_text FROM records)"


def _rule_sql(rule: tagging.TagRule) -> str:
    pattern = ("(?i)" if "i" in rule.flags else "") + rule.pattern
    hit = {f: f"regexp_matches({f}, '{pattern}')" for f in rule.match_fields}
    field = " ".join(f"WHEN {test} THEN '{f}'" for f, test in hit.items())
    text = " ".join(f"WHEN {test} THEN {f}" for f, test in hit.items())
    return f"""SELECT etf_code, '{rule.tag_id}' AS tag_id, CAST({rule.score} AS DOUBLE) AS score,
  CAST({rule.confidence} AS DOUBLE) AS confidence,
  CASE {field} END || '="' || CASE {text} END || '" matched /{rule.pattern}/{rule.flags}' AS evidence
FROM renamed WHERE {' OR '.join(hit.values())}"""


_RULES = "rule AS (\n" + "\nUNION ALL ".join(_rule_sql(r) for r in tagging.TAG_RULES) + ")"
_MODEL_TAGS = {"A": "strategy.leverage", "N": "dividend.covered_call", "R": "strategy.sp500"}
_MODEL = f"""model AS (
  SELECT {q.code('l_partkey')} AS etf_code, {q.case('l_returnflag', _MODEL_TAGS)} AS tag_id,
         greatest(0.0, least(1.0, {q.exact_mean('l_discount')} * 20)) AS score,
         greatest(0.0, least(1.0, {q.exact_mean('l_tax')} * 24)) AS confidence,
         'flag=' || l_returnflag AS evidence
  FROM lineitem GROUP BY l_partkey, l_returnflag)"""
_MERGED = """cased AS (
  SELECT coalesce(r.etf_code, m.etf_code) AS etf_code, coalesce(r.tag_id, m.tag_id) AS tag_id,
    r.score AS rs, r.confidence AS rc, r.evidence AS re, m.score AS ms, m.confidence AS mc, m.evidence AS me,
    CASE WHEN m.etf_code IS NULL THEN 'rule_only' WHEN r.etf_code IS NULL THEN 'model_only'
         WHEN r.score = 1 AND r.confidence = 1 THEN 'rule_certain'
         WHEN m.confidence > r.confidence THEN 'model_stronger' ELSE 'rule_kept' END AS "case"
  FROM rule r FULL JOIN model m ON r.etf_code = m.etf_code AND r.tag_id = m.tag_id),
tags AS (
  SELECT etf_code, tag_id, "case",
    CASE WHEN "case" IN ('model_only', 'model_stronger') THEN ms ELSE rs END AS score,
    CASE WHEN "case" IN ('model_only', 'model_stronger') THEN mc ELSE rc END AS confidence,
    CASE "case" WHEN 'rule_certain' THEN re || ' ; ' || me WHEN 'model_only' THEN me
         WHEN 'model_stronger' THEN me ELSE re END AS evidence,
    CASE "case" WHEN 'model_only' THEN 'model' WHEN 'rule_certain' THEN 'rule+model(evidence_only)'
         WHEN 'model_stronger' THEN 'rule+model' ELSE 'rule' END AS merged_from
  FROM cased)"""
_TAXONOMY = (
    "taxonomy(id, minimum_score, minimum_confidence) AS (VALUES "
    + ", ".join(f"('{i}', CAST({s} AS DOUBLE), CAST({c} AS DOUBLE))" for i, _, _, s, c in tagging.TAXONOMY)
    + ")"
)
_JUDGED = """judged AS (
  SELECT t.*, minimum_score, minimum_confidence,
         score >= minimum_score AND confidence >= minimum_confidence AS passes
  FROM tags t JOIN taxonomy x ON t.tag_id = x.id)"""
TAGS = (q.RECORDS, _SCHEDULED, _RULES, _MODEL, _MERGED)
JUDGED = (*TAGS, _TAXONOMY, _JUDGED)


def rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.rule_tags(tables.fund_records(spark, folder))


def merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # One record per product, each rule once; scores are grouped by product and flag.
    return tagging.merge_tags(rule_rows(spark, folder), tables.model_scores(spark, folder), unique=True)


def fund_list(spark: SparkSession, folder: str) -> DataFrame:
    """All products, with whether the second scorer has seen them."""
    scored = tables.model_scores(spark, folder).select("etf_code", F.lit(True).alias("_seen")).distinct()
    return tables.fund_records(spark, folder).select("etf_code").join(scored, "etf_code", "left").select(
        "etf_code", F.coalesce("_seen", F.lit(False)).alias("is_scored")
    )


@catalog.query(
    "rule_tags",
    q.given(q.RECORDS, _SCHEDULED, _RULES) + "SELECT etf_code, tag_id, score, confidence, evidence FROM rule",
)
def rule_tags(spark: SparkSession, folder: str) -> DataFrame:
    return rule_rows(spark, folder).select(
        "etf_code", "tag_id", "score", "confidence", F.array_join("evidence", " ; ").alias("evidence")
    )


@catalog.query(
    "rule_counts",
    q.given(q.RECORDS, _SCHEDULED, _RULES)
    + """SELECT (SELECT count(*) FROM records) AS records, count(DISTINCT etf_code) AS tagged FROM rule""",
)
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    records = tables.fund_records(spark, folder)
    return tagging.rule_counts(records, tagging.rule_tags(records))


@catalog.query(
    "tag_merge",
    q.given(*TAGS) + 'SELECT etf_code, tag_id, score, confidence, evidence, merged_from, "case" FROM tags',
)
def tag_merge(spark: SparkSession, folder: str) -> DataFrame:
    tags, _ = merged(spark, folder)
    return tags.select(
        "etf_code", "tag_id", "score", "confidence", F.array_join("evidence", " ; ").alias("evidence"),
        F.array_join("merged_from", "+").alias("merged_from"), "case",
    )


@catalog.query(
    "tag_conflicts",
    q.given(*TAGS)
    + """SELECT etf_code, tag_id,
  CASE WHEN "case" = 'model_stronger' THEN 'model' ELSE 'rule' END AS selected_source,
  CASE WHEN "case" = 'model_stronger' THEN ms ELSE rs END AS selected_score,
  CASE WHEN "case" = 'model_stronger' THEN mc ELSE rc END AS selected_confidence,
  CASE WHEN "case" = 'model_stronger' THEN rs ELSE ms END AS other_score,
  CASE WHEN "case" = 'model_stronger' THEN rc ELSE mc END AS other_confidence,
  CASE WHEN "case" = 'rule_certain' THEN 'certain_rule' ELSE 'greater_confidence' END AS reason
FROM cased WHERE "case" IN ('model_stronger', 'rule_kept')
  OR ("case" = 'rule_certain' AND (abs(rs - ms) > 0.01 OR abs(rc - mc) > 0.01))""",
)
def tag_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder)[1]


@catalog.query(
    "filter_map",
    q.given(*JUDGED)
    + """SELECT tag_id, etf_code, score, confidence,
  row_number() OVER (PARTITION BY tag_id ORDER BY score DESC, confidence DESC, etf_code) AS position
FROM judged WHERE passes""",
)
def filter_map(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.filter_map(merged(spark, folder)[0], tagging.taxonomy(spark))


@catalog.query(
    "low_confidence",
    q.given(*JUDGED)
    + """SELECT etf_code, tag_id, score, confidence, minimum_score, minimum_confidence
FROM judged WHERE NOT passes""",
)
def low_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.low_confidence(merged(spark, folder)[0], tagging.taxonomy(spark))


@catalog.query(
    "unclassified",
    q.given(*JUDGED)
    + """SELECT etf_code, CASE WHEN etf_code IN (SELECT etf_code FROM tags) THEN 'below_minimums'
  WHEN etf_code IN (SELECT etf_code FROM model) THEN 'scored_without_tags' ELSE 'not_scored' END AS reason
FROM records WHERE etf_code NOT IN (SELECT etf_code FROM judged WHERE passes)""",
)
def unclassified(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.unclassified(
        fund_list(spark, folder), merged(spark, folder)[0], tagging.taxonomy(spark)
    )


@catalog.query(
    "tag_counts",
    q.given(*JUDGED)
    + """SELECT tag_id, count(*) FILTER (WHERE passes) AS funds,
  count(*) FILTER (WHERE NOT passes) AS low_confidence FROM judged GROUP BY tag_id""",
)
def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.tag_counts(merged(spark, folder)[0], tagging.taxonomy(spark))


@catalog.query(
    "tagging_totals",
    q.given(*JUDGED)
    + """SELECT count(DISTINCT etf_code) FILTER (WHERE passes) AS tagged_funds,
  count(*) FILTER (WHERE NOT passes) AS low_confidence_rows,
  (SELECT count(*) FROM records WHERE etf_code NOT IN (SELECT etf_code FROM judged WHERE passes))
    AS unclassified_funds,
  count(DISTINCT tag_id) FILTER (WHERE passes) AS active_filters FROM judged""",
)
def tagging_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.tagging_totals(
        fund_list(spark, folder), merged(spark, folder)[0], tagging.taxonomy(spark)
    )


@catalog.query(
    "review_override",
    q.given(_MODEL)
    + f""", reviewed AS (SELECT {q.code('p_partkey')} AS etf_code, p_size FROM part WHERE p_size >= 49)
SELECT etf_code, tag_id, score, confidence FROM model WHERE etf_code NOT IN (SELECT etf_code FROM reviewed)
UNION ALL SELECT etf_code, 'strategy.value', 0.9, 0.9 FROM reviewed
WHERE p_size = 50 AND etf_code IN (SELECT etf_code FROM model)""",
)
def review_override(spark: SparkSession, folder: str) -> DataFrame:
    """Products of size 50 get one corrected tag, those of size 49 an empty list."""
    corrected = F.when(
        F.col("p_size") == 50,
        F.array(
            F.struct(
                F.lit("strategy.value").alias("tag_id"), F.lit(0.9).alias("score"),
                F.lit(0.9).alias("confidence"),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<tag_id:string,score:double,confidence:double>>)"))
    reviews = tables.read(spark, folder, "part").where(F.col("p_size") >= 49).select(
        F.col("p_partkey").alias("ord"), tables.code_of("p_partkey").alias("etf_code"),
        corrected.alias("corrected"),
    )
    return tagging.apply_reviews(tables.model_scores(spark, folder), reviews).select(
        "etf_code", "tag_id", "score", "confidence"
    )


_BATCHES = f"""asked AS (SELECT source AS batch_id, {q.code('doc_id')} AS etf_code FROM documents),
results AS (
  SELECT source AS batch_id, {q.code('doc_id')} AS etf_code, 0 AS pos,
    CASE lang WHEN 'en' THEN 'sector.it' WHEN 'de' THEN 'sector.unlisted' ELSE 'sector.financials' END AS tag_id,
    CAST(quality * 0.9 AS DOUBLE) AS score, CASE WHEN toxic = 0 THEN CAST(1.5 AS DOUBLE) END AS confidence
  FROM labels JOIN documents USING (doc_id)
  UNION ALL
  SELECT source, {q.code('doc_id')}, 1, CASE WHEN quality = 1 THEN 'sector.it' ELSE 'strategy.value' END, 0.8, 0.7
  FROM labels JOIN documents USING (doc_id)),
clamped AS (
  SELECT *, greatest(0.0, least(1.0, score)) AS score_01,
         CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, confidence)) END AS confidence_01,
         tag_id IN (SELECT id FROM taxonomy) AS known FROM results),
checked AS (
  SELECT batch_id, etf_code, pos, tag_id, score_01, confidence_01,
    CASE WHEN NOT known THEN 'error:unknown_tag'
         WHEN pos > min(CASE WHEN known AND score_01 IS NOT NULL AND confidence_01 IS NOT NULL THEN pos END)
              OVER (PARTITION BY batch_id, etf_code, tag_id) THEN 'warning:duplicate_tag'
         WHEN score_01 IS NULL OR confidence_01 IS NULL THEN 'error:bad_number' ELSE 'ok' END AS verdict
  FROM clamped)"""


def checked_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    results, asked = tables.label_batches(spark, folder)
    return quality.check_scores(results, tagging.taxonomy(spark), asked), results, asked


@catalog.query(
    "score_check",
    q.given(_TAXONOMY, _BATCHES)
    + "SELECT batch_id, etf_code, pos, tag_id, score_01, confidence_01, verdict FROM checked",
)
def score_check(spark: SparkSession, folder: str) -> DataFrame:
    return checked_scores(spark, folder)[0].select(
        "batch_id", "etf_code", "pos", "tag_id", "score_01", "confidence_01", "verdict"
    )


@catalog.query(
    "accepted_scores",
    q.given(_TAXONOMY, _BATCHES)
    + """SELECT etf_code, tag_id, score_01, confidence_01 FROM checked c WHERE verdict = 'ok'
AND etf_code NOT IN (SELECT etf_code FROM checked WHERE verdict LIKE 'error%')""",
)
def accepted_scores(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.accepted_scores(checked_scores(spark, folder)[0]).select(
        "etf_code", "tag_id", "score_01", "confidence_01"
    )


@catalog.query(
    "batch_completeness",
    q.given(_TAXONOMY, _BATCHES)
    + """SELECT batch_id, etf_code, 'missing' AS gap FROM asked
WHERE etf_code NOT IN (SELECT etf_code FROM results)""",
)
def batch_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.batch_gaps(*tables.label_batches(spark, folder))


@catalog.query(
    "batch_states",
    q.given(_TAXONOMY, _BATCHES)
    + """, counted AS (
  SELECT a.batch_id,
    (SELECT count(*) FROM checked c WHERE c.batch_id = a.batch_id AND verdict LIKE 'error%') AS errors,
    (SELECT count(*) FROM checked c WHERE c.batch_id = a.batch_id AND verdict LIKE 'warning%') AS warnings,
    count(*) FILTER (WHERE etf_code NOT IN (SELECT etf_code FROM results)) AS missing,
    CAST(0 AS BIGINT) AS unexpected
  FROM asked a GROUP BY a.batch_id)
SELECT *, CASE WHEN errors = 0 AND missing = 0 THEN 'done' ELSE 'needs_review' END AS state FROM counted""",
)
def batch_states(spark: SparkSession, folder: str) -> DataFrame:
    checked, results, asked = checked_scores(spark, folder)
    return tagging.batch_states(checked, tagging.batch_gaps(results, asked), asked)


@catalog.query(
    "batch_assign",
    f"""WITH numbered AS (
  SELECT {q.code('doc_id')} AS etf_code,
         'batch-' || format('{{:04d}}', CAST((row_number() OVER (ORDER BY doc_id) - 1) // 15 + 1 AS BIGINT)) AS batch_id
  FROM documents)
SELECT etf_code, batch_id FROM numbered WHERE batch_id NOT IN (
  SELECT 'batch-' || format('{{:04d}}', doc_id) FROM labels WHERE toxic = 1)""",
)
def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in batches of 15; batches numbered like a toxic document are done already."""
    records = tables.read(spark, folder, "documents").select(
        F.col("doc_id").alias("ord"), tables.code_of("doc_id").alias("etf_code")
    )
    number = F.col("doc_id").cast("string")
    done = tables.read(spark, folder, "labels").where(F.col("toxic") == 1).select(
        F.concat(F.lit("batch-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("batch_id"),
        F.lit("done").alias("status"),
    )
    return tagging.assign_batches(records, done=done).select("etf_code", "batch_id")


def _sample_sql() -> str:
    tests = []
    for _, pattern, excluded in tagging.SAMPLE_CATEGORIES:
        test = f"regexp_matches(name, '{pattern}')"
        tests.append(test + (f" AND NOT regexp_matches(name, '{excluded}')" if excluded else ""))
    tests.append(f"len(list_filter([{record_plans._HINTS}], lambda x: x IS NOT NULL)) >= 2")
    matched = "\nUNION ALL ".join(
        f"SELECT {i} AS place, ord, etf_code, name FROM records WHERE benchmark_name IS NOT NULL AND {test}" for i, test in enumerate(tests)
    )
    labels = [c[0] for c in tagging.SAMPLE_CATEGORIES] + [tagging.COMPLEX_CATEGORY]
    named = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    pick = """(SELECT arg_min({c}, ord) FROM matched m WHERE m.place = s.place + 1
      AND NOT list_contains(s.used, m.etf_code))"""
    code = pick.format(c="etf_code")
    return f"""WITH RECURSIVE {q.RECORDS}, matched AS ({matched}),
labels(place, category) AS (VALUES {named}),
steps AS (
  SELECT -1 AS place, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS etf_code, CAST(NULL AS VARCHAR) AS name
  UNION ALL
  SELECT place + 1, CASE WHEN {code} IS NULL THEN used ELSE list_append(used, {code}) END, {code}, {pick.format(c='name')}
  FROM steps s WHERE place < {len(tests) - 1})
SELECT s.place, category, etf_code, name FROM steps s JOIN labels l ON s.place = l.place"""


@catalog.query("sample_pick", _sample_sql())
def sample_pick(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.sample_by_category(tables.fund_records(spark, folder))


_CANDIDATE_CATEGORY = {"en": "sector", "fr": "strategy", "de": "dividend"}


@catalog.query(
    "candidate_tags",
    f"""WITH candidates AS (
  SELECT source AS label, {q.case('lang', _CANDIDATE_CATEGORY, "'other'")} AS category,
         greatest(0.0, least(1.0, n_chars / 10000.0)) AS score, CAST(0.5 AS DOUBLE) AS confidence, doc_id
  FROM documents)
SELECT label, category, count(DISTINCT doc_id) AS matched_funds,
  {q.half_up("CAST(sum(CAST(score AS DECIMAL(28,6))) AS DOUBLE) / count(*)", 4)} AS average_score,
  {q.half_up("CAST(sum(CAST(confidence AS DECIMAL(28,6))) AS DOUBLE) / count(*)", 4)} AS average_confidence
FROM candidates WHERE category <> 'other' GROUP BY label, category""",
)
def candidate_tags(spark: SparkSession, folder: str) -> DataFrame:
    candidates = tables.read(spark, folder, "documents").select(
        tables.code_of("doc_id").alias("etf_code"),
        F.col("source").alias("label"),
        tables.mapped("lang", _CANDIDATE_CATEGORY, "other").alias("category"),
        (F.col("n_chars") / 10000.0).alias("score"),
        F.lit(0.5).alias("confidence"),
    )
    return tagging.candidate_rollup(quality.candidate_tags(candidates))


@catalog.query(
    "input_stats",
    """SELECT count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  CAST(sum(ceil(length(text) / 2.2)) AS BIGINT) AS total_tokens,
  CAST(floor(sum(length(text)) / count(*) + 0.5) AS BIGINT) AS avg_chars,
  CAST(floor(sum(ceil(length(text) / 2.2)) / count(*) + 0.5) AS BIGINT) AS avg_tokens FROM documents""",
)
def input_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.input_stats(tables.read(spark, folder, "documents"), "text")


@catalog.query(
    "work_forecast",
    q.given(*record_plans.RECORDS, record_plans._COVERED)
    + f""", scored AS (SELECT DISTINCT {q.code('doc_id')} AS etf_code FROM labels),
totals AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE coverage_score >= 0.75) AS high,
    count(*) FILTER (WHERE coverage_score >= 0.45 AND coverage_score < 0.75) AS low,
    count(*) FILTER (WHERE coverage_score < 0.45) AS needs_more,
    count(*) FILTER (WHERE etf_code IN (SELECT etf_code FROM scored)) AS already_scored FROM covered)
SELECT *, total - already_scored AS remaining, CAST(ceil((total - already_scored) / 15) AS BIGINT) AS batches
FROM totals""",
)
def work_forecast(spark: SparkSession, folder: str) -> DataFrame:
    covered = meta.coverage(record_plans.integrated(spark, folder))
    ledger = tables.read(spark, folder, "labels").select(tables.code_of("doc_id").alias("etf_code"))
    return tagging.work_forecast(covered, ledger)
