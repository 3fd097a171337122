"""The registered queries of this package, each on whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Catalog
from . import (
    chat, decontaminate, extraction, near_dup, packing, pii, quality, repair, sharding, token_counts, topk, url_filter, whitening,
)

catalog = Catalog()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(role, '(<|\[)(\\*)(/?)(s>|INST\])', '\1\\\2\3\4', 'g') AS shown_role,
         regexp_replace(text, '(<|\[)(\\*)(/?)(s>|INST\])', '\1\\\2\3\4', 'g') AS shown_text FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST] ' || shown_role || ' [/INST]' || chr(10) || shown_text || '</s>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"""
OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} FROM documents),
items AS (SELECT item_id, {_WORDS} FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, i, n, k FROM places JOIN windows USING (n, k)),
hit AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found),
runs AS (
  SELECT r, min(p) - 1 AS start, count(*) AS n FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM hit)
  GROUP BY r, g),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, start) = 1),
hits AS (SELECT r, count(*) AS n_hit FROM hit GROUP BY r),
named AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found JOIN windows USING (n, k)),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, l.n AS longest_hit, l.start AS longest_at
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r) LEFT JOIN longest l USING (r)"""

OP6_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, w[i] || ' ' || w[i + 1] AS s FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs WHERE len(w) > 1)
  UNION ALL SELECT r, w[1] FROM docs WHERE len(w) = 1),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.r < b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(r, other) AS (
  SELECT r, r FROM docs UNION SELECT reached.r, b FROM reached JOIN both_ways ON other = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM docs d LEFT JOIN sizes USING (r) JOIN reached USING (r) JOIN docs o ON o.r = other GROUP BY d.r, d.doc_id, n"""

_RULES = sorted(url_filter.RULES, key=lambda x: -len(x[0] + x[1]))
_FITS = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in _RULES]
_K = url_filter.SMOOTH
_LEVELS = "l0 AS (SELECT *, '' AS upper, '' AS above, '' AS template FROM whole)," + "".join(
    f"""
w{k} AS (
  SELECT *, sum(n) OVER (PARTITION BY host, template, segment) AS child, sum(n) OVER (PARTITION BY host, template, segment IS NULL) AS total,
    count(DISTINCT segment) OVER (PARTITION BY host, template) AS fan FROM (SELECT *, lexical[{k}] AS segment FROM l{k - 1})),
l{k} AS (
  SELECT host, lexical, n, labelled, blocked, CASE WHEN segment IS NULL THEN upper ELSE above END AS upper,
    CASE WHEN segment IS NULL THEN above ELSE template END AS above,
    CASE WHEN segment IS NULL THEN template
      ELSE {"''" if k == 1 else "template || '/'"} || CASE WHEN fan >= {url_filter.FAN} AND child * {url_filter.KEPT} < total THEN '*' ELSE segment END
    END AS template FROM w{k}),"""
    for k in range(1, url_filter.DEPTH + 1)
)


def _alike(name: str, rows: str, by: str, of: str) -> str:
    return f"""{name}_shares AS (SELECT *, blocked / labelled AS share FROM {rows} WHERE labelled > 0),
{name}_pairs AS (
  SELECT *, lag(share) OVER w AS s, lag(labelled) OVER w AS m, (blocked + lag(blocked) OVER w) / (labelled + lag(labelled) OVER w) AS p
  FROM {name}_shares WINDOW w AS (PARTITION BY {by} ORDER BY share, {of})),
{name}_steps AS (
  SELECT *, sum(CASE WHEN share - s > {url_filter.SIMILAR} * sqrt(p * (1 - p) * (1 / labelled + 1 / m)) + 1e-9 THEN 1 ELSE 0 END)
    OVER (PARTITION BY {by} ORDER BY share, {of} ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_pairs),
{name} AS (
  SELECT {by}, {of}, sum(labelled) OVER g AS pooled, sum(blocked) OVER g AS pooled_blocked
  FROM {name}_steps WINDOW g AS (PARTITION BY {by}, grp))"""


OP9_SQL = f"""
WITH given AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM given),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS)} END AS rule,
         CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS)} END AS ruled,
         string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') AS plain FROM parsed),
labelled AS (
  SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS blocked,
         CASE WHEN len(plain) > {url_filter.DEPTH}
              THEN list_append(plain[1:{url_filter.DEPTH - 1}], array_to_string(plain[{url_filter.DEPTH}:], '/')) ELSE plain END AS lexical
  FROM ruled),
whole AS (
  SELECT host, lexical, count(*) AS n, count(blocked) AS labelled, coalesce(sum(blocked), 0) AS blocked
  FROM labelled GROUP BY host, lexical),
{_LEVELS}
leaves AS (SELECT host, upper, above, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM l{url_filter.DEPTH} GROUP BY ALL),
branches AS (SELECT host, upper, above, sum(labelled) AS labelled, sum(blocked) AS blocked FROM leaves GROUP BY ALL),
hosts AS (SELECT host, sum(labelled) AS labelled, sum(blocked) AS blocked FROM branches GROUP BY ALL),
overall AS (SELECT (sum(blocked) + 1) / (sum(labelled) + 2) AS p FROM hosts),
of_hosts AS (SELECT host, (blocked + p * {_K}) / (labelled + {_K}) AS of_host FROM hosts, overall),
of_uppers AS (
  SELECT host, upper, (sum(blocked) + any_value(of_host) * {_K}) / (sum(labelled) + {_K}) AS of_upper
  FROM branches JOIN of_hosts USING (host) GROUP BY host, upper),
{_alike('branch_groups', 'branches', 'host, upper', 'above')},
of_branches AS (
  SELECT b.host, b.upper, b.above, (coalesce(pooled_blocked, 0) + of_upper * {_K}) / (coalesce(pooled, 0) + {_K}) AS of_branch
  FROM branches b LEFT JOIN branch_groups USING (host, upper, above) JOIN of_uppers USING (host, upper)),
{_alike('leaf_groups', 'leaves', 'host, upper, above', 'template')},
purities AS (
  SELECT l.host, l.upper, l.above, l.template, (coalesce(pooled_blocked, 0) + of_branch * {_K}) / (coalesce(pooled, 0) + {_K}) AS purity
  FROM leaves l LEFT JOIN leaf_groups USING (host, upper, above, template) JOIN of_branches USING (host, upper, above)),
judged AS (SELECT f.host, f.lexical, f.template, purity FROM l{url_filter.DEPTH} f JOIN purities USING (host, upper, above, template))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM labelled JOIN judged USING (host, lexical)"""


@catalog.query("op1_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@catalog.query("op2_hilbert_shards")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    content = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, folder, "documents").select(
        "doc_id", "lang", "source",
        (F.octet_length(content) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    sharded = sharding.shard(slim, ["lang", "source", "size"], ["text_crc32", "doc_id"], 8, "rows")
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@catalog.query("op3_chat_format", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_chat(turns.unionByName(control)))


@catalog.query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@catalog.query("op4_longest_matches")
def op4_longest(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.longest_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@catalog.query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, folder, "documents"), file, "byte")


@catalog.query("op6_exact_top_k", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@catalog.query("op7_near_duplicates", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), similarity=0.8, words_each=2)


@catalog.query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@catalog.query("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages")).drop("purity")


@catalog.query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, folder, "documents"), file, "word")


@catalog.query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, folder, "conversations"))


@catalog.query("op12_html_extraction")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


@catalog.query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))
