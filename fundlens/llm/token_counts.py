"""Token counts with a digest cache.

A text is known by the SHA-256 of its content, a tokenizer by the digest of its file and the
library's version.  The cache is a Parquet table of (digest, version, n_tokens) in a shared
folder.  Counting joins the documents' digests to it, encodes each distinct miss once,
appends those, and joins again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import folder_names, materialize, new_path
from .columns import annotate
from .tokens import Encoder, version

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Counts known for one tokenizer version, one row per digest; empty if there is no cache yet."""
    if not folder_names(spark, path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == tokenizer)
    # Two jobs may have appended the same digest.
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    documents: DataFrame, tokenizer_file: str, style: str, cache: str | None = None, limit: int = 512
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``documents`` (doc_id, text).

    The content that is hashed is the text itself, null as an empty text: any further
    normalisation would give one count to texts that the tokenizer tells apart.  Repeated
    rows and equal texts are encoded once and keep a row each; a null doc_id stays null.
    Other columns, whatever their names, are not looked at.  ``cache`` is a folder all
    executors share; without one the counts go to a new scratch table.  The cache grows when
    this function is called; the DataFrame it returns reads it.

    Texts are deduplicated before they are shuffled, so a hot text leaves each map task once;
    the last join carries digests only, and adaptive execution splits a hot one.
    """
    spark = documents.sparkSession
    cache = cache or new_path(spark, "token-cache")
    known = version(tokenizer_file)
    content = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select("doc_id", content.alias("content"), F.unhex(F.sha2(content, 256)).alias("digest"))

    def start():
        encoder = Encoder(tokenizer_file, style)

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([len(x) // 4 for x in encoder.many(texts.to_pylist())], pa.int64())]

        return work

    distinct = keyed.select("digest", "content").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache, known), "digest", "left_anti")
    counted = annotate(misses, ["content"], "n_tokens bigint", start, keep=["digest"])
    counted.select("digest", F.lit(known).alias("version"), "n_tokens").write.mode("append").parquet(cache)

    # Written, so that adaptive execution can split a hot digest in the join.
    counts = materialize(read_cache(spark, cache, known), "counts")
    slim = keyed.select("doc_id", "digest", F.octet_length("content").cast("bigint").alias("n_bytes"))
    return slim.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
