"""Cases that once went wrong: repeated ids, clashing names, odd rows in the pipeline."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fundlens.llm import decontaminate, near_dup, quality, sharding, tokens

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))
DOCS = "doc_id bigint, text string"


def kept(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", class int").repartition(4)
    return sorted(((r.doc_id, r.text) for r in near_dup.keep_one(df).select("doc_id", "text", "class").collect()), key=repr)


def test_keep_one_judges_each_text_of_an_id(spark):
    assert kept(spark, [(5, A), (5, B), (3, B)]) == [(3, B), (5, A)]


def test_keep_one_of_repeated_and_missing_ids(spark):
    rows = [(1, A), (2, A), (2, A), (None, A), (4, None), (5, ""), (6, B), (6, B)]
    assert kept(spark, rows) == sorted([(1, A), (None, A), (4, None), (5, ""), (6, B), (6, B)], key=repr)
    assert kept(spark, []) == []


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(i, A if i % 2 else B, 1, "x", 0.5) for i in range(6)], DOCS + ", _llm_items int, _llm_runs string, _LLM_score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, B), (2, None), (None, "")], "item_id bigint, text string")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3, 5]
    good = quality.keep_good(docs, labels, threshold=0.0)
    assert good.columns == docs.columns and good.count() == 6
    named = docs.select("doc_id", "text", F.lit(9).alias("curve"), F.lit(8).alias("_part"), F.lit(7).alias("_index"), F.lit(6).alias("shard"))
    for law in ("rows", "bytes"):
        cut = sharding.shard(named.withColumn("size", F.length("text")), ["doc_id"], ["text", "doc_id"], 3, law, "size")
        assert cut.columns == ["doc_id", "text", "curve", "_part", "_index", "shard", "size", "_curve", "_shard", "slot"]
        assert {(r["curve"], r["_part"], r["_index"], r["shard"]) for r in cut.collect()} == {(9, 8, 7, 6)}
        assert sorted(r["_shard"] for r in cut.collect()) == [0, 0, 1, 1, 2, 2]


def test_hilbert_order_is_that_of_the_cells(spark):
    """Neighbours on the curve are neighbours in space, and every cell is met once."""
    bits = 3
    cells = np.array([(x, y) for x in range(1 << bits) for y in range(1 << bits)])
    index = sharding.hilbert_index([cells[:, 0], cells[:, 1]], bits)
    assert sorted(index.tolist()) == list(range(1 << 2 * bits))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_word_ids_are_the_library_s():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), "word", cached=50)
    bits = ["Word", "été", "İ", "x,", "y.\nZ", "\n", " ", "", "it's", "<|endoftext|>", "日本", "a\tb", "!!!", "ſ", "\x00", "q" * 60, "é" * 50 + ".", "A.B"]
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(bits, random.integers(0, 9))) for _ in range(600)] + ["", None, "".join(bits)]
    assert encoder.many(texts) == [encoder.whole(t) if t else b"" for t in texts]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows(spark, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(1, A, "en", "s", 5), (1, A, "en", "s", 5), (None, B, None, None, None), (2, None, "en", "s", 0), (3, "", None, None, 0), (4, "y " * 200_000, "en", "s", 1)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, shape).withColumn("class", F.lit(1)).withColumn("_llm_gone", F.lit("z"))
    out = run(spark, docs, folder)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select("doc_id").collect()} <= {(1,), (None,), (2,), (3,), (4,)}
    assert run(spark, docs.limit(0), folder).collect() == []
