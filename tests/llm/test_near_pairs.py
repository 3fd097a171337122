"""What one block of near-duplicate candidates holds while its classes are compared."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fundlens.llm import near_dup


def taken_of_all(n: int, labels: int, best: int):
    """All pairs of ``n`` members that are in different ones of ``labels`` components, at made-up distances."""
    nearest = near_dup.Nearest(n, best)
    code, member = np.arange(n) % labels, np.arange(n)
    for r in range(n):
        near = member[(code != code[r]) & (member > r)]
        ones = (near * 7 + r * 13) % 50
        nearest.add(np.minimum(code[near], code[r]), np.maximum(code[near], code[r]), ones, near * 0 + r, near)
    return nearest.taken()


def test_nearest_pairs_are_those_of_a_full_sort(monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS_HELD", 100)
    for best in (1, 5, 10_000):
        n, labels = 60, 3
        a, b, more = taken_of_all(n, labels, best)
        groups: dict = {}
        for i in range(n):
            for j in range(i + 1, n):
                if i % labels != j % labels:
                    key = tuple(sorted((i % labels, j % labels)))
                    groups.setdefault(key, []).append(((j * 7 + i * 13) % 50, i, j))
        want = {(i, j, len(g) > best) for g in groups.values() for _, i, j in sorted(g)[:best]}
        assert set(zip(a.tolist(), b.tolist(), more.tolist())) == want and len(a) == len(want)
    assert [len(x) for x in near_dup.Nearest(4, 2).taken()] == [0, 0, 0]


def test_a_block_of_like_classes_does_not_hold_all_its_pairs():
    tracemalloc.start()
    try:
        a, _, more = taken_of_all(1500, 2, 64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(a) == 64 and more.all()
    assert peak < 24e6  # of half a million pairs five numbers each, sorted, took 60 MB and more


def test_texts_are_chosen_and_named_in_one_pass(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None), (5, "m n o p q r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    named = near_dup.signatures(docs, 5).where("class is not null")
    first = named.groupBy("class").agg(F.min("doc_id").alias("least"))
    one, two = [named.where(f"doc_id = {i}").select("class").first()[0] for i in (1, 3)]
    pairs = spark.createDataFrame([(one, two)], "a binary, b binary")
    texts = near_dup.class_texts(docs, first, pairs, 5)
    assert sorted((bytes(r["class"]), r.text) for r in texts.collect()) == sorted([(bytes(one), rows[0][1]), (bytes(two), rows[2][1])])
    # Each further one is a Python worker more for every task.
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_split_by_loses_no_row(spark):
    docs = spark.createDataFrame([(None if i == 7 else f"d{i}", i) for i in range(3000)], "doc_id string, n int").repartition(3)
    for gone in (range(0, 3000, 9), range(0), range(3000)):
        keys = spark.createDataFrame([(f"d{i}",) for i in gone], "k string")
        stay, others = near_dup.split_by(docs, "doc_id", keys)
        kept, told = [r.n for r in stay.collect()], [r.n for r in others.collect()]
        assert sorted(kept + told) == list(range(3000))
        assert set(gone) - {7} <= set(told) and len(told) <= len(gone) + 30


def test_only_texts_that_may_go_are_shuffled(spark):
    rows = [(i, " ".join(f"w{i // 2 if i < 20 else i}x{j}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = near_dup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 20, 2), *range(20, 60)]
    joins = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    at = next(i for i, line in enumerate(joins) if "LeftAnti" in line)
    # The rows of that join have passed the bitmap, which stands below it.
    assert "Inner" in joins[at + 1] and "broadcast" in joins[at + 1]


def test_bitmaps_of_classes_that_meet_no_other_are_left_out(spark, monkeypatch):
    written, write = {}, near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, label: written.setdefault(label, []).append(df.count()) or write(df, label))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(60)] + [(99, " ".join(f"w5x{j}" for j in range(29)))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i for i in range(60)} | {99: 5}
    assert written["classes"] == [61] and written["sketches"][0] < 10
