"""Whitening against numpy, and the exact parts against whole numbers of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fundlens.llm import whitening
from fundlens.llm.queries import catalog

SHAPE = "vec_id bigint, embedding array<float>, label int"


def test_eigenpairs_of_many_shapes():
    random = np.random.default_rng(1)
    shapes = [np.diag([3.0, 3.0, 3.0, 1.0, 0.0]), np.eye(12), np.zeros((4, 4)), np.array([[2.5]]), np.array([[2.0, 1.0], [1.0, 2.0]])]
    for n in (3, 17, 64):
        a = random.standard_normal((n, n))
        shapes += [a @ a.T, 1e9 * a @ a.T, a[:, :2] @ a[:, :2].T]
    q = np.linalg.qr(random.standard_normal((30, 30)))[0]
    shapes.append(q @ np.diag([5.0] * 6 + [5 - 1e-9] * 4 + [1.0] * 20) @ q.T)
    for a in shapes:
        a = (a + a.T) / 2
        values, vectors = whitening.components(a)
        true = np.linalg.eigvalsh(a)[::-1][: len(values)]
        size = max(np.abs(a).max(), 1e-300) * len(a)
        assert np.allclose(values, true, atol=1e-13 * size, rtol=0)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
        assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-12 * size)


def test_sturm_counts():
    d, e = np.array([2.0, 0.0, -1.0, 4.0]), np.array([1.0, 0.5, 0.0])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.array([-9.0, *(values + 1e-9), 9.0])
    assert whitening.sturm_counts(d, e, at).tolist() == [0, 1, 2, 3, 4, 4]


def test_squares_are_exact():
    d = np.array([[1, -5, 1 << 20], [(1 << 62) - 1, -(1 << 61) + 3, 12345678901], [0, 0, 0]])
    assert whitening.squares(d) == [sum(x * x for x in row) for row in d.tolist()]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(given, found):
    """``found`` against numpy over the vectors ``given`` of (id, list)."""
    good = [(i, v) for i, v in given if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in good])
    n, sums = len(x), x.sum(0)
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, sums.tolist())) for row in x.tolist()]
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    k = int((values > 1e-13 * values.sum()).sum())
    assert len(found) == n * k
    assert {r["component"] for r in found} == set(range(1, k + 1))
    assert {(r["n"], type(r["deviation"])) for r in found} == {(n, int)}
    assert sorted((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == sorted(
        (i, d) for (i, _), d in zip(good, deviations)
    )
    trace = np.trace(centred.T @ centred / n)
    assert max(r["identity_error"] for r in found) < 1e-9 and len({r["identity_error"] for r in found}) == 1
    for c in range(k):
        mine = {r["vec_id"]: r["whitened"] for r in found if r["component"] == c + 1}
        true = centred @ vectors[:, c] / math.sqrt(values[c])
        got = np.array([mine[i] for i, _ in good])
        assert min(np.abs(got - true).max(), np.abs(got + true).max()) < 1e-6
        assert all(abs(r["explained"] - values[c] / trace) < 1e-9 for r in found if r["component"] == c + 1)


def test_small_tables_with_odd_rows(spark):
    random = np.random.default_rng(3)
    given = [(i, (random.standard_normal(5) * [9, 5, 3, 1, 0.5]).tolist()) for i in range(60)]
    given += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    given += [(104, [0.0] * 5), (105, [1.0, 2.0]), (106, [])]
    table = spark.createDataFrame([(i, v, 0) for i, v in given], SHAPE).repartition(5)
    table = table.withColumnsRenamed({"label": "key"}).selectExpr("*", "1 AS vector", "2 AS whitened", "3 AS place")
    check(given, rows_of(whitening.whitened_rows(table)))


def test_repeated_rows_count_each(spark):
    random = np.random.default_rng(4)
    vectors = random.standard_normal((20, 3)).tolist()
    twice = spark.createDataFrame([(i % 20, vectors[i % 20], 0) for i in range(40)], SHAPE)
    found = rows_of(whitening.whitened_rows(twice))
    assert len(found) == 40 * 3 and {r["n"] for r in found} == {40}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0], 0), (2, [1.0], 0)], [(None, [], 0)]])
def test_nothing_to_whiten(spark, rows):
    assert rows_of(whitening.whitened_rows(spark.createDataFrame(rows, SHAPE))) == []


def test_null_ids_and_large_numbers(spark):
    table = spark.createDataFrame([(None, [1e30, 0.0], 0), (1, [-1e30, 1.0], 0), (None, [0.0, 3.0], 0)], SHAPE)
    found = rows_of(whitening.whitened_rows(table))
    # The second component is below the rounding of the first.
    assert len(found) == 3 and all(r["deviation"] is None and int(r["deviation_exact"]) > 2**63 for r in found if r["vec_id"] is not None)


def test_query_against_numpy(spark, folder):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(given, rows_of(catalog.plans["op13_whitening"](spark, folder)))
