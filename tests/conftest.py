"""One local session for all tests."""

from __future__ import annotations

import os

import pytest

from fundlens.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fundlens-tests", "local[8]",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate an expression of one text column ``x`` over a list of values."""

    def evaluate(expression, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]

    return evaluate
