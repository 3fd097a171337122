"""Every registered query against its SQL, and against itself on other partitionings."""

import pytest

import __spark_entry__ as entry
import check
from fundlens.plans import catalog

MOVED = ("rank_gainers", "theme_rollup", "funds_by_stock", "provider_fallback", "tag_merge", "filter_map", "coverage_score", "batch_assign")


@pytest.fixture(scope="module")
def duck(folder):
    return check.connect(folder)


def test_every_query_has_sql():
    assert set(catalog.plans) == set(catalog.sql)
    assert set(catalog.plans) <= set(entry.queries())
    assert len(catalog.plans) > 100


def test_entry(spark, folder):
    rows = entry.entry(spark)
    assert rows.columns[0] == "rank" and rows.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.plans))
def test_query_matches_sql(spark, duck, folder, name):
    ok, text = check.compare(spark, duck, name, folder)
    assert ok, text


@pytest.mark.parametrize("name", MOVED)
def test_partitioning_does_not_matter(spark, folder, name):
    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = catalog.plans[name](spark, folder)
        return check.canonical(df.columns, df.collect())

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        one = run("1")
        spark.conf.set(coalesce, "false")
        assert run("7") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set(coalesce, "true")
