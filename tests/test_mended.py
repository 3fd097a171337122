"""Input order, batches of scores, document shape, streams that resume, scratch tables."""

from pyspark.sql import functions as F

from fundlens import storage
from fundlens.operators import bars, resolve, tagging
from fundlens.sources import readers, sinks
from fundlens.streaming import ticks


def test_ordinal_follows_files(spark, tmp_path):
    sizes = {"a": 3, "b": 4000, "c": 5, "d": 900}
    for name, n in sizes.items():
        lines = "".join(f"{name},{i},{'x' * 40}\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text(lines)
    want = [(name, i) for name, n in sizes.items() for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.schema("name string, i int, fill string").csv(str(tmp_path))
        numbered = readers.with_ordinal(df).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.name, r.i) for r in numbered] == want
    assert [r.ord for r in numbered] == list(range(len(want)))


SCORE = "batch_id string, etf_code string, tag_id string, score double, confidence double, source string, evidence array<string>"


def test_last_batch_replaces(spark):
    model = spark.createDataFrame(
        [("b1", "f1", "t1", 0.9, 0.9, "model", None), ("b2", "f1", "t1", 0.4, 0.5, "model", None), ("b1", "f1", "t2", 0.4, 0.5, "model", None), ("b1", "f2", "t1", 0.7, 0.7, "model", None)], SCORE
    )
    rule = spark.createDataFrame([("f1", "t1", 0.6, 0.6, "rule", None)] * 2, SCORE.removeprefix("batch_id string, "))
    tags, conflicts = tagging.merge_tags(rule, model)
    assert sorted((r.etf_code, r.tag_id, r.score) for r in tags.collect()) == [("f1", "t1", 0.6), ("f2", "t1", 0.7)]
    assert conflicts.count() == 1
    reviews = model.where("batch_id = 'b2'").select("batch_id", "etf_code", F.lit(1).alias("ord"), F.array(F.struct("tag_id", F.lit(1.0).alias("score"), "confidence", "source", "evidence")).alias("corrected"))
    after = tagging.apply_reviews(model, reviews).collect()
    assert sorted((r.batch_id, r.etf_code, r.tag_id, r.score) for r in after) == [("b1", "f1", "t1", 0.9), ("b1", "f1", "t2", 0.4), ("b1", "f2", "t1", 0.7), ("b2", "f1", "t1", 1.0)]


def test_ledger_counts_by_last_entry(spark):
    kind = "etf_code string, input_hash string, taxonomy_version string, prompt_version string, scored_at int"
    ledger = spark.createDataFrame([("f1", "old", "1", "1", 1), ("f1", "new", "1", "1", 2), ("f2", "same", "1", "1", 1)], kind)
    current = spark.createDataFrame([("f1", "old", "1", "1", 3), ("f2", "same", "1", "1", 3)], kind)
    assert [r.etf_code for r in sinks.to_score(current, ledger).collect()] == ["f1"]


def test_misshapen_document_is_named_so(spark):
    kind = "etf_code string, base_date string, provider string, listed int"
    attempts = spark.createDataFrame([("069500", "2024-01-05", "SEIBRO", 0), ("BAD CODE!", "2024-01-05", "SEIBRO", 0), ("069500", "5 Jan", "SEIBRO", 0)], kind)
    row = "etf_code string, base_date string, provider string, asset_code string, asset_name string, asset_type string, weight_pct double, rank int"
    rows = spark.createDataFrame([(r.etf_code, r.base_date, r.provider, "005930", "Samsung", "domestic_stock", 100.0, 1) for r in attempts.collect()], row)
    found = {(r.etf_code, r.base_date): (r.outcome, r.usable) for r in resolve.check_attempts(attempts, rows, ["etf_code", "base_date"]).collect()}
    bad = [v for k, v in found.items() if k != ("069500", "2024-01-05")]
    assert bad == [("INVALID_SCHEMA", False)] * 2


def test_bars_without_finite_prices(spark):
    nan = float("nan")
    given = [("a", "2024-01-02 01:00:00", 1, nan, 5), ("a", "2024-01-02 02:00:00", 2, 3.0, 5), ("a", "2024-01-02 03:00:00", 3, nan, 1), ("b", "2024-01-02 02:00:00", 4, nan, 7)]
    df = spark.createDataFrame(given, "code string, ts string, tick_id int, price double, volume bigint").withColumn("ts", F.to_timestamp("ts"))
    found = {r.code: (r.o, r.h, r.l, r.c, r.v) for r in bars.bars(df).collect()}
    assert found == {"a": (3.0, 3.0, 3.0, 3.0, 11), "b": (None, None, None, None, 7)}
    quote = {r.code: r for r in bars.quotes(bars.bars(df)).collect()}["b"]
    assert quote.price is None and quote.change_rate is None and quote.trading_value is None


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kind = "code string, n int"

    def run():
        stream = spark.readStream.schema(kind).csv(str(tmp_path / "in"))
        return ticks.run_to_table(stream, "resume", str(tmp_path / "out"), str(tmp_path / "check"))

    (tmp_path / "in" / "1.csv").write_text("a,1\n")
    assert run().count() == 1
    (tmp_path / "in" / "2.csv").write_text("b,2\n")
    assert sorted(r.code for r in run().collect()) == ["a", "b"]


def test_release_is_per_session(spark):
    other = spark.newSession()
    mine = storage.materialize(spark.range(3), "mine")
    theirs = storage.materialize(other.range(4), "theirs")
    assert storage.release(other) == 1
    assert mine.count() == 3
    assert not storage.folder_names(spark, theirs.inputFiles()[0].rsplit("/", 1)[0])
