import pytest
from pyspark.sql import functions as F
from stacksift.operators import ordinals
from stacksift.sources import sort_runs


def test_pages_and_neighbours(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 7 % 13).alias("score"), F.lit("r").alias("rows"), F.lit(1).alias("part"))
    order = [F.desc("score"), F.col("key")]
    run = sort_runs.stored_run(rows, order, str(tmp_path), 90)
    want = sorted(((-(i * 7 % 13), i) for i in range(1000)))
    for number in (0, 1, 2, 17, 33):
        page = sort_runs.page(spark, run, number, 30)
        got = [(r["ordinal"], r["key"]) for r in page.collect()]
        assert got == [(n, want[n][1]) for n in range(number * 30, min(1000, number * 30 + 30))]
        assert 1 <= len(page.inputFiles()) <= 2
    assert sort_runs.page(spark, run, 34, 30).collect() == []
    for n in (0, 1, 500, 999):
        assert tuple(sort_runs.neighbours(spark, run, n, "key").first()) == (want[n - 1][1], want[(n + 1) % 1000][1])
    with pytest.raises(IndexError):
        sort_runs.neighbours(spark, run, 1000, "key")


def test_heads_and_deep_pages_agree(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 9).alias("score"))
    order = [F.desc("score"), F.col("key")]
    head = [tuple(r) for r in ordinals.page(rows, order, 3, 30).collect()]
    monkeypatch.setattr(ordinals, "HEAD", 10)
    assert head == [tuple(r) for r in ordinals.page(rows, order, 3, 30).collect()]


def test_empty_run(spark, tmp_path):
    run = sort_runs.stored_run(spark.range(0).withColumnRenamed("id", "key"), [F.col("key")], str(tmp_path))
    assert sort_runs.run_rows(spark, run) == 0 and sort_runs.page(spark, run, 0, 30).collect() == []
