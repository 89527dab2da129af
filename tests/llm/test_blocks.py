import numpy as np
import pytest
from pyspark.sql import functions as F
from stacksift.llm import blocks


def brute(rows, k, asks):
    good = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    good = [(i, x) for i, x in good if i is not None]
    out = []
    for a, (i, x) in enumerate(good):
        if asks(i):
            scored = sorted((-int(sum(int(p) * int(q) for p, q in zip(x, y))), j) for b, (j, y) in enumerate(good) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "BATCH", 16)
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(120)]
    rows += [(801, None), (802, [1.0, None, 0.0]), (803, [float("nan")] * 6), (804, [float("inf")] + [0.0] * 5), (805, [0.0] * 6), (806, [1.0, 2.0]), (807, [])]
    table = spark.createDataFrame([(i, x, 1.0, "s") for i, x in rows], "vec_id long, embedding array<double>, score double, rank string").repartition(3)
    got = blocks.top_k(table, F.col("vec_id") % 5 == 0, 5, shard=64).collect()
    padded = [(i, x if x is None or None in x else x + [0.0] * (6 - len(x))) for i, x in rows]
    assert sorted(map(tuple, got)) == brute(padded, 5, lambda i: i % 5 == 0)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (5, [2.0])], schema)
    got = [tuple(r) for r in blocks.top_k(few, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 131072), (0, 2, 1, -65536), (5, 1, 0, 131072), (5, 2, 1, -131072)]
    assert blocks.top_k(few.limit(0), F.lit(True)).collect() == []
    assert blocks.top_k(few, F.lit(False)).collect() == []


def test_pruning_skips_blocks():
    rng = np.random.default_rng(0)
    weights = np.sort(rng.integers(0, 100, (512, 1)), axis=0)[::-1].repeat(4, 1)
    calls = []
    product = blocks._product

    def counted(a, b):
        calls.append(len(b))
        return product(a, b)

    blocks._product = counted
    try:
        best = blocks.top_in_shard(np.array([-1]), np.ones((1, 4), int), np.array([blocks.NOTHING]), np.arange(512), np.arange(512), weights, 5, 8)
    finally:
        blocks._product = product
    assert [-s for s, _, _ in best[0]] == sorted((4 * weights[:, 0]).tolist(), reverse=True)[:5]
    assert sum(1 for n in calls if n == 8) < 20


def test_rows_without_an_id_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1.0]), (None, [9.0]), (5, [2.0]), (None, None)], "vec_id long, embedding array<float>")
    for asks in (F.lit(True), F.coalesce(F.col("vec_id") % 5 == 0, F.lit(True))):
        got = [tuple(r) for r in blocks.top_k(rows, asks).orderBy("query_id").collect()]
        assert got == [(0, 1, 5, 131072), (5, 1, 0, 131072)]


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(50, [1.0, 2.0, 0.0, 1.0]), (50, [-1.0, 0.5, 3.0, 0.0]), (50, rows[50][1]), (7, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = blocks.top_k(table, F.col("vec_id") % 50 == 0, 5, shard=16).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda i: i % 50 == 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_queries_do_not_pass_the_driver_once_a_group(spark, monkeypatch, most):
    """Many queries are shuffled, however small their files; few are sent, but not copied for every group of shards."""
    monkeypatch.setattr(blocks, "BATCH", 16)
    monkeypatch.setattr(blocks, "MOST_SENT", most)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    met, search = [], blocks._search

    def seen(*args):
        met.append(search(*args))
        return met[-1]

    monkeypatch.setattr(blocks, "_search", seen)
    got = blocks.top_k(table, F.col("vec_id") % 5 == 0, 5, shard=32).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda i: i % 5 == 0)
    for plan in map(plan_of, met):
        assert ("BroadcastExchange" in plan) == bool(most)
        assert most == 0 or "explode" not in plan
