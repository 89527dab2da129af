from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from stacksift.plans import resolve_queue
from stacksift.schemas import CANDIDATE_FIELDS, JOBS
from stacksift.sources import deltas, snapshots

DAY = datetime(2024, 1, 1)
SCHEMA = "k long, part string, v string"


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def held(spark, root):
    return sorted(tuple(r) for r in deltas.read(spark, root, SCHEMA).collect())


def test_newest_wins_over_random_commits(spark, tmp_path):
    import random

    rng = random.Random(7)
    root, want, kinds = str(tmp_path), {}, []
    for n in range(12):
        keys = rng.sample(range(40), rng.randint(1, 12))
        values = [(k, "p", f"{n}-{k}") for k in keys]
        gone = set(rng.sample(keys, len(keys) // 3))
        deltas.append(rows(spark, values), root, ["k"], DAY, ["v"], F.col("k").isin(list(gone)) if gone else None)
        for k, p, v in values:
            want.pop(k, None) if k in gone else want.update({k: (k, p, v)})
        if n % 3 == 2:
            kinds.append(deltas.compact(spark, root, SCHEMA, DAY))
        assert held(spark, root) == sorted(want.values())
    assert "base" in kinds
    live = deltas.state(spark, root).live
    assert len(live) < 8 and sum(s.base for s in live) == 1


def test_small_deltas_become_one_beside_a_large_base(spark, tmp_path):
    root = str(tmp_path)
    deltas.replace(spark.range(60_000).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v")), root, ["k"], DAY)
    for n in range(4):
        deltas.append(rows(spark, [(n, "p", "new"), (50 + n, "p", "new")]), root, ["k"], DAY)
    assert deltas.compact(spark, root, SCHEMA, DAY) == "delta"
    live = deltas.state(spark, root).live
    assert [(s.base, s.rows) for s in live] == [(True, 60_000), (False, 8)]
    assert deltas.read(spark, root, SCHEMA).filter("v = 'new'").count() == 8
    assert deltas.read(spark, root, SCHEMA).count() == 60_000
    assert deltas.compact(spark, root, SCHEMA, DAY) is None
    deltas.append(rows(spark, [(1, "p", "newer")]), root, ["k"], DAY)
    assert deltas.read(spark, root, SCHEMA).filter("k = 1").first()["v"] == "newer"


def test_nothing_changed_is_no_commit(spark, tmp_path):
    root = str(tmp_path)
    first = rows(spark, [(1, "p", "a"), (2, "p", None)])
    assert deltas.upsert(first, root, ["k"], DAY) == 2
    assert deltas.upsert(first, root, ["k"], DAY) == 0 and deltas.last_commit(spark, root) == 1
    assert deltas.upsert(rows(spark, [(1, "p", "a"), (2, "p", "b"), (3, "q", None)]), root, ["k"], DAY) == 2
    assert deltas.append(rows(spark, []), root, ["k"], DAY) == 0
    assert held(spark, root) == [(1, "p", "a"), (2, "p", "b"), (3, "q", None)]


def test_bad_keys_and_second_writers_fail(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        deltas.append(rows(spark, [(1, "p", "a"), (1, "p", "b")]), root, ["k"], DAY)
    with pytest.raises(ValueError):
        deltas.append(rows(spark, [(None, "p", "a")]), root, ["k"], DAY)
    assert deltas.read(spark, root, SCHEMA).count() == 0
    deltas.append(rows(spark, [(1, "p", "a")]), root, ["k"], DAY)
    other = deltas.Segment(1, "zzz", False, 1, 1, 1, 1)
    with pytest.raises(RuntimeError):
        deltas.commit(spark, root, other, DAY, ["k"], [])
    assert held(spark, root) == [(1, "p", "a")]


def test_filters_skip_rows_of_a_clustered_base(spark, tmp_path):
    root = str(tmp_path)
    many = spark.range(1000).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.when(F.col("id") % 100 == 0, "pending").otherwise("done").alias("v"))
    deltas.replace(many, root, ["k"], DAY, ["v"])
    deltas.append(rows(spark, [(0, "p", "done"), (1, "p", "pending")]), root, ["k"], DAY, ["v"])
    found = deltas.read(spark, root, SCHEMA).filter("v = 'pending'")
    assert sorted(r["k"] for r in found.collect()) == [1, *range(100, 1000, 100)]
    assert "EqualTo(v,pending)" in found._jdf.queryExecution().toString()


def test_a_drain_batch_writes_what_it_changes(spark, tmp_path):
    """Ten times the queue, the same batch: the bytes are about the same."""
    written = []
    for n in (300, 3000):
        root = f"{tmp_path}/{n}"
        catalog = spark.range(n).select(
            F.col("id").cast("string").alias("id"), F.concat(F.lit("Title number "), "id").alias("title"),
            F.lit("https://a.example/").alias("source_url"), F.lit("2024-01-01").alias("post_date"), F.array(F.lit("x")).alias("genres"),
            F.struct(F.lit("d").alias("description")).alias("details"),
        )
        assert resolve_queue.sync(spark, catalog, root, DAY)["total"] == n
        before = deltas.last_commit(spark, f"{root}/jobs")
        nothing = spark.createDataFrame([], f"query string, candidate struct<{CANDIDATE_FIELDS}>")
        stats = resolve_queue.run_batch(spark, root, lambda q: nothing, 20, DAY + timedelta(minutes=1))
        assert stats["review"] == 20
        written.append(deltas.written_bytes(spark, f"{root}/jobs", before))
        states = {r["status"]: r["count"] for r in snapshots.read_current(spark, f"{root}/jobs", JOBS).groupBy("status").count().collect()}
        assert states == {"pending": n - 20, "review": 20}
    assert written[1] < 1.5 * written[0]
