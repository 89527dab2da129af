import numpy as np
import pytest
from pyspark.sql import functions as F
from stacksift.llm import covertree

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank string, row string"


def brute(rows, anchor, positives=5, negatives=10):
    good = [(i, np.floor(256 * np.array(x, float)).astype(int).tolist(), l) for i, x, l in rows if i is not None and l is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (i, x, l) in enumerate(good):
        if not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, m) for b, (j, y, m) in enumerate(good) if b != a]
        for s, j, _ in sorted(t for t in scored if t[2] == l)[:positives]:
            inside = sorted(t for t in scored if t[2] != l and 30 * -s <= 100 * -t[0] <= 90 * -s)[:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, x, l, 1.0, "r", "x") for i, x, l in rows], SCHEMA).repartition(3)


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 6))
    return [(i, (middle[rng.integers(12)] * rng.choice([0.2, 1, 3]) + rng.normal(size=6) * 0.1).round(2).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = clustered(seed, 500)
    rows += [(600 + i, rows[3][1], 1) for i in range(60)] + [(700 + i, rows[3][1], 2) for i in range(60)]
    rows += [(900, None, 1), (905, [1.0, None], 1), (910, [float("nan")], 1), (915, [1.0, 2.0], None), (None, [1.0] * 6, 1), (920, [0.0] * 6, 1), (925, [], 0), (930, [2.0], 0)]
    rows += [(10, rows[3][1], 1), (10, [0.5] * 6, 2), (20, rows[20][1], rows[20][2])]  # ids that repeat
    got = covertree.hard_negatives(made(spark, rows), F.col("vec_id") % 10 == 0, shard=64).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0)


def test_small_tables(spark):
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]
    got = [tuple(r) for r in covertree.hard_negatives(made(spark, few), F.lit(True)).orderBy("anchor_id").collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768), (1, 0, 1, 2, 65536, 32768)]
    assert covertree.hard_negatives(made(spark, few).limit(0), F.lit(True)).collect() == []
    assert covertree.hard_negatives(made(spark, few), F.lit(None).cast("boolean")).collect() == []
    assert covertree.hard_negatives(made(spark, [(0, [1.0], 1)]), F.lit(True)).collect() == []


@pytest.mark.parametrize("leaf", [1, 8])
def test_tree_covers_and_separates(leaf):
    rng = np.random.default_rng(3)
    rows = np.r_[rng.integers(-200, 200, (300, 4)), np.repeat(rng.integers(-9, 9, (1, 4)), 50, 0), np.zeros((5, 4), int)]
    order, nodes = covertree.tree(rows, np.arange(len(rows)) % 3, leaf)
    points, _ = covertree.augmented(rows)
    assert sorted(order) == list(range(len(rows)))
    for n in nodes:
        inside = order[n["low"] : n["high"]]
        assert n["center"] in inside
        assert np.linalg.norm(points[inside] - points[n["center"]], axis=1).max() <= n["radius"] + 1e-6
        children = nodes[n["first"] : n["first"] + n["children"]]
        if len(children):
            assert [c["low"] for c in children][1:] == [c["high"] for c in children][:-1]
            assert (children[0]["low"], children[-1]["high"]) == (n["low"], n["high"])
            gaps = points[children["center"]][:, None] - points[children["center"]][None]
            apart = np.linalg.norm(gaps, axis=2) + np.eye(len(children)) * 1e9
            assert apart.min() > n["radius"] / 2 - 1e-6
            assert n["center"] in children["center"]


def test_descent_skips_nodes_outside_the_window():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-5, 5, (200, 3)) + c for c in ((900, 0, 0), (0, 900, 0), (0, 0, 900), (500, 500, 0))])
    labels = np.zeros(len(rows), np.int64)
    order, nodes = covertree.tree(rows, labels)
    place = np.argsort(order)
    nodes["center"] = place[nodes["center"]]
    ids = np.arange(len(rows))[order]
    shard = covertree.Shard(ids.tobytes(), ids.tobytes(), labels.tobytes(), rows[order].astype("<i8").tobytes(), nodes.tobytes(), 3)
    seen = []
    best = covertree.descend(shard, -1, 1, False, np.array([100, 0, 0]), np.array([40000]), np.array([60000]), np.array([covertree.NOTHING]), 10, seen)
    scores = rows @ np.array([100, 0, 0])
    inside = np.flatnonzero((scores >= 40000) & (scores <= 60000))
    assert best[0] == sorted((-int(scores[i]), int(i), int(i)) for i in inside)[:10]
    assert sum(seen) < 300
