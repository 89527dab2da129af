import numpy as np
from pyspark.sql import functions as F
from stacksift.llm import neighbours


def brute(rows, q, k):
    x = dict(rows)[q]
    scored = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)[:k]
    return [i for _, i in scored]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 128)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.5, 1, 2])).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[20][1]) for i in range(60)]
    bad = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, x, "k") for i, x in rows + bad], "vec_id long, embedding array<double>, node string").repartition(3)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i, _ in rows if i % 20 == 0]
    assert sorted(got) == queries
    recall = []
    vectors = dict(rows)
    for q in queries:
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        for _, i, s in found:
            assert abs(s - np.dot(vectors[q], vectors[i])) < 1e-9
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & set(brute(rows, q, 20))) / 20)
    assert np.mean(recall) >= 0.95
    own = [i for _, i, _ in sorted(got[2000]) if i == 20 or i >= 2000]
    assert own == [20, *range(2001, 2060)][: len(own)]


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], schema)
    got = [tuple(r) for r in neighbours.nearest(few, F.lit(True)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 2, 2.0), (1, 2, 0, 1.0), (2, 1, 1, 2.0), (2, 2, 0, 1.0)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).collect() == []
    assert neighbours.nearest(few.limit(1), F.lit(True)).collect() == []


def test_rows_without_an_id_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [5.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(rows, F.lit(True)).orderBy("query_id").collect()]
    assert got == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]


def test_long_rows_do_not_spoil_the_others(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 128)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1200)]
    rows += [(2001, (1e4 * rng.normal(size=16)).tolist()), (2002, (30 * rng.normal(size=16)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got[q] & set(brute(rows, q, 20))) / 20 for q in got]
    assert len(got) == 60 and np.mean(recall) >= 0.95, np.mean(recall)


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(20, [20.0, 1.0]), (20, [3.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, 3).collect())
    want = []
    for a, (i, x) in enumerate(rows):
        if i % 20 == 0:
            scored = sorted((-float(np.dot(x, y)), j) for b, (j, y) in enumerate(rows) if b != a)[:3]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert got == sorted(want)


def test_buckets_hold_arrays_not_rows_of_edges(spark, monkeypatch):
    """The graph and the searches are written as a row per bucket, whatever they hold; vectors are not sent to all."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    sizes, write = {}, neighbours.written

    def counted(df, name, *more):
        out = write(df, name, *more)
        sizes.setdefault(name, []).append(out.count())
        if name in ("neighbour-graph", "search"):
            assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).count() == 75 * 20
    assert max(sizes["neighbour-graph"] + sizes["search"] + sizes["search-graph"]) <= 16


def test_best_edges_and_kept_entries_like_brute_force():
    rng = np.random.default_rng(2)
    nodes = np.sort(rng.choice(10**12, 20, replace=False))
    want: dict = {}
    state = (np.zeros(20 * neighbours.K, "<i8"), np.full(20 * neighbours.K, -np.inf, "<f4"))
    for number in range(4):
        u, v = rng.choice(nodes, 1500), rng.integers(0, 90, 1500)
        sim = ((nodes.searchsorted(u) * 131 + v * 17) % 97).astype("<f4")
        old = {(a, b) for a in want for b in want[a]}
        for a, b, s in zip(u, v, sim):
            want.setdefault(a, {})[b] = float(s)
        want = {a: dict(sorted(x.items(), key=lambda e: (-e[1], e[0]))[: neighbours.K]) for a, x in want.items()}
        *state, fresh = neighbours.best_edges(nodes, state, (u, v, sim))
        at = np.flatnonzero(np.isfinite(state[1]))
        got = [(nodes[i // neighbours.K], state[0][i]) for i in at]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in want for b in want[a]}
        assert all(fresh[i] == (e not in old) for i, e in zip(at, got))
    kept = tuple(np.empty(0, t) for t in ("<i8", "<i8", "<f4", "i1"))
    best: dict = {}
    for mark in (1, 0, 0):
        q, n = rng.integers(0, 5, 400), rng.integers(0, 200, 400)
        score = ((q * 31 + n * 7) % 101).astype("<f4")
        kept = neighbours.kept_best(kept, (q, n, score, np.full(400, mark, "i1")), 30)
        for a, b, s in zip(q, n, score):
            best.setdefault(a, {}).setdefault(b, (-float(s), b, mark))
        best = {a: {e[1]: e for e in sorted(x.values())[:30]} for a, x in best.items()}
        assert list(zip(*kept)) == [(a, b, -s, m) for a in sorted(best) for s, b, m in best[a].values()]


def test_few_scores_give_the_same_pairs():
    rng = np.random.default_rng(5)
    score = rng.random((40, 30))
    score[rng.random(score.shape) < 0.85] = -np.inf
    score[3] = rng.random(30)
    got = set(zip(*map(tuple, neighbours._nearest(score, 6))))
    assert got == {(i, j) for i in range(40) for j in np.argsort(-score[i])[:6] if np.isfinite(score[i, j])}
