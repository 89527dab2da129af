import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from stacksift.llm import impacts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, doc_id string, score string"
DOCS = "doc_id long, text string, n long, rank string"


def brute(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for i, w in wanted.items():
        scored = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in w.items() if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def ask(spark, docs, items, **how):
    table = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "d", "s") for i, t in items], ITEMS)
    return sorted(map(tuple, impacts.ranked(table, asked, **how).collect()))


def test_like_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ß9", "A", "a", "Z9"]
    odds = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), rng.choice([" ", "-", "\n"]).join(rng.choice(words, rng.integers(1, 60), p=odds / odds.sum()))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "... !!"), (None, "w1 w2 w3"), (7, docs[7][1]), (7, "w1 w1 w1"), (503, "w40 " * 5000)]
    docs += [(600 + i, docs[3][1]) for i in range(40)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(12)] + [(20, None), (21, ""), (22, "none of them"), (None, "w1"), (3, "w1 W1 été"), (23, docs[3][1])]
    want = brute(docs, items)
    assert ask(spark, docs, items, size=16) == want
    assert ask(spark, docs, items, size=64, group=40) == want  # several groups of items


def test_small_tables(spark):
    assert ask(spark, [], [(1, "a")]) == []
    assert ask(spark, [(1, "a")], []) == []
    assert ask(spark, [(1, None)], [(1, "a")]) == []
    docs = [(2, "a b"), (1, "a b"), (3, "c")]
    assert ask(spark, docs, [(1, "a")]) == brute(docs, [(1, "a")])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_pruning_keeps_the_best(seed, k):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 50, (30, 8)) * (rng.random((30, 8)) < 0.4) * np.array([1, 1, 5, 5, 20, 1, 300, 2])
    place, term = np.nonzero(rows)
    if not len(place):
        return
    order = np.argsort(term, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(term[order]) > 0])
    norms = np.sqrt((rows.astype(float) ** 2).sum(1))
    parts = (np.arange(30), norms, term[order][starts].astype("<i4"), np.r_[starts, len(term)], place[order].astype("<i4"), rows[place, term][order])
    bucket = impacts.Bucket(*(x.tobytes() for x in parts))
    want = np.flatnonzero(rng.random(8) < 0.6).astype(np.int32)
    times = rng.integers(1, 4, len(want))
    score = rows[:, want] @ times
    least = int(rng.integers(1, max(2, score.max(initial=1) + 1)))
    assert impacts.best_of(bucket, want, times, least, k) == sorted((-int(s), i) for i, s in enumerate(score) if s >= least)[:k]


def test_only_survivors_are_rescored():
    # One rare term of weight 1000 in a single document, one common term of weight 1 in all.
    n = 500
    parts = (np.arange(n), np.full(n, 1000.0), np.array([0, 1], "<i4"), np.array([0, 1, n + 1]), np.r_[[7], np.arange(n)].astype("<i4"), np.r_[[1000], np.ones(n, int)])
    bucket = impacts.Bucket(*(x.tobytes() for x in parts))
    seen = []
    want, times = np.array([0, 1], np.int32), np.array([1, 1])
    assert impacts.best_of(bucket, want, times, 50, 10, seen) == [(-1001, 7)] and seen == [1]
    assert impacts.best_of(bucket, want, times, 5000, 10, seen) == [] and seen == [1]
