import re
from collections import defaultdict

import numpy as np
import pytest
from stacksift.llm import phrases

SCHEMA = "doc_id long, text string, anchor long, row string, n_words int"


def brute(rows, window=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    starts = defaultdict(set)
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                starts[tuple(w[i : i + window])].add(d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if min(starts[tuple(w[i : i + window])]) < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


def removed(spark, rows, **how):
    table = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.without_repeats(table, **how).collect()), key=repr)


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", " x", " y", "A", "a"]
    shared = [rng.choice(vocabulary, k).tolist() for k in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.integers(0, 4)):
            words += rng.choice(vocabulary, rng.integers(0, 30)).tolist()
            part = shared[rng.integers(len(shared))]
            a, b = sorted(rng.integers(0, len(part) + 1, 2))
            words += part[a:b] if rng.random() < 0.5 else part
        rows.append((int(i * 7 % n), rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_like_brute_force(spark, hot):
    rows = corpus(1)
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[5][1]), (903, rows[5][1]), (904, "one two"), (5, rows[9][1]), (5, rows[9][1])]
    rows += [(1000 + i, "a b c " * 40) for i in range(3)] + [(1100, "x " * 500), (1101, "x " * 13), (1102, "x " * 12)]
    rows += [(2000 + i, " ".join([f"u{i}", *(f"h{j}" for j in range(12)), f"v{i}"])) for i in range(40)]  # 12 words are no window
    rows += [(2100 + i, " ".join([f"u{i % 7}", *(f"h{j}" for j in range(12)), f"v{i % 5}"])) for i in range(40)]
    assert removed(spark, rows, hot=hot, shard=10) == brute(rows)


def test_small_tables(spark):
    assert removed(spark, []) == []
    assert removed(spark, [(1, None)]) == [(1, 0, 0, "")]
    text = " ".join(map(str, range(13)))
    assert removed(spark, [(1, text), (2, text), (3, text[:-3])]) == brute([(1, text), (2, text), (3, text[:-3])])


def test_equal_windows_have_one_anchor():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 40).astype(np.uint64)
    alone = phrases.anchors(passage)
    assert len(alone) == 28 and len(set(alone.tolist())) > 3
    for _ in range(20):
        a = np.r_[rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64), passage, rng.integers(0, 2**63, 5).astype(np.uint64)]
        shift = len(a) - 45
        assert (phrases.anchors(a)[shift : shift + 28] == alone).all()


def test_runs():
    first, size = phrases.runs(np.array([4, 4, 4, 9, 4, 4, 4, 4, 4, 4, 4, 1]), 3)
    assert list(zip(first.tolist(), size.tolist())) == [(0, 3), (3, 1), (4, 3), (7, 3), (10, 1), (11, 1)]


def test_an_automaton_locates_all_windows():
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 60, 60)]
    rows = {}
    for _ in range(80):
        a = int(rng.integers(0, 40))
        text = " ".join(base[a : a + int(rng.integers(13, 19))])
        least = int(rng.integers(0, 50))
        old = rows.get(text, (least, least))
        rows[text] = (min(least, old[0]), max(least, old[1]))
    shard = phrases.Shard([(t, a, b) for t, (a, b) in rows.items()])
    held = defaultdict(list)
    for t, (a, b) in rows.items():
        w = t.split(" ")
        for i in range(len(w) - 12):
            held[tuple(w[i : i + 13])] += [a, b]
    for t, letters in zip(rows, shard.letters):
        w = t.split(" ")
        want = [held[tuple(w[i : i + 13])] for i in range(len(w) - 12)]
        assert shard.located(letters) == [min(x) if min(x) < max(x) else None for x in want]
