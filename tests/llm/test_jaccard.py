import random

import numpy as np
import pytest
from stacksift.llm import jaccard
from stacksift.llm.components import components


def sets_of(text, size):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, per_cent):
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= per_cent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    texts = ["", " \n", None, "one", "One", "one two", "a b c", "A B c d"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 6, 9, 15, 30, 60, 120, 400]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            base[at:at] = passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(copy))
                what = rng.random()
                if what < 0.4:
                    copy[at] = rng.choice(vocabulary)
                elif what < 0.7:
                    copy.insert(at, rng.choice(vocabulary))
                elif len(copy) > 1:
                    del copy[at]
            base = copy if rng.random() < 0.5 else base
            texts.append("  ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i + 1, texts[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed,size,per_cent,cost", [(1, 4, 85, 4.0), (2, 5, 80, 4.0), (3, 4, 85, 1e9), (4, 2, 60, 1e9)])
def test_components_like_brute_force(spark, monkeypatch, seed, size, per_cent, cost):
    monkeypatch.setattr(jaccard, "PAIR_COST", cost)  # 1e9: neighbourhoods of deletions everywhere
    rows = corpus(seed)
    if cost > 10 and per_cent > 80:
        assert any(jaccard.band_plan(n, int(n * 1.4), 100, per_cent).deletions for n in (10, 50, 200))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, size, per_cent).collect()}
    assert got == brute(rows, size, per_cent)


def test_index_never_misses_a_pair():
    rng = np.random.default_rng(7)
    for deletions in (0, 3, 1000):
        for _ in range(400):
            n = int(rng.integers(1, 60))
            band = jaccard.band_plan(max(1, int(n / 1.2)), n + 3, 10)
            k = min(deletions, band.segments)
            need = band.segments + band.deletions
            band = jaccard.Band(band.low, band.high, max(1, need - k), min(k, max(1, need - k)), band.spare if k == band.deletions else 0)
            if band.segments + band.deletions < need:
                continue
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            one = np.unique(base)
            room = max(0, need - band.spare - 1) if not band.spare else need - band.spare - 1
            two = np.unique(np.r_[base[room // 2 :], rng.integers(0, 2**63, room // 2).astype(np.uint64)])
            if not len(two) or len(np.setxor1d(one, two)) > need - 1 - band.spare:
                continue
            a, b = (set(jaccard._band_entries(x, 5, band).tolist()) for x in (one, two))
            assert a & b


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [(5, text, 1), (5, text, 2), (9, text, 3), (None, text, 4), (None, None, 5), (7, None, 6), (8, "", 7), (2, "solo " * 40000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entry int").repartition(2)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in jaccard.similar_documents(docs).collect())
    assert got == [(0, 0, 0), (0, 47, 0), (2, 1, 2), (5, 47, 5), (5, 47, 5), (7, 0, 7), (8, 0, 8), (9, 47, 5)]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 0, 2, 5, 7, 8]
    assert jaccard.similar_documents(docs.limit(0)).collect() == [] and jaccard.one_of_each(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (1, None)]
    links += [(500, 501 + i) for i in range(100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for x in root:
        assert got.get(x, x) == find(x)


def test_sketches_never_rule_out_a_link(spark):
    rng = np.random.default_rng(2)
    rows, linked = [], []
    for i in range(400):
        n = int(rng.choice([3, 30, 400, 1000, 1100, 2100, 5000]))
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(n * rng.choice([0, 0.04, 0.07, 0.15, 0.4]))
        two = np.unique(np.r_[one[gone:], rng.integers(0, 2**63, int(gone * rng.random())).astype(np.uint64)])
        if not len(two):
            continue
        shared = len(np.intersect1d(one, two))
        linked.append(100 * shared >= 85 * (len(one) + len(two) - shared))
        wholes = [jaccard.sketch(x) for x in (one, two)]
        rows.append((len(linked) - 1, len(one), len(two), *[w.tolist() for w in wholes], *[jaccard.short_sketch(w).tolist() for w in wholes]))
    df = spark.createDataFrame(rows, "i int, xs long, ys long, xw array<long>, yw array<long>, xk array<long>, yk array<long>")
    got = df.select("i", jaccard.short_fit("x", "y").alias("short"), jaccard.whole_fit("x", "y").alias("whole")).collect()
    for r in got:
        assert (r.short and r.whole) or not linked[r.i]
    assert sum(r.whole for r in got) < sum(linked) + 0.25 * len(linked)


def test_links_among_those_that_do_not_link_with_their_leader(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(10, 13).orderBy(F.xxhash64("id", F.lit(0))).collect()]
    rng = np.random.default_rng(3)
    same = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)), same, same[:95]]
    groups = spark.createDataFrame([(7, i, n == 0) for n, i in enumerate(ids)], "entry long, node long, leads boolean")
    rows = [(i, len(s), jaccard.sketch(s).tolist(), jaccard.short_sketch(jaccard.sketch(s)).tolist(), s.astype(np.int64).tolist()) for i, s in zip(ids, sets)]
    nodes = spark.createDataFrame(rows, "node long, size long, sketch array<long>, short array<long>, shingles array<long>")
    got = {r.node: r.root for r in jaccard._contracted(groups, nodes, nodes.select("node", "shingles"), 85).collect()}
    low, high = sorted(ids[1:])
    assert got.get(high) == low and got.get(low, low) == low and got.get(ids[0], ids[0]) == ids[0]


def test_large_sets_that_meet_by_chance_are_ruled_out_where_they_meet(spark, monkeypatch):
    """Short sketches say nothing about two different sets of 3,000 shingles; leader pairs are judged by whole ones."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2)] + [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(2)]
    rows = [(len(s), [int(x) for x in jaccard.short_sketch(jaccard.sketch(s))], [int(x) for x in jaccard.sketch(s)]) for s in sets]
    pairs = spark.createDataFrame([(*rows[0], *rows[1]), (*rows[2], *rows[3]), (*rows[2], *rows[2])], "asz long, ak array<long>, aw array<long>, bsz long, bk array<long>, bw array<long>")
    pairs = pairs.withColumnsRenamed({"asz": "as", "bsz": "bs"})
    assert [tuple(r) for r in pairs.select(jaccard.short_fit("a", "b", 80), jaccard.whole_fit("a", "b", 80)).collect()] == [(True, False), (False, False), (True, True)]
    asked, plain = [], jaccard.short_fit
    monkeypatch.setattr(jaccard, "short_fit", lambda one, two, per_cent: asked.append(one + two) or plain(one, two, per_cent))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other text of few words")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and "ab" not in asked


@pytest.mark.parametrize("low,high,count", [(1654, 2315, 700), (3243, 4540, 600), (8902, 12462, 100), (48000, 67199, 300)])
def test_unrelated_large_sets_share_no_index_entries(low, high, count):
    """Large sets have hundreds of empty segments; without as many spare ones, all of them met all others there."""
    rng = np.random.default_rng(low)
    band = jaccard.band_plan(low, high, count, 80)
    sets = [np.unique(rng.integers(0, 1 << 63, low + low // 10, dtype=np.uint64) * np.uint64(2)) for _ in range(8)]
    sets.append(np.unique(np.r_[sets[0][low // 12 :], sets[1][: low // 12]]))  # links with the first
    entries = [set(jaccard._band_entries(s, 3, band).tolist()) for s in sets]
    shared = len(np.intersect1d(sets[0], sets[8]))
    assert 100 * shared >= 80 * (len(sets[0]) + len(sets[8]) - shared) and entries[0] & entries[8]
    assert not any(entries[i] & entries[j] for i in range(8) for j in range(i))


def test_the_middle_of_a_group_of_near_copies_leads_it(spark):
    """Leaders by hash were copies with many changes, so copies with few of them met one another in all pairs."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    of, plan = jaccard.Shingler(), [jaccard.band_plan(100, 170, 1000)]
    rows = []
    for i in range(160):
        copy = base[:]
        for _ in range(0 if i == 0 else 1 if i < 40 else rng.randrange(4, 9)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(1000)}"
        rows.append((i, i, jaccard.index_entries(of(" ".join(copy)), plan, np.array([100])).view(np.int64).tolist()))
    found = spark.createDataFrame(rows, "doc_id long, node long, entries array<long>")
    groups = {}
    for r in jaccard._shared_entries(found).collect():
        groups.setdefault(r.entry, []).append((r.leads, r.node))
    assert groups and all(sum(leads for leads, _ in g) == 1 for g in groups.values())
    large = [g for g in groups.values() if len(g) > 40]
    assert large and all(max(g)[1] == 0 for g in large)  # the text itself


def test_chance_of_more_than():
    for mean in (0.5, 20, 99):
        draws = np.random.default_rng(1).poisson(mean, 40000)
        assert all(abs((draws > most).mean() - jaccard._more_than(most, mean)) < 0.02 for most in (0, 1, 20, 90, 110))
    assert jaccard._more_than(700, 900) > 0.99 and jaccard._more_than(1100, 900) < 0.01
