import random

import numpy as np
from stacksift.llm import toxicity


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_like_distances():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 10))): float(i + 1) for i in range(40)}
    automaton = toxicity.TermAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 11)))
        near = [(d, -w) for t, w in terms.items() if (d := levenshtein(word, t)) <= toxicity.errors_allowed(t)]
        want = min(near, default=None)
        assert automaton.match(word) == (want and (-want[1], want[0])), word


def test_stems_and_misspellings():
    automaton = toxicity.TermAutomaton({"lowe*": 3.0, "idiot": 5.0, "disgusting": 4.0, "scum": 2.0})
    assert automaton.match("loweischaft") == (3.0, 0)
    assert automaton.match("low") is None
    assert automaton.match("idoit") is None or automaton.match("idoit")[1] > 0
    assert automaton.match("id1ot") == (5.0, 1) and automaton.match("idiott") == (5.0, 1)
    assert automaton.match("dizgusteng") == (4.0, 2)
    assert automaton.match("scom") is None  # short words have no errors


def test_quotation():
    words = 'he said "you idiot" to me and left idiot'.split()
    assert toxicity.quoted(words, 3) and not toxicity.quoted(words, 8)
    features = toxicity.TextFeatures({"idiot": 5.0})
    direct, said = features("you idiot go"), features('a "you idiot" quote')
    assert direct[0] > 0 and direct[2] == 0 and said[0] == 0 and said[2] > 0 and direct[4] > said[4]
    assert features("") == [0.0] * len(toxicity.FEATURES)


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["er", "th", "an", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["moron", "worthless", "pathetic", "gumbok"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 1.5, "r") for i, t, _ in rows] + [(9000, None, None, None, None), (9001, "", "", 0.0, ""),
                                  (9002, "you are pathetik and a morron gumbok", "", 0.0, ""), (9003, "x" * 100000, "", 0.0, ""), (None, "moron", "", 0.0, "")],
                                 "doc_id long, text string, lang string, score double, `row` string")
    labels = spark.createDataFrame([(i, None, t) for i, _, t in rows] + [(1, 1, None), (None, 1, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"moron", "worthless", "pathetic", "gumbok"} <= {t.rstrip("*") for t in model.terms} | set(model.terms)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    held = {r.doc_id for r in docs.filter(toxicity.is_held_out(docs["doc_id"])).select("doc_id").collect()}
    right = [(got[i] >= 0.7) == bool(t) for i, _, t in rows if i in held]
    assert len(right) > 300 and np.mean(right) > 0.97
    assert got[9000] == got[9001] < 0.3 and got[9002] > 0.7 and got[9003] < 0.3
    assert all(0 <= s <= 1 for s in got.values())
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {9000, 9001, 9003} <= ids and 9002 not in ids and None not in ids
    assert toxicity.clean_documents(docs.limit(0), labels).collect() == []
    none = toxicity.learn(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.scored(docs, none, ["doc_id"]).collect()} == {0.0}


def test_copies_do_not_crowd_out_other_terms(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CANDIDATES", 100)
    rows = corpus(600, 2)
    rare = " ".join(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(400))
    exact = [(10000 + i, rare, 1) for i in range(150)]
    near = [(20000 + i, f"{rare.replace('rare', 'near')} only{i}", 1) for i in range(150)]
    every = rows + exact + near
    docs = spark.createDataFrame([(i, t) for i, t, _ in every] + [(rows[0][0], rows[0][1])] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in every], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    chosen = sample.collect()
    assert len({r.text for r in chosen}) == len({r.doc for r in chosen}) == len(chosen)
    assert sum(r.text == rare for r in chosen) == 1
    by_portion = toxicity.chosen_terms(sample, 100)
    assert {"moron", "worthless", "pathetic", "gumbok"} <= {t.rstrip("*") for t in by_portion} | set(by_portion)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    held = {r.doc_id for r in docs.filter(toxicity.is_held_out(docs["doc_id"])).select("doc_id").collect()}
    assert np.mean([(got[i] >= 0.7) == bool(t) for i, _, t in rows if i in held]) > 0.97
