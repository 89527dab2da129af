import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_jaccard import sets_of

import __spark_entry__ as entry

BAD = ["moron", "worthless", "pathetic", "scumbag"]


def corpus():
    rng = random.Random(11)
    plain = ["".join(rng.choice(["er", "th", "an", "in", "on", "re", "st"]) for _ in range(rng.randint(2, 5))) for _ in range(900)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(12, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        elif rng.random() < 0.1:
            words[3] = rng.choice(["mail me.too@host.example.org", "83.229.25.121", "+1 (017) 555-7713", "4111 1111 1111 1111"])
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "a", "b", "c"])))
        labels.append((i, 1, int(toxic)))
    clean = [r for r, l in zip(rows, labels) if not l[2]]
    for j, (_, text, _, source) in enumerate(rng.choices(clean, k=60)):
        words = text.split(" ")
        if j % 2 and len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + j, " ".join(words), "en", source))
    rows += [(2000, None, None, None), (2001, "", "de", "a"), (2002, " ".join(plain) * 30, "fr", "d")]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of each stage, each read from the one before it."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    docs = [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/stage-{n}.parquet")
        out.append(spark.read.parquet(f"{folder}/stage-{n}.parquet"))
    return out, {i: t for i, _, t in labels}


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in entry.queries()
    for df in stages[0][1:5]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(stages):
    out, labels = stages
    before, after = rows_of(out[0]), rows_of(out[1])
    wrong = [i for i, t in labels.items() if (i in after) == bool(t)]
    assert len(wrong) < 0.02 * len(labels)
    assert {2000, 2001, 2002} <= set(after) and all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(stages):
    out, _ = stages
    before, after = rows_of(out[1]), rows_of(out[2])
    sets = {i: sets_of(r.text, 5) for i, r in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if find(i) == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_personal_data_is_hidden(stages):
    out, _ = stages
    before, after = rows_of(out[2]), rows_of(out[3])
    assert set(before) == set(after)
    for i, r in after.items():
        old = before[i].text
        for secret, mark in (("me.too@host.example.org", "[EMAIL]"), ("83.229.25.121", "[IP]"), ("+1 (017) 555-7713", "[PHONE]"), ("4111 1111 1111 1111", "[CARD]")):
            if old and secret in old:
                old = old.replace(secret, mark)
        assert r.text == old and (not old or r.n_chars == len(old))


def test_mix_and_pack(stages):
    from tokenizers import Tokenizer

    from stacksift.llm.tokens import vocabulary

    out, _ = stages
    mixed = out[4].collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len((r.text or "").split())
    size = Counter()
    for r in out[3].collect():
        size[r.source] += len((r.text or "").split())
    assert abs(sum(words.values()) - sum(size.values())) <= 4
    assert all(words[s] <= 3 * size[s] for s in size)
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    wanted = Counter(r.doc_id for r in mixed)
    tokens = {(r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed}
    pieces = out[5].collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == wanted
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == tokens
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    fills = Counter()
    for p in pieces:
        fills[p.sequence_id] += p.length
    assert all(f == 1024 or f & (f - 1) == 0 for f in fills.values()) and np.mean(list(fills.values())) > 500


def test_empty_tables(spark, stages, tmp_path):
    out, _ = stages
    docs = out[0].limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
