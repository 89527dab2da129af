import random

import pytest
from pyspark.sql import functions as F
from stacksift.functions.fold import distinct_words
from stacksift.operators import fuzzy, search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_keys_find_all_words_within_two_edits(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(600)} | {"a" * 30, "b" + "a" * 27}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    keys = fuzzy.deletion_keys(table)
    for asked in ("abca", "abcabc", "cccccc", "a" * 28):
        allowed = 1 if len(asked) <= 5 else 2
        want = {w for w in words if edits(w, asked) <= allowed}
        got = {r["word"] for r in fuzzy.near_words(table, keys, asked).collect()}
        assert want <= got
    assert set(fuzzy.deletions("abc")) == {"abc", "ab", "ac", "bc", "a", "b", "c"}


@pytest.mark.parametrize("asked", ["star forge", "sttar frge", "st", "star star", "moonn pth", "zzzz", "", "of"])
def test_same_as_scoring_every_row(spark, asked):
    rng = random.Random(5)
    vocabulary = ["star", "stars", "forge", "frog", "iron", "moon", "path", "starlight", "of", "sta", "fo"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) for _ in range(200)] + ["", None, "star forge"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text_fold string").withColumn("text_fold", F.coalesce("text_fold", F.lit("")))
    rows = rows.withColumn("words", distinct_words("text_fold")).withColumn("title_fold", F.col("text_fold"))
    want = {r["id"]: float(r["score"]) for r in search.search(rows, "id", asked).collect()}
    got = {r["id"]: float(r["score"]) for r in fuzzy.search_words(rows, "id", asked).collect()}
    assert got == want
