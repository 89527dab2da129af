import random
from datetime import datetime

from pyspark.sql import functions as F
from stacksift.operators import search
from stacksift.sources import deltas
from stacksift.sources.index_store import SegmentedIndex

DAY = datetime(2024, 1, 1)
WORDS = ["star", "forge", "iron", "vale", "moon", "path", "starlight", "of"]


def records(spark, held):
    return spark.createDataFrame(list(held.items()), "id string, words array<string>")


def keys_of(spark, held):
    return sorted(map(tuple, search.postings(records(spark, held), "id", "words").collect()))


def test_updates_equal_a_new_index(spark, tmp_path):
    rng = random.Random(5)
    index = SegmentedIndex(spark, str(tmp_path))
    assert index.postings().count() == 0
    held = {f"r{i}": rng.sample(WORDS, rng.randint(0, 3)) for i in range(60)}
    index.build(records(spark, held), "words", DAY)
    kinds = []
    for n in range(6):
        changed = {f"r{rng.randrange(80)}": rng.sample(WORDS, rng.randint(0, 3)) for _ in range(12)}
        gone = [k for k in rng.sample(sorted(held), 4) if k not in changed]
        index.update(records(spark, changed), "words", DAY, spark.createDataFrame([(g,) for g in gone], "id string"))
        held.update(changed)
        for g in gone:
            held.pop(g)
        if n % 2:
            kinds.append(index.merge(DAY))
        assert sorted(map(tuple, index.postings().collect())) == keys_of(spark, held)
    assert "base" in kinds
    for text in ("star", "forg iron", "zzzz"):
        fresh = search.candidates(search.postings(records(spark, held), "id", "words"), "id", text)
        assert sorted(index_ids(search.candidates(index.postings(), "id", text))) == sorted(index_ids(fresh))


def index_ids(found):
    return [r["id"] for r in found.collect()]


def test_an_update_writes_what_changes(spark, tmp_path):
    words = F.array(F.concat(F.lit("word"), F.col("id")), F.lit("common"))
    written = []
    for n in (500, 10_000):
        index = SegmentedIndex(spark, f"{tmp_path}/{n}")
        index.build(spark.range(n).select(F.col("id").cast("string").alias("id")).withColumn("words", words), "words", DAY)
        index.update(spark.range(20).select(F.col("id").cast("string").alias("id"), F.array(F.lit("other")).alias("words")), "words", DAY)
        written.append(deltas.written_bytes(spark, index.root, 1))
        assert index.merge(DAY) is None
        found = search.candidates(index.postings(), "id", "common")
        assert found.count() == n - 20
        plan = found._jdf.queryExecution().toString()
        assert "PushedFilters: [Or(" in plan or "EqualTo(key" in plan or "In(key" in plan
    assert written[1] < 1.2 * written[0]


def test_small_segments_become_one(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    many = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.array(F.sha2(F.col("id").cast("string"), 256)).alias("words"))
    index.build(many, "words", DAY)
    for n in range(4):
        index.update(records(spark, {"1": [f"fresh{n}"], f"x{n}": ["fresh"]}), "words", DAY)
    assert index.merge(DAY) == "segment"
    assert [s.base for s in deltas.state(spark, index.root).live] == [True, False]
    assert index.postings().filter("key = 'fresh3'").count() == 1 and index.postings().filter("key = 'fresh0'").count() == 0
    assert index.postings().filter("id = '1'").count() == search.postings(records(spark, {"1": ["fresh3"]}), "id", "words").count()
