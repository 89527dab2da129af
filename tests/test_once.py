"""Costly steps are evaluated once a row, and once a pair; small files are shared out."""

from pyspark.sql import functions as F

from stacksift.functions import decisions, scoring, titles
from stacksift.operators import resolve
from stacksift.plans.queries import QUERIES
from test_jobs import CANDIDATE_FIELDS, candidate

SF = "/root/testdata/sf0.001"


def _plan(rows):
    return rows._jdf.queryExecution().analyzed().toString()


def test_title_is_split_once(spark):
    rows = spark.createDataFrame([("Star Forge: Deluxe – v1.0",), (None,)], "t string")
    named = rows.select(titles.title_variants("t").alias("v"))
    assert _plan(named).count("split(") == 1 and named.collect()[1]["v"] == []


def test_result_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"confidence":2}',), (None,), ("{",)], "t string")
    checked = rows.select(decisions.validate_result("t", F.array(F.lit("u"))).alias("r"))
    assert _plan(checked).count("from_json") == 1
    none = "response does not contain a JSON object"
    assert [r["r"]["error"] for r in checked.collect()] == ["confidence must be between 0 and 1", none, none]


def test_titles_of_one_file_are_shared_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert all(QUERIES[name](spark, SF).rdd.getNumPartitions() >= cores for name in ("title_clean", "title_terms", "validate_results"))


def test_evidence_is_distinct_without_comparing_all(spark):
    one, two, odd = candidate("Q1", "Star Forge"), candidate("Q2", "Star Forge"), candidate("Q0", "Star Forges")
    found = [("Star Forge", odd), ("Star Forge", two), ("Star Forge", one), ("STAR FORGE", one), ("Star Forge", one)]
    rows = spark.createDataFrame(found, f"title string, candidate struct<{CANDIDATE_FIELDS}>")
    asked = rows.select("title").unionAll(spark.createDataFrame([("Moon",)], "title string"))
    cache = resolve.evidence_cache(rows, asked, F.lit("2024-01-01").cast("timestamp"))
    assert "array_distinct(transform" not in _plan(cache)
    got = {r["search_title"]: [c["id"] for c in r["evidence"]] for r in cache.collect()}
    assert got == {"star forge": ["Q1", "Q2", "Q0"], "moon": []}


def test_ratio_of_a_pair_is_computed_once():
    scoring._ratio.cache_clear()
    for _ in range(3):
        scoring._ratio("star forge", "star forges")
    assert scoring._ratio.cache_info().misses == 1


def test_another_order_is_no_partition_by_language(spark):
    assert "RepartitionByExpression [lang" not in _plan(QUERIES["snapshot_equal"](spark, SF))


def test_files_below_one_folder(spark, tmp_path):
    from stacksift.sources import images

    rows = spark.range(50, numPartitions=1).selectExpr("concat('a/', id, '.gif') AS name", "X'00' AS content")
    images.write_files(rows, str(tmp_path))
    assert len(list((tmp_path / "a").iterdir())) == 50
