from pyspark.sql import functions as F
from stacksift.operators import salting


def sides(spark):
    """Half of all rows have one key; some keys are null or unknown."""
    n = 20_000
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 101 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    many = spark.range(n).select(F.col("id").alias("row"), key.alias("key"))
    few = spark.range(900).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value")).unionByName(
        spark.createDataFrame([("hot", -1), ("hot", -2)], "key string, value long"))
    return many, few


def test_same_rows_as_a_plain_join(spark):
    many, few = sides(spark)
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = many.join(few, "key", how)
        got = salting.salted_join(many, few, ["key"], how, most=500)
        assert got.columns == want.columns
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert salting.salted_join(many.limit(0), few, ["key"]).isEmpty()


def test_no_part_is_much_larger_than_asked(spark):
    many, few = sides(spark)
    hot = {r["key"]: r["_parts"] for r in salting.hot_keys(many, ["key"], 500).collect()}
    assert hot == {"hot": 20}
    joined = salting.salted_join(many, few, ["key"], "inner", most=500)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan
    value = F.xxhash64(F.to_json(F.struct("row", "key")))
    sizes = many.filter("key = 'hot'").groupBy(F.pmod(value, F.lit(20))).count().agg(F.max("count")).first()[0]
    assert sizes < 1.3 * 500
