from pyspark.sql import functions as F
from stacksift.operators import search


def test_keys_are_stored_once_a_word_and_offer_the_same_rows(spark, tmp_path):
    texts = ["lantern harbor", "lanterns lantern lanter", "harbour lantana x", "", "ember " * 3, "thand heren", "hand here hander"]
    rows = spark.createDataFrame(list(enumerate(texts * 5)), "id long, text string").select("id", F.array_distinct(F.split("text", " ")).alias("words"))
    index = search.stored_index(rows, "id", "words", f"{tmp_path}/index")
    plain = search.postings(rows, "id", "words")
    assert set(index.collect()) == set(plain.collect()) and index.columns == plain.columns
    # The rows are stored by word alone, and keys do not grow with the rows.
    assert spark.read.parquet(f"{tmp_path}/index/words").count() == rows.select(F.explode("words")).count()
    assert spark.read.parquet(f"{tmp_path}/index/keys").groupBy("kind", "key", "_word").count().filter("count > 1").isEmpty()
    long = "thandheren" * 9
    for asked in ["lantern", "lantern harb", "thand heren", "hander", "zzzz", long]:
        want = {r["id"] for r in search.candidates(plain, "id", asked).collect()}
        assert {r["id"] for r in search.candidates(index, "id", asked).collect()} == want
