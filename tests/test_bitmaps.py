import random

from pyspark.sql import functions as F
from stacksift.operators import bitmaps


def test_like_brute_force(spark):
    rng = random.Random(3)
    kinds = ["a", "b", "c", "d", "e"]
    rows = [(n, [k for k in kinds if rng.random() < 0.4] + (["rare"] if n % 9000 == 5 else [])) for n in range(0, 40_000, 3)]
    rows += [(32_767, ["a", "a", "b"]), (32_768, ["a", "b"]), (70_000, [])]
    rows = list(dict(rows).items())
    table = spark.createDataFrame(rows, "ordinal long, tags array<string>").repartition(5)
    asked = [("ab", ["a", "b"]), ("abc", ["a", "b", "c", "a"]), ("rare", ["rare"]), ("none", ["a", "zz"]), ("empty", [])]
    asked += [(f"s{i}", rng.sample(kinds, rng.randint(1, 4))) for i in range(600)]
    maps = bitmaps.key_bitmaps(table, "ordinal", F.col("tags"))
    pool = bitmaps.pools(maps, spark.createDataFrame(asked, "selection string, keys array<string>"))
    got = {(r["selection"], r["key"]): r["rows"] for r in bitmaps.facets(pool, maps).collect()}
    sizes = {r["selection"]: r["rows"] for r in bitmaps.pool_sizes(pool).collect()}
    want, totals = {}, {}
    by_keys = {}
    for name, keys in asked:
        held = frozenset(keys)
        if held not in by_keys:
            inside = [t for _, t in rows if held and held <= set(t)]
            by_keys[held] = (len(inside), {k: n for k in [*kinds, "rare"] if (n := sum(k in t for t in inside))})
        total, counts = by_keys[held]
        if total:
            totals[name] = total
        want.update({(name, k): n for k, n in counts.items()})
    assert got == want and sizes == totals
    found = sorted(r["ordinal"] for r in bitmaps.selected_rows(pool.filter("selection = 'ab'")).collect())
    assert found == sorted(n for n, t in rows if {"a", "b"} <= set(t))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ordinal long, tags array<string>")
    maps = bitmaps.key_bitmaps(none, "ordinal", F.col("tags"))
    pool = bitmaps.pools(maps, spark.createDataFrame([("x", ["a"])], "selection string, keys array<string>"))
    assert bitmaps.facets(pool, maps).collect() == [] and bitmaps.pool_sizes(pool).collect() == []
    assert bitmaps.selected_rows(pool).collect() == [] and bitmaps.all_rows(none, "ordinal").collect() == []
