from fractions import Fraction

from pyspark.sql import functions as F
from stacksift.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, `row` int"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        units = sum(weight[s] for s in names if s not in full)
        level = Fraction(rest, units) if units else 0
        more = {s for s in names if s not in full and weight[s] * level >= most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s] if s in full else weight[s] * level) for s in names}
        full |= more


def rows():
    out = []
    for i in range(400):
        source = "big" if i < 300 else ("s%d" % (i % 7) if i % 11 else None)
        out.append((i, "w " * (i % 13) + "end x", "en", source, i, "s", 1, 2))
    out += [(1000, None, None, "only-empty", None, None, None, None), (1001, " \n\t", None, "only-empty", 3, None, None, None)]
    out += [(7, "again and again", "en", "big", 1, None, None, None)] * 3 + [(None, "no id", None, "Zed", 5, None, None, None)] * 2
    out += [(1002, "long " * 50000, "en", "é", 250000, None, None, None)]
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes, taken = {}, {}
    named = {}
    for r in rows():
        n = len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
        sizes[r[3]] = sizes.get(r[3], 0) + n
        named[r[0]] = r[3]
    targets = brute_targets(sizes)
    for r in got:
        source = named[r.doc_id]
        assert abs(r.target - targets[source]) < 1e-6 and r.source_size == sizes[source]
        assert 0 <= r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 4, source
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = F.sum(mixing.word_count(F.col("text"))).alias("n")
    mixed = {r.source: r.n for r in out.groupBy("source").agg(count).collect()}
    wanted = {}
    for r in mixing.mix(docs).join(docs.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect():
        wanted[r.source] = wanted.get(r.source, 0) + r.taken
    assert mixed == {s: n for s, n in wanted.items() if n}
    texts = {r[1] for r in rows() if r[1]}
    for r in out.collect():
        assert r.text in texts or any(t.startswith(r.text) for t in texts)


def test_empty_and_one_source(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
    one = docs.filter("source = 'big'")
    assert all(r.taken == r.size for r in mixing.mix(one).collect())
    none = docs.filter("source = 'only-empty'")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 2
