"""Column functions against plain Python or invented golden values."""

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from stacksift.functions import decisions, fold, text, titles, urls


def column(spark, values, expression, name="v"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col(name)).alias("r")).collect()]


def test_folds_equal_unicodedata_for_every_character(spark):
    codes = [c for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF] + [0xE0100, 0x2F800, 0x10FFFD]
    values = ["a" + chr(c) + "b " + chr(c) for c in codes]
    rows = spark.createDataFrame([(v,) for v in values], "s string")
    out = rows.select("s", fold.search_fold("s").alias("a"), fold.match_fold("s").alias("b")).toPandas()

    def marks(form, s):
        return "".join(ch for ch in unicodedata.normalize(form, s) if not unicodedata.combining(ch))

    def words(s):
        return re.sub(r"[^a-z0-9]+", " ", s).strip()

    assert [r.s for r in out.itertuples() if r.a != words(marks("NFD", r.s).lower())] == []
    assert [r.s for r in out.itertuples() if r.b != words(marks("NFKD", r.s).casefold().replace("&", " and "))] == []


def test_title_cleaning(spark):
    cases = {
        "Star Forge – v1.2.3 + Bonus OST": ("Star Forge", "Star Forge"),
        "Star Forge: Ultimate Edition": ("Star Forge: Ultimate Edition", "Star Forge"),
        "R&amp;D Tycoon &#8211; Build 99 (Portable)": ("R&D Tycoon", "R&D Tycoon"),
        "Moon&#146;s Path - Game of the Year Edition": ("Moon’s Path - Game of the Year Edition", "Moon’s Path"),
        "Sky Colony [Crack Fix]": ("Sky Colony [Crack Fix]", "Sky Colony"),
        "Iron Vale: The Long Road": ("Iron Vale: The Long Road", "Iron Vale: The Long Road"),
        "v1.0": ("v1.0", "v1.0"),
        "Deep Run, update 4/2": ("Deep Run, update 4/2", "Deep Run"),
    }
    got = column(spark, list(cases), lambda c: F.struct(titles.conservative_title(c), titles.aggressive_title(c)))
    assert [tuple(g) for g in got] == list(cases.values())


def test_title_variants_and_terms(spark):
    names = column(spark, ["Star Forge: Northern Expanse – v1.4"], titles.title_variants)[0]
    assert names == ["Star Forge: Northern Expanse", "Northern Expanse", "Forge Northern", "Star Forge", "Northern"] or set(
        names
    ) == {"Star Forge: Northern Expanse", "Northern Expanse", "Forge Northern", "Star Forge", "Northern"}
    assert [len(n) for n in names] == sorted((len(n) for n in names), reverse=True)


def test_sizes_years_lists(spark):
    assert column(spark, ["from 3,5 GB to 7 GB", "900 KB", "1 TB / 700 MB", None], text.size_mb) == [3584.0, None, 700.0, None]
    assert column(spark, ["2021-05-01", "1999-01-01", "x2020"], text.year_of) == [2021, None, None]
    long = "x" * 200
    got = column(spark, [f'["{long}", "{long}", "a", " a "]', "{", '{"a":1}'], lambda c: text.json_list(c))
    assert got == [["x" * 180, "x" * 180, "a"], [], []]


def test_entities_and_sentences(spark):
    assert column(spark, ["Tom &amp; J&#x41; &copy; &bogus; &#0;", "a & b"], text.unescape_entities) == ["Tom & JA © &bogus; �", "a & b"]
    assert column(spark, ["One here. Two there! three (Four) ok? “Five”."], text.sentences) == [
        ["One here.", "Two there! three (Four) ok?", "“Five”."]
    ]


def test_srcset_and_rewrites(spark):
    assert [e["url"] for e in column(spark, ["/a 1x, /b 640w, /c 2x, /d"], urls.srcset)[0]] == ["/c", "/a", "/b", "/d"]
    assert column(spark, ["https://h/a.gif?w=1&k=2&h=3", "https://h/a.png?w=1"], urls.without_resize_query) == [
        "https://h/a.gif?k=2", "https://h/a.png?w=1"
    ]
    assert column(spark, ["https://h/a-320x200.gif?x"], urls.without_size_suffix) == ["https://h/a.gif?x"]
    links = ["b.png", "../b.png", "//x/b", "?q", "data:abc", "mailto:x@y", "http://z/a", ""]
    got = column(spark, links, lambda c: urls.absolute(F.lit("http://h/p/q/r.html?s"), c))
    assert got == ["https://h/p/q/b.png", "https://h/p/b.png", "https://x/b", "https://h/p/q/r.html?q", "", "", "https://z/a", ""]


def test_decision_parsing(spark):
    cases = {
        '{"candidate_id":"Q7","confidence":0.97,"reason":" a  b "}': ("Q7", 0.97, "a b", None),
        '```json\n{"candidate":"the entity q7","confidence_score":"96%","rationale":"r"}\n```': ("Q7", 0.96, "r", None),
        '{"candidate_id":null,"confidence":"0,4"}': (None, 0.4, "", None),
        "I choose Q8. Confidence: 93 %": ("Q8", 0.93, "I choose Q8. Confidence: 93 %", None),
        "candidate: none, confidence 0.2": (None, 0.2, "candidate: none, confidence 0.2", None),
        "Q7 or Q8, confidence 0.5": (None, None, None, "mentions multiple supplied candidates"),
        '{"candidate_id":"Q99","confidence":1}': (None, None, None, "selected a candidate outside the supplied evidence"),
        '{"candidate_id":"Q7","confidence":2}': (None, None, None, "confidence must be between 0 and 1"),
        '{"candidate_id":"Q7"}': (None, None, None, "confidence is missing or invalid"),
        "Q7 surely": (None, None, None, "missing explicit confidence"),
        "   ": (None, None, None, "response is empty"),
    }
    allowed = F.array(F.lit("Q7"), F.lit("Q8"))
    got = column(spark, list(cases), lambda c: decisions.parse_decision(c, allowed))
    assert [tuple(g) for g in got] == list(cases.values())


def test_retry_delay(spark):
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    got = column(spark, ["12", "0", "Mon, 01 Jan 2024 00:00:30 GMT", "", "x"], lambda c: decisions.retry_seconds(c, F.lit(2), now))
    assert got == [12.0, 1.0, 30.0, 20.0, 20.0]


def test_edition_title(spark):
    rows = spark.createDataFrame(
        [("Star Forge – v2", "Star Forge"), ("STAR FORGE", "star forge"), ("Other", "Star Forge"), ("Étoile", "Etoile")], "t string, c string"
    )
    got = [r[0] for r in rows.select(titles.edition_title("t", "c")).collect()]
    assert got == ["v2", "", "Other", "Étoile"]


def test_long_and_deep_pages_parse_in_linear_time():
    import time

    from stacksift.sources.pages import _nodes

    began = time.time()
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    flat = "<p><a href=u><img src=i></a><span>Game Description</span></p>" * 12500
    mixed = "".join(f"<div><strong>part {i}</strong>" for i in range(10000))
    rows = [_nodes(h) for h in (deep, flat, mixed)]
    assert time.time() - began < 10
    images = [r for r in rows[1] if r["tag"] == "img"]
    assert all(rows[1][r["link"]]["tag"] == "a" and r["picture"] is None for r in images)
    assert [r["label"] for r in rows[1] if r["tag"] == "span"] == ["Game Description"] * 12500
    assert rows[0][0]["label"] == "x" and rows[2][0]["label"] is None


def test_labels_are_the_texts_of_short_elements():
    from stacksift.sources.pages import _nodes

    html = "<div>a<span> b <b>c</b></span><div>" + "d" * 120 + "</div></div><picture><source srcset=s><a><img></a></picture><strong>e"
    rows = {(r["tag"], r["pos"]): r for r in _nodes(html)}
    labels = {k[0] + str(k[1]): r["label"] for k, r in rows.items() if k[0] in ("div", "span", "strong")}
    assert list(labels.values()) == [None, "b c", None, "e"]
    image = next(r for r in rows.values() if r["tag"] == "img")
    assert image["link"] is None and image["picture"] is not None
