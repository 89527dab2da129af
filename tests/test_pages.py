"""Parsing of pages in small batches."""

import pyarrow as pa

from stacksift.sources import pages


def test_nodes_leave_in_small_batches():
    texts = ["<p>" + "x" * 9000 + "</p><img src=a>", None, ""] * 200
    batch = pa.RecordBatch.from_pydict({"page": list(range(600)), "html": texts})
    out = list(pages._parsed_batches(iter([batch, batch.slice(0, 0)]), "html", ["page"], "nodes"))
    assert len(out) > 5 and max(sum(len(texts[i] or "") for i in b["page"].to_pylist()) for b in out) < pages.PARSED_BYTES + 10_000
    assert [i for b in out for i in b["page"].to_pylist()] == list(range(600))
    lists = [n for b in out for n in b["nodes"].to_pylist()]
    assert [n["tag"] for n in lists[0]] == ["p", "#text", "img"] and lists[0][2]["attrs"] == [("src", "a")] and lists[1] == lists[2] == []


def test_nodes_of_large_arrow_batches(spark):
    rows = spark.range(3000).selectExpr("id", "concat('<h1><a href=', id, '>t</a></h1>', repeat('<br>', 100)) AS html").coalesce(1)
    got = pages.page_links(rows.selectExpr("id", "'https://a.example/' AS url", "html"), "id", "url").collect()
    assert sorted((r["id"], r["href"]) for r in got) == [(i, str(i)) for i in range(3000)]
