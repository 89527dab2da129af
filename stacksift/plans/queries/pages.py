"""Extraction from pages, urls, media and image headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import urls
from ...sources import pages as html
from ...sources.images import header
from .. import tables
from .registry import collapse, query

_BASE = "regexp_replace(url, '[?#].*$', '')"
_DECODED = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TITLE = collapse(_DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_titles(tables.pages(spark, sf_dir), "page_id").select("page_id", "title")


@query(f"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
  unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM pages)
SELECT page_id, pos::INTEGER AS pos, {_DECODED.format('href')} AS href,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*'), '^http://', 'https://') || {_DECODED.format('href')} AS url FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(tables.pages(spark, sf_dir), "page_id", "url")


@query(rf"""
SELECT page_id, {_BASE} AS identity, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  regexp_extract(regexp_replace({_BASE}, '/+$', ''), '([^/]*)$', 1) AS segment,
  regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://'), '[?#].*$', ''), '/*$', '') || '/' AS post,
  starts_with(url, 'https://') AS secure,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*'), '^http://', 'https://') || '/img/a.gif' AS image
FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select(
        "page_id",
        urls.identity("url").alias("identity"),
        urls.host_of("url").alias("host"),
        urls.last_segment("url").alias("segment"),
        urls.post_url("url").alias("post"),
        urls.is_https("url").alias("secure"),
        urls.absolute("url", F.lit("../../../img/./a.gif")).alias("image"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned into listings: the heading linked, then a date, tags, size and cover."""
    pages = tables.pages(spark, sf_dir)
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    head = F.concat(F.lit('<h1 class="entry-title"><a href="'), "url", F.lit('">'))
    number = F.col("page_id").cast("string")
    tail = F.concat(
        F.lit('</a></h1><time datetime="2024-01-01"></time><div class="entry-content"><p><img data-src="http://img.example.com/'), number,
        F.lit('.jpg" src="data:x"><b>Genres/Tags:</b> '), lang, F.lit(", <i>Puzzle</i>, Company: None<br>Repack Size: from "), number,
        F.lit(",5 GB</p></div>"),
    )
    listed = F.replace(F.replace("html", F.lit("<h1>"), head), F.lit("</h1>"), tail)
    return pages.select(F.col("page_id").alias("page"), "url", listed.alias("html"))


@query(rf"""
SELECT page_id AS page, regexp_extract(regexp_replace({_BASE}, '/+$', ''), '([^/]*)$', 1) AS id, {_TITLE} AS title,
  regexp_replace(url, '^http://', 'https://') AS source_url, 'https://img.example.com/' || page_id || '.jpg' AS image_url,
  '2024-01-01' AS post_date, regexp_extract(html, '<html lang="([a-z]*)"', 1) || '|Puzzle' AS genres, page_id || '.5 GB' AS size_text
FROM pages""")
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.listing_records(listing_pages(spark, sf_dir))
    return rows.drop("position").withColumn("genres", F.array_join("genres", "|")).withColumn(
        "title", F.regexp_replace("title", r"\s+", " ")
    )


@query("""SELECT page_id, greatest(page_id, 1) AS pages, least(greatest(page_id, 1), 8)::INTEGER AS planned FROM pages""")
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest pager number of every page, and the pages an incremental scan would read."""
    pager = F.concat(F.lit('<a class="page-numbers">1</a><a class="x page-numbers">'), "page_id", F.lit('</a><a class="page-numbers">Next</a></nav>'))
    rows = tables.pages(spark, sf_dir).select("page_id", F.replace("html", F.lit("</nav>"), pager).alias("html"))
    counted = html.page_count(rows)
    return counted.select(
        "page_id", F.col("pages").cast("long").alias("pages"), F.size(html.page_plan(F.col("pages"), 8, False)).alias("planned")
    )


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned into detail pages: a description with features, and media."""
    number = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('<div class="entry-content"><a href="/full/'), number, F.lit('.gif"><img src="/thumb/'), number,
        F.lit('-320x180.gif"></a><img src="/logo.png"><a href="/shots/'), number, F.lit('.jpg"><img src="/shots/'), number,
        F.lit('.jpg.240p.jpg"></a><img src="/other/'), number, F.lit('.jpg.240p.jpg" srcset="/o/s.jpg 1x, /o/'), number,
        F.lit('.jpg 2x"><img src="/plain/'), number,
        F.lit('.jpg.240p.jpg"><h3>Repack Features</h3><ul><li>Small</li><li>• small</li><li>Fast</li></ul>'
              '<div class="su-spoiler-title">Game Description</div><div>A long tale of page '), number,
        F.lit(" <p>Game Features</p><p>– Maps</p><p>Teams</p></div></div></article>"),
    )
    pages = tables.pages(spark, sf_dir)
    return pages.select(
        "page_id", F.col("url").alias("source_url"), F.lit("https://img.example.com/cover.jpg").alias("cover_url"),
        F.replace("html", F.lit("</article>"), body).alias("html"),
    )


@query("""
SELECT page_id, 'A long tale of page' || chr(10) || page_id AS description, 'Maps|Teams' AS features, 'Small|Fast' AS package FROM pages
""".replace("|| chr(10) ||", "|| ' ' ||"))
def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.detail_text(detail_pages(spark, sf_dir), "page_id")
    return rows.select(
        "page_id", "details.description", F.array_join("details.features", "|").alias("features"),
        F.array_join("details.package_features", "|").alias("package"),
    )


_ORIGIN = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*'), '^http://', 'https://')"


@query(f"""
WITH p AS (SELECT page_id, {_ORIGIN} AS o FROM pages)
SELECT page_id, 'gif ' || o || '/full/' || page_id || '.gif < ' || o || '/thumb/' || page_id || '-320x180.gif|'
  || 'image ' || o || '/shots/' || page_id || '.jpg < ' || o || '/shots/' || page_id || '.jpg.240p.jpg|'
  || 'image ' || o || '/o/' || page_id || '.jpg < ' || o || '/other/' || page_id || '.jpg.240p.jpg|'
  || 'image ' || o || '/plain/' || page_id || '.jpg < ' || o || '/plain/' || page_id || '.jpg.240p.jpg' AS media FROM p""")
def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One animation first, then screenshots, with full size and preview."""
    rows = html.page_media(detail_pages(spark, sf_dir), key="page_id")
    line = F.transform("media", lambda m: F.concat_ws(" ", m["type"], m["url"], F.lit("<"), m["preview_url"]))
    return rows.select("page_id", F.array_join(line, "|").alias("media"))


@query(f"""
SELECT page_id, {_ORIGIN} || CASE WHEN page_id % 2 = 0 THEN '/thumb/' || page_id || '-320x180.gif' ELSE '/full/' || page_id || '.gif' END AS url
FROM pages""")
def media_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured sizes decide: on even pages the thumbnail is the larger file."""
    candidates = html.animation_candidates(html.page_images(detail_pages(spark, sf_dir), "page_id"), "page_id")
    even = F.col("page_id") % 2 == 0
    thumb = F.col("url").contains("320x180")
    probes = candidates.select(
        "url", F.when(even & thumb, 900).otherwise(300).alias("width"), F.lit(200).alias("height"), F.lit(10).alias("bytes")
    ).distinct()
    return html.best_animations(candidates, probes, "page_id").select("page_id", "url")


@query("""
SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_size + 256 END AS width, CASE WHEN p_type = 'SMALL' THEN 0 ELSE 720 END AS height FROM part""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions out of binary image headers; another signature gives none."""
    signature = F.when(F.col("p_type") == "SMALL", "89504E470D0A").otherwise("474946383961")
    content = F.unhex(F.concat(signature, F.lpad(F.hex(F.col("p_size").cast("long")), 2, "0"), F.lit("01D002"), F.lit("F70000")))
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", header(content).alias("h"))
    return rows.select("p_partkey", "h.width", "h.height")
