"""Filters, facets, orders, rails, libraries and recommendations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.text import display_genre, genre_label, platform_label, size_mb, year_of
from ...operators import bitmaps, browse, ordinals, recommend
from ...session import checkpoint_dir, cut_lineage
from ...sources import sort_runs
from .. import tables
from .registry import PREPARED, TAGS, fold, query, query_score
from .search import prepared

ORDER_NOW = datetime(1998, 7, 15, 9, 30, 0)
PERIODS = ["7d", "30d", "90d", "this-year", "this-week", "last-week"]
NOW = tables.NOW
_NOW = f"TIMESTAMP '{NOW}'"
_QUERY = "gizmo"


@query("""
SELECT p_partkey, CASE WHEN p_size < 1 THEN 'lt1' WHEN p_size < 10 THEN '1-10' WHEN p_size < 50 THEN '10-50' ELSE 'gte50' END AS bucket
FROM part WHERE p_size > 0""")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part").select(
        "p_partkey", size_mb(F.concat(F.col("p_size").cast("string"), F.lit(" GB"))).alias("mb")
    )
    bucket = F.coalesce(*[F.when(browse.size_in(F.col("mb"), b), b) for b in browse.SIZE_BUCKETS])
    return parts.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).drop("mb")


@query("""
SELECT p_partkey, CAST(round(least(p_size * 1024, (p_size + 0.5) * 1, p_size * 1048576), 2) AS DOUBLE) AS mb FROM part""")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of several sizes in a text, decimal comma included; KB is unknown."""
    size = F.col("p_size").cast("string")
    text = F.concat(size, F.lit(" GB / from "), size, F.lit(",5 mb, "), size, F.lit("TB or 3 KB"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", size_mb(text).alias("mb"))


_WEEK = "TIMESTAMP '1998-07-13 00:00:00'"
_AT = f"TIMESTAMP '{ORDER_NOW}'"


@query(f"""
SELECT '7d' AS period, o_orderkey FROM orders WHERE o_orderdate BETWEEN {_AT} - INTERVAL 7 DAY AND {_AT}
UNION ALL SELECT '30d', o_orderkey FROM orders WHERE o_orderdate BETWEEN {_AT} - INTERVAL 30 DAY AND {_AT}
UNION ALL SELECT '90d', o_orderkey FROM orders WHERE o_orderdate BETWEEN {_AT} - INTERVAL 90 DAY AND {_AT}
UNION ALL SELECT 'this-year', o_orderkey FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'this-week', o_orderkey FROM orders WHERE o_orderdate BETWEEN {_WEEK} AND {_AT}
UNION ALL SELECT 'last-week', o_orderkey FROM orders
  WHERE o_orderdate >= {_WEEK} - INTERVAL 7 DAY AND o_orderdate < {_WEEK}""")
def release_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in every release period; one pass over the table."""
    rows = tables.table(spark, sf_dir, "orders")
    when = F.col("o_orderdate").cast("timestamp")
    hits = F.array(*[F.when(browse.released_in(when, p, ORDER_NOW), p) for p in PERIODS])
    found = rows.select("o_orderkey", F.explode(F.filter(hits, lambda p: p.isNotNull())).alias("period"))
    return found.select("period", "o_orderkey")


@query(f"""
WITH {PREPARED} SELECT id, title FROM prepared WHERE type_key = 'economy' AND brand_key = 'brand 7'""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir)
    return rows.filter(browse.has_all_tags(F.col("tag_keys"), ["economy", "brand 7"])).select("id", "title")


_FILTERED = f"""
scored AS (SELECT *, CAST({query_score(_QUERY, 'title_fold', 'text_fold')} AS DOUBLE) AS score FROM prepared),
pool AS (SELECT * FROM scored WHERE score > 0 AND p_size >= 10 AND p_size < 50 AND details_ready AND media_count > 0
  AND TRY_CAST(post_date AS TIMESTAMP) > {_NOW} - INTERVAL 30 DAY AND type_key = 'economy')"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.filtered(
        prepared(spark, sf_dir), NOW, query=_QUERY, tags=["economy"], size="10-50",
        new_only=True, described_only=True, with_media_only=True,
    )


@query(f"WITH {PREPARED}, {_FILTERED} SELECT id, score FROM pool")
def combined_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir).select("id", "score")


@query(f"""
WITH {PREPARED}
SELECT id, title FROM prepared WHERE p_size >= 10 AND p_size < 50 AND id IN (
  SELECT json_extract_string(props, '$.k') FROM events WHERE event_type = 'purchase')""")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog items of one size bucket that anyone has as a favorite."""
    favorites = tables.library(spark, sf_dir).filter(F.col("list") == "favorites")
    return browse.filtered(prepared(spark, sf_dir), NOW, size="10-50", library=favorites).select("id", "title")


@query(f"""
WITH {TAGS}
SELECT key, arg_min(label, (CAST(id AS BIGINT), pos)) AS label, count(*) AS rows FROM tags GROUP BY key""")
def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.tag_dictionary(prepared(spark, sf_dir), F.col("id").cast("long"))


@query(f"""
WITH {TAGS}, pool AS (SELECT * FROM prepared WHERE type_key = 'economy' AND details_ready),
hits AS (SELECT key, count(*) AS n FROM tags WHERE id IN (SELECT id FROM pool) GROUP BY key)
SELECT DISTINCT t.key, t.key = 'economy' AS active,
       CASE WHEN t.key = 'economy' THEN (SELECT count(*) FROM pool) ELSE COALESCE(n, 0) END AS hits,
       contains(t.key, 'brand 2') AND (t.key = 'economy' OR COALESCE(n, 0) > 0) AS visible
FROM tags t LEFT JOIN hits USING (key)""")
def tag_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drill-down counts with one selected tag and a tag search."""
    rows = prepared(spark, sf_dir)
    pool = browse.filtered(rows, NOW, tags=["economy"], described_only=True)
    dictionary = browse.tag_dictionary(rows, F.col("id").cast("long"))
    return browse.facets(dictionary, pool, ["economy"], "Brand#2").drop("label")


@query(f"""
WITH {TAGS},
asked AS (
  SELECT DISTINCT type_key AS a, NULL AS b FROM prepared UNION SELECT DISTINCT brand_key, NULL FROM prepared
  UNION SELECT DISTINCT type_key, brand_key FROM prepared),
flags AS (SELECT unnest([false, true]) AS described), media AS (SELECT unnest([false, true]) AS shown),
selections AS (SELECT a, b, described, shown FROM asked, flags, media),
pool AS (
  SELECT a, b, described, shown, p.id FROM selections s JOIN prepared p
    ON (s.a = p.type_key OR s.a = p.brand_key) AND (s.b IS NULL OR s.b = p.brand_key)
       AND (NOT s.described OR p.details_ready) AND (NOT s.shown OR p.media_count > 0)),
sizes AS (SELECT a, b, described, shown, count(*) AS total FROM pool GROUP BY ALL),
hits AS (SELECT a, b, described, shown, t.key, count(*) AS hits FROM pool JOIN tags t USING (id) GROUP BY ALL)
SELECT concat_ws('|', a, hits.b, CASE WHEN described THEN '+described' END, CASE WHEN shown THEN '+media' END) AS selection,
       key, hits, total
FROM hits JOIN sizes USING (a, described, shown) WHERE hits.b IS NOT DISTINCT FROM sizes.b""")
def facets_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all tags under every selection of a type, a brand or both, with or without descriptions and media."""
    numbered = ordinals.with_ordinals(prepared(spark, sf_dir), [F.col("id")])
    flags = F.array_compact(F.array(F.when(F.col("has_description"), F.lit("+described")), F.when(F.col("media_count") > 0, F.lit("+media"))))
    rows = cut_lineage(numbered.select("ordinal", "tag_keys", F.concat("tag_keys", flags).alias("keys")))
    maps = cut_lineage(bitmaps.key_bitmaps(rows, "ordinal", F.col("keys")))
    first, second = F.get("tag_keys", F.lit(0)), F.get("tag_keys", F.lit(1))
    # The type comes first in the SQL form; which of a row's tags that is differs.
    pair = F.when(first.startswith("brand "), F.array(second, first)).otherwise(F.array(first, second))
    asked = rows.select(F.explode(F.array(F.array(first), F.array(second), pair)).alias("tags")).distinct()
    extra = F.array(F.array(), F.array(F.lit("+described")), F.array(F.lit("+media")), F.array(F.lit("+described"), F.lit("+media")))
    selections = asked.select(F.explode(F.transform(extra.cast("array<array<string>>"), lambda x: F.concat("tags", x))).alias("keys"))
    selections = selections.select(F.array_join("keys", "|").alias("selection"), "keys")
    pool = cut_lineage(bitmaps.pools(maps, selections))
    tags = maps.filter(~F.col("key").startswith("+"))
    counts = bitmaps.facets(pool, tags).withColumnRenamed("rows", "hits")
    return counts.join(bitmaps.pool_sizes(pool).withColumnRenamed("rows", "total"), "selection")


@query(f"""
WITH {TAGS} SELECT DISTINCT id FROM tags WHERE contains(key, 'brand 2') OR contains(key, 'econ')""")
def rows_with_any_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir)
    keys = browse.tag_counts(rows).filter(F.col("key").contains("brand 2") | F.col("key").contains("econ"))
    return browse.rows_with_any_tag(rows, keys).select("id")


@query(f"""
WITH {TAGS}, d AS (SELECT key, count(*) AS rows FROM tags GROUP BY key),
r AS (SELECT key, rows, CASE WHEN key = 'brand 2' THEN 0 WHEN starts_with(key, 'brand 2') THEN 1
  WHEN len(list_filter(string_split(key, ' '), lambda w: starts_with(w, 'brand 2'))) > 0 THEN 2 ELSE 3 END AS rank FROM d)
SELECT key, rank, row_number() OVER (ORDER BY rank, rows DESC, key) - 1 AS position FROM r""")
def tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in the order of a tag search."""
    tags = browse.tag_dictionary(prepared(spark, sf_dir), F.col("id").cast("long"))
    ordered = ordinals.with_ordinals(tags, browse.tag_order("brand 2"), "position")
    rank = browse.tag_rank(F.col("key"), "brand 2")
    return ordered.select("key", rank.alias("rank"), "position")


_POSTED = "COALESCE(TRY_CAST(post_date AS TIMESTAMP), TIMESTAMP '1970-01-01')"
_RELEASED = "COALESCE(TRY_CAST(release_date AS TIMESTAMP), TIMESTAMP '1970-01-01')"
_NAME = "COALESCE(canonical_title, title)"
_ORDERS = {
    "date_desc": f"{_POSTED} DESC",
    "date_asc": _POSTED,
    "release_desc": f"{_RELEASED} DESC, {_POSTED} DESC",
    "release_asc": f"{_RELEASED}, {_POSTED}",
    "name_asc": _NAME,
    "name_desc": f"{_NAME} DESC",
    "relevance": f"score DESC, {_POSTED} DESC",
}


@query(
    f"""WITH {PREPARED},
scored AS (SELECT *, CAST({query_score(_QUERY, 'title_fold', 'text_fold')} AS DOUBLE) AS score FROM prepared),
found AS (SELECT * FROM scored WHERE score > 0)
"""
    + " UNION ALL ".join(
        f"SELECT '{name}' AS sort, id, row_number() OVER (ORDER BY {order}, id) - 1 AS ordinal FROM found"
        for name, order in _ORDERS.items()
    )
)
def result_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the matches of a query in all seven result orders."""
    from ...session import cut_lineage

    found = browse.filtered(prepared(spark, sf_dir), NOW, query=_QUERY)
    found = cut_lineage(found.select("id", "title", "canonical_title", "post_date", "game_release_date", "score"))
    parts = [
        ordinals.with_ordinals(found, browse.result_order(name, True)).select(F.lit(name).alias("sort"), "id", "ordinal")
        for name in _ORDERS
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 60")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders, newest first."""
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return ordinals.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, browse.PAGE_SIZE).drop("o_orderdate")


_PAGES = """(0, 'first'), ((SELECT count(*) FROM orders) // 60, 'middle'), (((SELECT count(*) FROM orders) - 1) // 30, 'last')"""


@query(f"""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS ordinal FROM orders),
pages AS (SELECT * FROM (VALUES {_PAGES}) AS v(page, name))
SELECT name, page, ordinal, o_orderkey, true AS few_files FROM pages JOIN n ON ordinal // 30 = page""")
def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, a middle and the last page of all orders out of a stored run, each from at most two files."""
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    run = sort_runs.stored_run(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], checkpoint_dir(spark), 2000)
    total, out = sort_runs.run_rows(spark, run), None
    for name, number in (("first", 0), ("middle", total // 60), ("last", (total - 1) // 30)):
        page = sort_runs.page(spark, run, number, browse.PAGE_SIZE)
        few = F.lit(len(page.inputFiles()) <= 2)
        page = page.select(F.lit(name).alias("name"), F.lit(number).cast("long").alias("page"), "ordinal", "o_orderkey", few.alias("few_files"))
        out = page if out is None else out.unionByName(page)
    return out


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER w - 1 AS ordinal, lag(o_orderkey) OVER w AS p, lead(o_orderkey) OVER w AS f,
  first_value(o_orderkey) OVER w AS lo, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi
  FROM orders WINDOW w AS (ORDER BY o_orderdate DESC, o_orderkey))
SELECT o_orderkey, COALESCE(p, hi) AS previous_key, COALESCE(f, lo) AS next_key FROM n""")
def result_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    found = ordinals.with_neighbours(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return found.select("o_orderkey", "previous_key", "next_key")


@query("""
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS release_year FROM orders WHERE year(o_orderdate) >= 2000""")
def release_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(year_of(tables.day("o_orderdate")).cast("string").alias("release_year"))
    return browse.release_years(rows).select(F.col("release_year").cast("int").alias("release_year"))


@query(f"""
WITH {PREPARED},
newest AS (SELECT id FROM prepared WHERE TRY_CAST(post_date AS TIMESTAMP) > {_NOW} - INTERVAL 30 DAY
  ORDER BY post_date DESC, id LIMIT 10),
updated AS (SELECT id FROM prepared WHERE post_date IS NOT NULL ORDER BY post_date DESC, id LIMIT 10)
SELECT 'new' AS rail, id FROM newest UNION ALL SELECT 'updated', id FROM updated""")
def highlight_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir)
    newest = browse.newest_rail(rows, NOW).select(F.lit("new").alias("rail"), "id")
    return newest.unionByName(browse.updated_rail(rows).select(F.lit("updated").alias("rail"), "id"))


_LIBRARY = """
library AS (
  SELECT DISTINCT user_id, CASE event_type WHEN 'purchase' THEN 'favorites' WHEN 'signup' THEN 'backlog' ELSE 'completed' END AS list,
         json_extract_string(props, '$.k') AS id
  FROM events WHERE event_type IN ('purchase', 'signup', 'click'))"""

_PROFILE = f"""{TAGS}, {_LIBRARY},
owned AS (SELECT user_id, id, CASE list WHEN 'favorites' THEN 3.0::DOUBLE WHEN 'backlog' THEN 2.0 ELSE 0.35 END AS weight
  FROM library WHERE id IN (SELECT id FROM prepared)),
words AS (SELECT id, w FROM (SELECT id, unnest(string_split({fold('title')}, ' ')) AS w FROM prepared)
  WHERE length(w) > 2 AND w NOT IN ('the', 'edition', 'and') AND NOT regexp_matches(w, '^[0-9]+$')),
tag_profile AS (SELECT user_id, key, sum(weight) AS interest FROM owned JOIN tags USING (id) GROUP BY 1, 2),
word_profile AS (SELECT user_id, w AS key, sum(weight) AS interest FROM owned JOIN words USING (id) GROUP BY 1, 2),
rarity AS (SELECT key, ln(((SELECT count(*) FROM prepared) + 1) / (count(*) + 1)) + 1 AS rarity FROM tags GROUP BY key)"""


@query(f"WITH {_LIBRARY} SELECT user_id, list, count(*) AS items FROM library GROUP BY 1, 2")
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.library_sizes(tables.library(spark, sf_dir))


@query(f"""
WITH {_PROFILE}
SELECT user_id, 'tag' AS kind, key, round(interest, 6) AS interest FROM tag_profile
UNION ALL SELECT user_id, 'word', key, round(interest, 6) FROM word_profile""")
def interest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = recommend.item_features(prepared(spark, sf_dir), NOW)
    tags, words = recommend.interest_profile(tables.library(spark, sf_dir), items)
    both = tags.withColumn("kind", F.lit("tag")).unionByName(words.withColumn("kind", F.lit("word")))
    return both.select("user_id", "kind", "key", F.round("interest", 6).alias("interest"))


@query(f"WITH {_PROFILE} SELECT key, round(rarity, 9) AS rarity FROM rarity")
def tag_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = recommend.item_features(prepared(spark, sf_dir), NOW)
    return recommend.tag_rarity(items).select("key", F.round("rarity", 9).alias("rarity"))


@query(f"""
WITH {_PROFILE},
users AS (SELECT DISTINCT user_id FROM owned),
tag_part AS (SELECT user_id, t.id, sum(interest * rarity) AS s, count(*) AS shared
  FROM tag_profile p JOIN tags t USING (key) JOIN rarity USING (key) GROUP BY 1, 2),
word_part AS (SELECT user_id, w.id, sum(interest) * 1.35 AS s FROM word_profile p JOIN words w ON w.w = p.key GROUP BY 1, 2),
scored AS (
  SELECT u.user_id, c.id, {_POSTED} AS posted, COALESCE(tp.shared, 0) AS shared,
         round(COALESCE(tp.s, 0) + COALESCE(wp.s, 0)
           + (greatest(0, 1 - greatest(0, epoch({_NOW}) - epoch({_POSTED})) / 86400.0 / 730.0) * 0.45
              + CASE WHEN details_ready THEN 0.12 ELSE 0 END + CASE WHEN media_count > 0 THEN 0.08 ELSE 0 END), 9) AS score
  FROM users u CROSS JOIN prepared c
  LEFT JOIN tag_part tp ON tp.user_id = u.user_id AND tp.id = c.id
  LEFT JOIN word_part wp ON wp.user_id = u.user_id AND wp.id = c.id
  WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.user_id = u.user_id AND l.id = c.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, shared DESC, posted DESC, id) AS rank
  FROM scored WHERE score > 0)
SELECT user_id, rank::INTEGER AS rank, id, round(score, 6) AS score, shared::BIGINT AS shared FROM ranked WHERE rank <= 12""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top twelve unseen items for every user."""
    picks = recommend.recommendations(prepared(spark, sf_dir), tables.library(spark, sf_dir), NOW)
    return picks.withColumn("score", F.round("score", 6)).withColumn("shared", F.col("shared").cast("long"))


@query("""
SELECT p_partkey, lower(p_type) || ' Wargame' AS plain,
       upper(left(lower(p_type), 1)) || substr(lower(p_type), 2) || '-Play Wargame' AS label,
       CASE p_size % 3 WHEN 0 THEN 'RPG' WHEN 1 THEN 'Turn-Based Strategy' ELSE 'Q' || p_size END AS alias,
       CASE p_size % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' ELSE p_brand END AS platform
FROM part""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre and platform labels after cleaning and aliases."""
    kind, size = F.lower("p_type"), F.col("p_size")
    genre = F.when(size % 3 == 0, "Role-Playing  Video Game").when(size % 3 == 1, "turn-based strategy game").otherwise(
        F.concat(F.lit("q"), size.cast("string"), F.lit(" game computer game"))
    )
    platform = F.when(size % 3 == 0, " Microsoft  Windows").when(size % 3 == 1, "Mac OS").otherwise(F.col("p_brand"))
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey",
        display_genre(F.concat(kind, F.lit("  Wargame video game"))).alias("plain"),
        genre_label(F.concat(kind, F.lit("-play wargame game"))).alias("label"),
        genre_label(genre).alias("alias"),
        platform_label(platform).alias("platform"),
    )
