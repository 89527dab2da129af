"""Files and state tables: written into the shared folder, read back and compared."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.decisions import decision_request, json_object
from ...functions.text import platform_list, split_tags
from ...functions.urls import absolute, source_label
from ...operators import browse, classify, jobs, light, localize, quality, search
from ...operators.merge import quarantine_order, refresh_mode_of
from ...operators.ordinals import with_ordinals
from ...session import checkpoint_dir
from ...sources import catalog as files
from ...sources import deltas, images, snapshots
from .. import hooks, tables
from .browse import NOW, prepared
from .registry import CATALOG, PREPARED, query

DAY = datetime(2024, 1, 1)


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- files ---------------------------------------------------------------------------


@query(f"WITH {CATALOG} SELECT id, title, source_url, post_date, p_brand || '|' || p_type AS tags, size_text FROM catalog")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of JSON envelopes, one file per brand, with a renamed field."""
    rows = tables.catalog(spark, sf_dir).withColumnRenamed("size_text", "repack_size")
    record = F.struct("id", "title", "source_url", "post_date", "genres", "repack_size")
    packed = rows.groupBy(F.col("genres")[0]).agg(F.collect_list(record).alias("games"))
    path = folder(spark, "envelopes")
    packed.select(F.to_json(F.struct(F.lit(2).alias("version"), "games")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_catalog(spark, path, rename={"size_text": "repack_size"})
    return read.select("id", "title", "source_url", "post_date", F.array_join("genres", "|").alias("tags"), "size_text")


@query("SELECT p_size % 3 AS version, count(DISTINCT p_brand) AS files FROM part GROUP BY 1")
def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope fields of many files, without their records."""
    brands = tables.table(spark, sf_dir, "part").select(F.pmod("p_size", F.lit(3)).alias("version"), "p_brand").distinct()
    path = folder(spark, "headers")
    brands.select(F.to_json(F.struct("version", F.array("p_brand").alias("games"))).alias("value")).repartition(200).write.option(
        "maxRecordsPerFile", 1).text(path)
    return files.read_envelope(spark, path, "version int").groupBy("version").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {CATALOG} SELECT id, canonical_title, release_date, developer FROM verified")
def snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a versioned snapshot whose count is checked."""
    entry = F.struct("canonical_title", "release_date", "developer")
    pairs = tables.verified(spark, sf_dir).agg(F.collect_list(F.struct("id", entry)).alias("pairs"))
    body = F.struct(F.lit(1).alias("schema"), F.size("pairs").alias("count"), F.lit("now").alias("generated_at"), F.map_from_entries("pairs").alias("games"))
    path = folder(spark, "snapshot")
    pairs.select(F.to_json(body).alias("value")).write.text(path)
    kind = "canonical_title:string,release_date:string,developer:string"
    return files.read_snapshot(spark, path, 1, "schema", kind).select("id", "canonical_title", "release_date", "developer")


_POST = "regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://'), '[?#].*$', ''), '/*$', '') || '/'"


@query(f"SELECT DISTINCT {_POST} AS url FROM pages")
def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post urls out of feeds of both kinds, eight files each."""
    link = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    odd = F.pmod("page_id", F.lit(2)) == 1
    item = F.when(odd, F.concat(F.lit("<item><link>"), link, F.lit("</link></item>"))).otherwise(
        F.concat(F.lit('<entry><link href="'), link, F.lit('"/></entry>')))
    rows = tables.table(spark, sf_dir, "pages").groupBy(F.pmod("page_id", F.lit(16)).alias("file")).agg(
        F.concat(F.lit("<feed>"), F.array_join(F.collect_list(item), "\n"), F.lit("</feed>")).alias("value"))
    path = folder(spark, "feeds")
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_feed(spark, path).select("url")


_LISTS = "CASE event_type WHEN 'purchase' THEN 'favorites' WHEN 'signup' THEN 'backlog' WHEN 'click' THEN 'completed' END"


@query(f"""SELECT DISTINCT user_id::VARCHAR AS user_id, {_LISTS} AS list, json_extract_string(props, '$.k') AS id
FROM events WHERE {_LISTS} IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""")
def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries exported to one file per user and read again."""
    path = folder(spark, "libraries")
    exported = files.library_export(tables.library(spark, sf_dir), "2024-01-01")
    exported.repartition("user_id").write.partitionBy("user_id").option("maxRecordsPerFile", 1).text(path)
    return files.read_library(spark, path)


@query(f"""
WITH {CATALOG}
SELECT id, CASE p_type WHEN 'SMALL' THEN 'kind-small' WHEN 'PROMO' THEN 'kind-promo' END AS hard,
       p_type IN ('SMALL', 'PROMO') AS rejected FROM catalog""")
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records classified by rules that are read from a CSV file."""
    kinds = tables.table(spark, sf_dir, "part").select(F.lower("p_type").alias("kind")).distinct()
    path = folder(spark, "rules")
    rules = kinds.filter(F.col("kind").isin("small", "promo")).select(
        F.lit("hard").alias("tier"), F.lit(1).alias("priority"), F.concat(F.lit("^"), "kind", F.lit(r'\b,? ?"?')).alias("pattern"),
        F.concat(F.lit("kind-"), "kind").alias("reason"))
    rules.write.csv(path, header=True, escape='"', quote='"')
    rows = tables.catalog(spark, sf_dir).withColumn("title", F.concat_ws(" ", F.col("genres")[1], "title"))
    found = classify.classify(rows, classify.collect_rules(files.read_rules(spark, path)))
    hard = F.col("reason").startswith("kind-")
    return found.select("id", F.when(hard, F.col("reason")).alias("hard"), (F.col("kind") == "non_game").alias("rejected"))


@query(f"WITH {CATALOG} SELECT id, left(sha256(id), 24) AS name, left(sha256(id), 2) AS shard, title FROM catalog")
def detail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records as JSON under the hash of their id."""
    path = folder(spark, "details")
    snapshots.write_details(tables.catalog(spark, sf_dir), path)
    read = spark.read.schema("name string, value string, shard string").json(path)
    value = F.from_json("value", "id string, title string")
    return read.select(value["id"].alias("id"), "name", "shard", value["title"].alias("title"))


@query("""
SELECT word AS key, p_partkey // 1000 AS block, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ordinals
FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part) GROUP BY 1, 2""")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists in blocks of a thousand ordinals."""
    words = F.explode(F.array_distinct(F.split("p_name", " ")))
    index = tables.table(spark, sf_dir, "part").select(F.lit("p").alias("kind"), words.alias("key"), F.col("p_partkey").alias("ordinal"))
    blocks = search.posting_blocks(index, block=1000)
    return blocks.select("key", "block", F.array_join("ordinals", ",").alias("ordinals"))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS count, 3 AS version FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON lines and an envelope with their count, read back."""
    path = folder(spark, "lines")
    snapshots.write_json_lines(tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, {"version": 3})
    rows = spark.read.schema("n_nationkey int, n_name string").json(f"{path}/rows")
    return rows.crossJoin(spark.read.schema("version int, count long").json(f"{path}/envelope"))


# --- state tables ----------------------------------------------------------------------


@query("""
SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 3 = 0 THEN 'done' ELSE 'pending' END AS status, 2 AS generation, false AS rewritten
FROM part UNION ALL SELECT 'new-' || r_regionkey, 'pending', 2, false FROM region""")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state table of two generations; a third write of the same rows makes none."""
    root = folder(spark, "state")
    parts = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size")
    snapshots.publish(parts.select("id", F.lit("pending").alias("status")), root, DAY)
    fresh = parts.filter("p_size % 3 = 0").select("id", F.lit("done").alias("status")).unionByName(
        tables.table(spark, sf_dir, "region").select(F.concat(F.lit("new-"), "r_regionkey").alias("id"), F.lit("pending").alias("status")))
    schema = "id string, status string"
    snapshots.publish(jobs.upsert(snapshots.read_current(spark, root, schema), fresh, ["id"]), root, DAY)
    again = snapshots.publish(snapshots.read_current(spark, root, schema), root, DAY)
    rows = snapshots.read_current(spark, root, schema)
    return rows.select("id", "status", F.lit(snapshots.current(spark, root)[0]).alias("generation"), F.lit(again).alias("rewritten"))


_CHANGES = 10


@query(f"""
WITH last AS (
  SELECT l_orderkey, min(l_linenumber + l_suppkey % {_CHANGES - 1}) AS change FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS id,
       CASE WHEN change IS NULL OR change >= {_CHANGES} THEN o_orderstatus ELSE o_orderstatus || '-' || change END AS status,
       true AS rewritten_once, 0 AS again
FROM orders LEFT JOIN last ON l_orderkey = o_orderkey
WHERE NOT (o_orderpriority = '2-HIGH' AND change IS NOT DISTINCT FROM 3)""")
def state_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under ten deltas, one of which takes some away, compacted when due.

    ``rewritten_once``: the deltas led to one new base at least, and few segments are left. ``again``:
    rows committed by writing the table over itself.
    """
    root, schema = folder(spark, "delta-state"), "id string, status string, o_orderpriority string"
    orders = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    deltas.replace(orders, root, ["id"], DAY, ["status"])
    last = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.min(F.col("l_linenumber") + F.col("l_suppkey") % (_CHANGES - 1)).alias("change"))
    lines = orders.join(last, "id")
    bases = 0
    for n in range(_CHANGES):
        mine = lines.filter(F.col("change") == n).select("id", F.concat("status", F.lit(f"-{n}")).alias("status"), "o_orderpriority")
        high = F.col("o_orderpriority") == "2-HIGH"
        deltas.append(mine, root, ["id"], DAY, ["status"], high if n == 3 else None)
        bases += deltas.compact(spark, root, schema, DAY) == "base"
    again = deltas.upsert(deltas.read(spark, root, schema), root, ["id"], DAY)
    once = bases > 0 and len(deltas.state(spark, root).live) <= _CHANGES // 2
    return deltas.read(spark, root, schema).select("id", "status", F.lit(once).alias("rewritten_once"), F.lit(int(again)).alias("again"))


@query("""
SELECT o_custkey::VARCHAR AS id, min(o_orderpriority) AS title, 'created' AS outcome FROM orders GROUP BY o_custkey""")
def queue_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for every id, also where the catalog repeats it."""
    rows = tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.sha2("o_orderpriority", 256).alias("fingerprint"))
    from ...schemas import JOBS

    synced = jobs.sync_jobs(rows, spark.createDataFrame([], JOBS), DAY)
    return synced.select("id", "title", "outcome")


#: What breaks each rule of the constraint suite: a field and its value in SQL.
_BREAKS = {
    "missing-id": ("id", "''"), "missing-title": ("title", "' '"), "missing-source-url": ("source_url", "''"),
    "source-url-not-https": ("source_url", "'http://a.example/'"), "image-url-not-https": ("image_url", "'ftp://a.example/'"),
    "forbidden-text": ("title", "'MAGNET:?x'"), "post-date-unparseable": ("post_date", "'soon'"),
    "media-checked-unparseable": ("media_checked_at", "'soon'"), "details-checked-unparseable": ("details_checked_at", "'soon'"),
    "blank-genre": ("genres", "array('a', ' ')"), "label-in-genre": ("genres", "array('Company: x')"),
    "media-version-unknown": ("media_version", "99"),
    "too-many-media": ("media", "transform(sequence(1, 9), i -> named_struct('type', 'image', 'url', concat('https://m.example/', i), 'preview_url', CAST(NULL AS STRING)))"),
    "media-type-unknown": ("media", "array(named_struct('type', 'video', 'url', 'https://m.example/1', 'preview_url', CAST(NULL AS STRING)))"),
    "media-url-not-https": ("media", "array(named_struct('type', 'image', 'url', 'http://m.example/1', 'preview_url', CAST(NULL AS STRING)))"),
    "preview-url-not-https": ("media", "array(named_struct('type', 'image', 'url', 'https://m.example/1', 'preview_url', 'http://m.example/2'))"),
    "repeated-media-url": ("media", "array_repeat(named_struct('type', 'image', 'url', 'https://m.example/1', 'preview_url', CAST(NULL AS STRING)), 2)"),
    "animation-not-first": ("media", "array(named_struct('type', 'image', 'url', 'https://m.example/1', 'preview_url', CAST(NULL AS STRING)), named_struct('type', 'gif', 'url', 'https://m.example/2', 'preview_url', CAST(NULL AS STRING)))"),
    "too-many-animations": ("media", "array(named_struct('type', 'gif', 'url', 'https://m.example/1', 'preview_url', CAST(NULL AS STRING)), named_struct('type', 'gif', 'url', 'https://m.example/2', 'preview_url', CAST(NULL AS STRING)))"),
    "details-version-unknown": ("details_version", "7"), "details-missing": ("details", "CAST(NULL AS STRUCT<description: STRING, features: ARRAY<STRING>, package_features: ARRAY<STRING>>)"),
    "blank-feature": ("details", "named_struct('description', 'd', 'features', array(' '), 'package_features', array('p'))"),
    "blank-package-feature": ("details", "named_struct('description', 'd', 'features', array('f'), 'package_features', array(''))"),
    "source-host-not-allowed": ("source_url", "'https://other.test/'"),
}
_RULES = ", ".join(f"({i}, '{rule}')" for i, rule in enumerate(_BREAKS))


@query(f"""
WITH r(k, rule) AS (VALUES {_RULES}),
broken AS (SELECT CASE WHEN rule = 'missing-id' THEN '' ELSE p_partkey::VARCHAR END AS id, rule FROM part JOIN r ON k = p_partkey % {len(_BREAKS) + 1})
SELECT * FROM broken
UNION ALL SELECT id, 'animation-not-first' FROM broken WHERE rule = 'too-many-animations'
UNION ALL SELECT id, 'preview-needs-current-version' FROM (SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % {len(_BREAKS) + 1} = {len(_BREAKS)})
UNION ALL SELECT id, 'repeated-id' FROM broken GROUP BY id, rule HAVING count(*) > 1""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the constraint suite broken in turn."""
    k = F.pmod("p_partkey", F.lit(len(_BREAKS) + 1))
    good = {
        "id": F.col("p_partkey").cast("string"), "title": F.col("p_name"), "source_url": F.lit("https://a.example/x/"),
        "image_url": F.lit("https://a.example/i"), "post_date": F.lit("2024-01-02"), "genres": F.array("p_type"), "size_text": F.lit("1 GB"),
        "details": F.expr("named_struct('description', 'd', 'features', array('f'), 'package_features', array('p'))"),
        "details_version": F.lit(1), "details_checked_at": F.lit("2024-01-02"),
        "media": F.expr("array(named_struct('type', 'image', 'url', 'https://m.example/1', 'preview_url', 'https://m.example/2'))"),
        "media_version": F.lit(7), "media_checked_at": F.lit("2024-01-02"),
    }
    columns = []
    for field, value in good.items():
        for number, (broken, text) in enumerate(_BREAKS.values()):
            if broken == field:
                value = F.when(k == number, F.expr(text)).otherwise(value)
        if field == "media_version":  # an older version may have no previews
            value = F.when(k == len(_BREAKS), 6).otherwise(value)
        if field == "media":  # an unknown version with previews would break two rules
            plain = F.transform(value, lambda m: m.withField("preview_url", F.lit(None).cast("string")))
            value = F.when(k == list(_BREAKS).index("media-version-unknown"), plain).otherwise(value)
        columns.append(value.alias(field))
    rows = tables.table(spark, sf_dir, "part").select(*columns)
    return quality.catalog_violations(rows, host_suffixes=[".example"])


# --- columns ---------------------------------------------------------------------------


@query("""
SELECT p_partkey, 'https://h.example/' || array_to_string(list_slice(['a', 'b', 'c', 'd', 'e', 'f'], 1, greatest(0, 6 - p_size % 9)), '/')
       || CASE WHEN p_size % 9 < 6 THEN '/' ELSE '' END || p_name || '.png?q=../x' AS url,
       'https://h.example/a/' AS up FROM part""")
def deep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative links that go up no level to eight."""
    base = F.lit("https://h.example/a/b/c/d/e/f/i.html")
    ups = F.repeat(F.lit("../"), F.pmod("p_size", F.lit(9)).cast("int"))
    link = F.concat(ups, F.lit("./"), "p_name", F.lit(".png?q=../x"))
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", absolute(base, link).alias("url"), absolute(F.lit("https://h.example/a/b/c/i.html"), F.lit("../..")).alias("up"))


@query("""
SELECT r_name, CASE WHEN i = 0 THEN 'description' ELSE 'game_feature:' || printf('%04d', i - 1) END AS field_key
FROM region, (SELECT unnest(range(1, 10051)) AS i)""")
def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records with more than ten thousand features."""
    text = F.transform(F.sequence(F.lit(1), F.lit(10050)), lambda i: F.concat(F.lit("you can play with the number "), i.cast("string")))
    details = F.struct(F.lit("").alias("description"), text.alias("features"))
    rows = tables.table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), details.alias("details"))
    return localize.source_fields(rows).select(F.col("id").alias("r_name"), "field_key")


@query("""
SELECT p_brand, 105::INTEGER AS marks, 0::INTEGER AS missing, 0::INTEGER AS leftovers,
       string_agg('Zxq' || printf('%03d', i) || p_brand, ' ' ORDER BY i) AS text,
       string_agg('ZXQ' || printf('%02d', i) || 'QXZ', ' ' ORDER BY i) AS masked
FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(1, 106)) AS i) GROUP BY p_brand""")
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than a hundred protected terms in one sentence, masked and put back."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(105)), lambda i: F.concat(F.lit("Zxq"), F.format_string("%03d", i), F.col("p_brand")))
    rows = tables.table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("terms", terms)
    held = rows.withColumn("p", localize.protect(F.array_join("terms", " "), F.col("terms")))
    back = held.withColumn("r", localize.restore(F.col("p.text"), F.col("p.marks")))
    return back.select(
        "p_brand", F.size("p.marks").alias("marks"), F.size("r.missing").alias("missing"), F.size("r.leftovers").alias("leftovers"),
        F.col("r.text").alias("text"), F.col("p.text").alias("masked"))


@query("""
SELECT event_id, event_type IN ('view', 'click', 'purchase') AS found,
       CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'Q' || json_extract_string(props, '$.k') END AS id FROM events""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects alone, fenced or inside prose; objects inside lists and strings are none."""
    one = F.concat(F.lit('{"id":"Q'), F.get_json_object("props", "$.k"), F.lit('"}'))
    kind = F.col("event_type")
    text = F.when(kind == "view", one).when(kind == "click", F.concat(F.lit("I say "), one, F.lit(" surely"))).when(
        kind == "purchase", F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(
        kind == "signup", F.concat(F.lit("["), one, F.lit("]"))).otherwise("no object")
    rows = tables.table(spark, sf_dir, "events").select("event_id", json_object(text).alias("o"))
    return rows.select("event_id", F.col("o").isNotNull().alias("found"), F.element_at("o", F.lit("id")).alias("id"))


@query(f"WITH {PREPARED} SELECT id, title FROM prepared WHERE release_year = '1995'")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog items released in one year."""
    rows = prepared(spark, sf_dir).withColumn("release_year", F.left("game_release_date", F.lit(4)))
    return browse.filtered(rows, NOW, year=1995).select("id", "title")


@query(f"""
WITH {CATALOG}
SELECT c.id, v.id IS NOT NULL OR c.description <> '' OR media_count > 0 OR p_type <> '' AS shown, media_count AS sane,
       CASE WHEN media_count > 0 AND p_brand <> 'Brand#11' THEN 1 ELSE 0 END AS displayed
FROM catalog c LEFT JOIN verified v ON v.id = c.id""")
def shown_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detail view can show, with one brand's images taken for banners."""
    known = tables.verified(spark, sf_dir).select("id", F.struct("canonical_title").alias("verified_metadata"))
    rows = tables.catalog(spark, sf_dir).join(known, "id", "left")
    marked = F.transform("media", lambda m: m.withField("url", F.when(
        F.col("genres")[0] == "Brand#11", F.concat(m["url"], F.lit("/banner.png"))).otherwise(m["url"])))
    return rows.select(
        "id", light.renderable().alias("shown"), F.size(light.sane_media(F.col("media"))).alias("sane"),
        F.coalesce(F.size(quality.displayable_media(marked)), F.lit(0)).alias("displayed"))


@query("""
SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY p_type, p_name, p_partkey::VARCHAR) - 1 AS place FROM part""")
def quarantine_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the quarantine: classification, title, id."""
    rows = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("classification"))
    return with_ordinals(rows, quarantine_order(), "place").select("id", "place")


@query("""
SELECT p_partkey, p_type || '|' || p_brand AS tags,
       CASE WHEN p_size % 2 = 0 THEN 'Windows|macOS' ELSE p_type END AS platforms, 1 + (p_size + 1) % 2 AS capped FROM part""")
def tag_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of comma lists, and platform labels without repeats and capped."""
    even = F.pmod("p_size", F.lit(2)) == 0
    names = F.when(even, F.array(F.lit("microsoft windows"), F.lit("Windows"), F.lit("mac os"), F.lit("MAC"))).otherwise(F.array("p_type", "p_type"))
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(split_tags(F.concat(F.lit(" ,"), "p_type", F.lit(" , "), "p_brand", F.lit(",,"))), "|").alias("tags"),
        F.array_join(platform_list(names), "|").alias("platforms"), F.size(platform_list(names, 2)).alias("capped"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Wiki' WHEN 1 THEN 'Store' ELSE 'x' || s_suppkey || '.example.net' END AS label FROM supplier""")
def host_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable names of evidence hosts: exact, by suffix, or the host."""
    kind = F.pmod("s_suppkey", F.lit(3))
    host = F.when(kind == 0, "en.wiki.example.org").when(kind == 1, "store.example.com").otherwise(F.concat(F.lit("x"), "s_suppkey", F.lit(".example.net")))
    url = F.concat(F.lit("https://"), host, F.lit("/item/"), "s_suppkey")
    label = source_label(url, {"store.example.com": "Store"}, {"wiki.example.org": "Wiki"})
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"))


@query("""
SELECT p_partkey, '{"source_entry":{"title":"' || p_name || '","genres":["' || p_type || '"]},"candidates":[{"id":"Q' || p_partkey
  || '","label":"' || p_name || '","description":"","release_dates":["2020-01-01"],"genres":["' || p_type
  || '"],"developers":["' || p_brand || '"],"publishers":[],"platforms":[],"url":"https://x.example/' || p_partkey || '"}]}' AS request FROM part""")
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact JSON of decision requests, without the part that states the answer format."""
    none = F.array().cast("array<string>")
    one = F.struct(
        F.concat(F.lit("Q"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("").alias("description"),
        F.array(F.lit("Q1")).alias("instance_of"), F.array(F.lit("2020-01-01")).alias("release_dates"), F.array("p_type").alias("genres"),
        F.array("p_brand").alias("developers"), none.alias("publishers"), none.alias("platforms"),
        F.concat(F.lit("https://x.example/"), "p_partkey").alias("url"))
    request = decision_request(F.col("p_name"), F.array("p_type"), F.array(one))
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.regexp_extract(request, r'^(.*),"required_schema":', 1), F.lit("}")).alias("request"))


# --- hooks -----------------------------------------------------------------------------


@query("SELECT p_partkey, upper(p_name) AS answer FROM part")
def hook_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a user's function over batches of texts."""
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return hooks.answer(rows, "p_name", "answer", lambda texts: [t.upper() for t in texts]).drop("p_name", "error")


@query("SELECT DISTINCT p_name AS query, word AS label FROM part, (SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey AS k FROM part) WHERE k = p_partkey")
def hook_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a user's provider for every distinct query."""
    from pyspark.sql import types as T

    find = hooks.entity_lookup(
        lambda queries: [[{"label": w} for w in dict.fromkeys(q.split(" "))] for q in queries], T.StructType([T.StructField("label", T.StringType())]))
    titles = tables.table(spark, sf_dir, "part").select(F.col("p_name").alias("query"))
    return find(titles).select("query", "candidate.label")


@query("""
SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 97 <> 5""")
def tolerant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of side tables in many files, some of them cut off, some of another shape, and one that is missing."""
    path = folder(spark, "side-tables")
    part = F.pmod("p_partkey", F.lit(97))
    entry = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    grouped = tables.table(spark, sf_dir, "part").groupBy(part.alias("part"), F.floor(F.col("p_partkey") / 5000)).agg(F.collect_list(entry).alias("entries"))
    whole = F.to_json(F.struct("entries"))
    text = F.when(F.col("part") == 5, F.substring(whole, 1, 30)).otherwise(whole)
    other = spark.range(1).select(F.lit('{"rows": [{"id": "x"}]}').alias("value"))
    grouped.select(text.alias("value")).unionByName(other).write.option("maxRecordsPerFile", 1).text(path)
    rows = files.read_tolerant(spark, path, "id string, name string")
    return rows.unionByName(files.read_tolerant(spark, f"{path}-missing", "id string, name string"))


@query("""
SELECT c_custkey, CASE WHEN orders = 0 THEN 'bootstrap' WHEN c_nationkey % 3 <> 2 THEN 'schema-rebuild'
         WHEN c_custkey % 2 = 0 THEN 'full-scan' ELSE 'incremental' END AS mode,
       orders = 0 OR c_nationkey % 3 <> 2 OR c_custkey % 2 = 0 AS everything,
       CASE WHEN (orders = 0 OR c_nationkey % 3 <> 2 OR c_custkey % 2 = 0) AND late = 0 THEN 'now' ELSE 'before' END AS stamp
FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS orders, count_if(o_orderstatus = 'P') AS late
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)""")
def refresh_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of a refresh per customer, read as a site: its orders are stored rows, open ones pages that failed."""
    orders = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("late"))
    sites = tables.table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("late", F.lit(0)).alias("late"),
        F.pmod("c_nationkey", F.lit(3)).alias("version"), (F.pmod("c_custkey", F.lit(2)) == 0).alias("full"))
    mode, everything = refresh_mode_of(F.col("orders"), F.col("version"), F.lit(2), F.col("full"))
    stamp = F.when(everything & (F.col("late") == 0), "now").otherwise("before")
    return sites.select("c_custkey", mode.alias("mode"), everything.alias("everything"), stamp.alias("stamp"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 < 2 THEN p_size * 7 ELSE 0 END AS INTEGER) AS width,
       CAST(CASE WHEN p_partkey % 4 < 2 THEN p_size + 300 ELSE 0 END AS INTEGER) AS height,
       CAST(CASE WHEN p_partkey % 4 = 3 THEN 8 ELSE 10 + 100 * p_size END AS BIGINT) AS bytes
FROM part""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of an image file per part, by its first bytes: two kinds of animations, another kind, and files cut off."""

    def two(value):
        return F.concat(*[F.unhex(F.lpad(F.hex(F.pmod(F.floor(value / step), F.lit(256)).cast("int")), 2, "0")) for step in (1, 256)])

    kind = F.pmod("p_partkey", F.lit(4))
    mark = F.when(kind == 1, F.unhex(F.lit(images.SIGNATURES[0]))).when(kind == 2, F.unhex(F.lit("89504E470D0A"))).otherwise(F.unhex(F.lit(images.SIGNATURES[1])))
    whole = F.concat(mark, two(F.col("p_size") * 7), two(F.col("p_size") + 300), F.unhex(F.expr("repeat('00', 100 * p_size)")))
    content = F.when(kind == 3, F.substring(whole, 1, 8)).otherwise(whole)
    path = folder(spark, "images")
    part = tables.parts(spark, sf_dir)
    images.write_files(part.select(F.concat(F.pmod("p_partkey", F.lit(16)), F.lit("/"), "p_partkey", F.lit(".gif")).alias("name"), content.alias("content")), path)
    found = images.read_headers(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", r"(\d+)\.gif$", 1).cast("long").alias("p_partkey"), "width", "height", "bytes")
