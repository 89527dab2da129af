"""Light catalog, health, quality, classification, merging and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.hashing import detail_name, fingerprint, text_hash
from ...functions.urls import last_segment, post_url
from ...operators import classify as rules_
from ...operators import dedupe, light, merge, ordinals, quality
from ...operators.classify import Rule
from ...schemas import QUARANTINE
from .. import tables
from .registry import CATALOG, LIGHT, day, query

SNAPSHOT_DAY = "2001-06-01"
RULES = [
    Rule("hard", 1, r"^red\b", "red-goods"),
    Rule("hard", 2, r"^cold (?:rod|bolt)$", "cold-goods"),
    Rule("standalone", 1, r"\bplate\s*$", "plates"),
    Rule("soft", 1, r"\bgear\b", "gears"),
    Rule("soft", 2, r"^(?:old|new)\b", "dated"),
]
EXACT_TITLES = [Rule("exact", 1, "Blue Gizmo", "listed"), Rule("exact", 2, "hot   ring", "listed")]

_HARD = "CASE WHEN lower(title) IN ('blue gizmo', 'hot ring') THEN 'listed' WHEN regexp_matches(title, '^red\\b') THEN 'red-goods' WHEN regexp_matches(title, '^cold (rod|bolt)$') THEN 'cold-goods' WHEN regexp_matches(title, '\\bplate\\s*$') THEN 'plates' END"
_SOFT = "CASE WHEN regexp_matches(title, '\\bgear\\b') THEN 'gears' WHEN regexp_matches(title, '^(old|new)\\b') THEN 'dated' END"


def _classified_sql(source: str, name: str, genres: str, size: str, image: str, described: str, media: str) -> str:
    """SQL of signals and classification over a relation."""
    return f"""
{name}_s AS (
  SELECT *, CASE WHEN {genres} THEN 3 ELSE 0 END + CASE WHEN {size} THEN 3 ELSE 0 END
         + CASE WHEN {image} THEN 1 ELSE 0 END + CASE WHEN {described} THEN 2 ELSE 0 END
         + CASE WHEN {media} THEN 1 ELSE 0 END AS score,
         concat_ws(',', CASE WHEN {genres} THEN 'genres' END, CASE WHEN {size} THEN 'size' END,
           CASE WHEN {image} THEN 'image' END, CASE WHEN {described} THEN 'description' END,
           CASE WHEN {media} THEN 'media' END) AS signals,
         {_HARD} AS hard, {_SOFT} AS soft
  FROM {source}),
{name} AS (
  SELECT *, CASE WHEN hard IS NOT NULL OR (soft IS NOT NULL AND score < 3) THEN 'non_game'
                 WHEN score >= 3 THEN 'game' ELSE 'review' END AS kind,
         CASE WHEN hard IS NOT NULL THEN hard WHEN soft IS NOT NULL AND score < 3 THEN soft
              WHEN score >= 3 THEN 'game-signals' ELSE 'insufficient-game-signals' END AS reason
  FROM {name}_s)"""


# Stored records keep their tags and size only for parts that are not small; the others
# show weak signals, so that every class occurs.
_THIN = "p_type = 'SMALL'"
_STORED_SIGNALS = (f"NOT ({_THIN})", f"NOT ({_THIN})", "image_url IS NOT NULL", "description <> ''", "media_count > 0")


def thin_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog in which small parts have lost their tags and size."""
    records = tables.catalog(spark, sf_dir)
    thin = F.array_contains("genres", "SMALL")
    return records.withColumn("size_text", F.when(thin, "N/A").otherwise(F.col("size_text"))).withColumn(
        "genres", F.when(thin, F.array().cast("array<string>")).otherwise(F.col("genres"))
    )


def exact(spark: SparkSession) -> DataFrame:
    return rules_.exact_titles(rules_.rule_table(spark, EXACT_TITLES))


@query(f"""
WITH {LIGHT}
SELECT id, title, source_url, image_url, post_date, p_brand || '|' || p_type AS genres, size_text,
       'data/details/' || left(sha256(id), 24) || '.json' AS detail_path,
       CASE WHEN post_date LIKE '20%' THEN CAST(left(post_date, 4) AS INTEGER) END AS year,
       CAST(p_size * 1024 AS DOUBLE) AS size_mb, details_ready, description <> '' AS has_description,
       media_count, has_gif, metadata_ready, canonical_title, release_date AS game_release_date,
       developer AS metadata_developer, publisher AS metadata_publisher, post_date AS detail_updated_at,
       enrichment_pending
FROM light""")
def light_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = light.light_catalog(tables.catalog(spark, sf_dir), tables.verified(spark, sf_dir))
    drop = ["metadata_genres", "metadata_platforms", "metadata_evidence_urls"]
    return rows.drop(*drop).withColumn("genres", F.array_join("genres", "|"))


_SHARE = "round(CAST({} AS BIGINT) * 100.0 / greatest(count(*), 1), 1)"


@query(f"""
WITH {LIGHT}
SELECT count(*) AS total_games, count_if(details_ready)::BIGINT AS details_ready,
       count_if(description <> '')::BIGINT AS with_description, count_if(media_count > 0)::BIGINT AS with_gallery,
       count_if(has_gif)::BIGINT AS with_gif, sum(media_count)::BIGINT AS media_items,
       count_if(enrichment_pending)::BIGINT AS enrichment_pending, count_if(metadata_ready)::BIGINT AS metadata_verified,
       (SELECT count(*) FROM verified) AS metadata_snapshot_count,
       (SELECT count(*) FROM verified WHERE id NOT IN (SELECT id FROM light)) AS metadata_unmatched,
       {_SHARE.format('count_if(details_ready)')} AS coverage_details,
       {_SHARE.format("count_if(description <> '')")} AS coverage_descriptions,
       {_SHARE.format('count_if(media_count > 0)')} AS coverage_galleries,
       {_SHARE.format('count_if(has_gif)')} AS coverage_gifs,
       {_SHARE.format('count_if(metadata_ready)')} AS coverage_metadata,
       1 AS expected_details, 7 AS expected_media, 1 AS expected_metadata
FROM light""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = tables.verified(spark, sf_dir)
    return light.health_report(light.light_catalog(tables.catalog(spark, sf_dir), verified), verified)


@query(f"""
WITH {CATALOG}
SELECT id, canonical_title FROM verified WHERE id NOT IN (SELECT id FROM catalog WHERE details_ready)""")
def unmatched_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified metadata that no record with current details uses."""
    current = tables.catalog(spark, sf_dir).filter(light.details_ready())
    return light.unmatched_verified(current, tables.verified(spark, sf_dir)).select("id", "canonical_title")


@query(f"""
WITH {CATALOG}
SELECT id, post_date FROM catalog WHERE NOT (details_ready AND media_ready)
ORDER BY COALESCE(post_date, '') DESC, id LIMIT 360""")
def enrichment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...operators.browse import enrichment_batch as batch

    stale = tables.catalog(spark, sf_dir).filter(light.stale())
    return batch(stale, 360).select("id", "post_date")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as catalog records: id and source from the url, heading as title."""
    pages = tables.pages(spark, sf_dir)
    columns = tables.catalog(spark, sf_dir)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in columns.schema}
    known = {
        "id": last_segment("url"),
        "title": F.regexp_extract("html", "<h1>([^<]*)</h1>", 1),
        "source_url": F.col("url"),
        "genres": F.array(F.regexp_extract("html", '<html lang="([a-z]*)"', 1), F.lit(" ")),
        "post_date": F.regexp_extract("url", r"[?]([a-z_]+)=", 1),
    }
    return pages.select(*[known.get(n, none[n]).alias(n) for n in none])


@query(r"""
WITH p AS (
  SELECT regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS id,
         url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(url, '[?]([a-z_]+)=', 1) AS d
  FROM pages)
SELECT id, 'source-url-not-https' AS rule FROM p WHERE NOT starts_with(url, 'https://')
UNION ALL SELECT id, 'missing-title' FROM p WHERE trim(title) = ''
UNION ALL SELECT id, 'missing-id' FROM p WHERE id = ''
UNION ALL SELECT id, 'blank-genre' FROM p
UNION ALL SELECT id, 'post-date-unparseable' FROM p WHERE d <> ''
UNION ALL SELECT id, 'source-host-not-allowed' FROM p
  WHERE starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://[^/]*\.example\.(com|org)/')
UNION ALL SELECT id, 'repeated-id' FROM p GROUP BY id HAVING count(*) > 1""")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_records(spark, sf_dir)
    return quality.catalog_violations(records, host_suffixes=[".example.com", ".example.org"])


@query("SELECT sha256(text) AS text_hash, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = tables.documents(spark, sf_dir).select(text_hash("text").alias("text_hash"))
    return dedupe.repeated_keys(hashed, ["text_hash"])


@query("""
SELECT doc_id, source, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every distinct text."""
    rows = tables.documents(spark, sf_dir).select("doc_id", "source", "lang", text_hash("text").alias("_h"))
    return dedupe.first_per_key(rows, ["_h"], [F.col("doc_id")]).drop("_h")


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events")
    last = dedupe.first_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH {CATALOG}, {_classified_sql('catalog', 'c', *_STORED_SIGNALS)}
SELECT id, kind, reason, score, signals FROM c""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules_.classify(thin_catalog(spark, sf_dir), RULES, exact(spark))
    return rows.select("id", "kind", "reason", "score", F.array_join("signals", ",").alias("signals"))


@query(f"""
WITH {CATALOG}, {_classified_sql('catalog', 'c', *_STORED_SIGNALS)}
SELECT count(*) AS records, count_if(kind = 'non_game')::BIGINT AS rejects, count_if(kind = 'review')::BIGINT AS reviews,
       count_if(kind = 'non_game') = 0 AS ok FROM c""")
def classification_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_.classification_guard(rules_.classify(thin_catalog(spark, sf_dir), RULES, exact(spark)))


# --- refresh: parts shipped before a day are stored, parts shipped since are scanned ---

_SCAN = f"""
stored AS (SELECT * FROM catalog WHERE id IN (
  SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_shipdate < DATE '1996-01-01')),
scanned AS (
  SELECT CAST(l_partkey AS VARCHAR) AS id, any_value(p_name) AS title, any_value(p_type) AS p_type,
         'https://parts.example.com/' || l_partkey || '/' AS source_url, CAST(NULL AS VARCHAR) AS image_url,
         {day('max(l_shipdate)')} AS post_date,
         CASE WHEN any_value(p_type) = 'SMALL' THEN '' ELSE any_value(p_brand) END AS genre,
         CASE WHEN any_value(p_type) = 'SMALL' THEN 'N/A' ELSE any_value(p_size) || ' GB' END AS size_text
  FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_shipdate >= DATE '{SNAPSHOT_DAY}' GROUP BY l_partkey)"""

_REFRESH = f"""
{CATALOG}, {_SCAN},
{_classified_sql('stored', 'o', *_STORED_SIGNALS)},
{_classified_sql('scanned', 'f', "genre <> ''", "size_text <> 'N/A'", 'false', 'false', 'false')}"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing records of the parts shipped since the snapshot day."""
    recent = tables.table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit(SNAPSHOT_DAY)))
    days = recent.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("last"))
    thin = F.col("p_type") == "SMALL"
    key = F.col("p_partkey").cast("string")
    return tables.table(spark, sf_dir, "part").join(days, "p_partkey").select(
        key.alias("id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://parts.example.com/"), key, F.lit("/")).alias("source_url"),
        F.lit(None).cast("string").alias("image_url"),
        tables.day("last").alias("post_date"),
        F.when(thin, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("genres"),
        F.when(thin, "N/A").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" GB"))).alias("size_text"),
    )


def refreshed(spark: SparkSession, sf_dir: str) -> merge.Refresh:
    early = (
        tables.table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1996-01-01")))
        .select(F.col("l_partkey").cast("string").alias("id"))
    )
    stored = thin_catalog(spark, sf_dir).join(early, "id", "left_semi")
    quarantine = tables.verified(spark, sf_dir).select(
        "id", F.col("canonical_title").alias("title"), F.lit("").alias("source_url"),
        F.lit("review").alias("classification"), F.lit("earlier").alias("reason"), F.lit(0).alias("score"),
        F.array().cast("array<string>").alias("signals"), F.lit("excluded-new").alias("action"),
    )
    assert quarantine.columns == [f.split(" ")[0] for f in QUARANTINE.split(", ")]
    return merge.refresh_catalog(stored, scan(spark, sf_dir), quarantine, RULES, exact(spark))


@query(f"""
WITH {_REFRESH},
kept AS (SELECT * FROM o WHERE kind <> 'non_game'), fresh AS (SELECT * FROM f WHERE kind = 'game')
SELECT COALESCE(fresh.id, kept.id) AS id,
       CASE WHEN fresh.id IS NOT NULL THEN fresh.image_url ELSE kept.image_url END AS image_url,
       CASE WHEN fresh.id IS NOT NULL THEN fresh.post_date ELSE kept.post_date END AS post_date,
       CASE WHEN fresh.id IS NOT NULL THEN fresh.size_text WHEN kept.p_type = 'SMALL' THEN 'N/A'
            ELSE kept.size_text END AS size_text,
       CASE WHEN fresh.id IS NOT NULL THEN fresh.genre WHEN kept.p_type = 'SMALL' THEN ''
            ELSE kept.p_brand || '|' || kept.p_type END AS genres,
       kept.description AS description
FROM kept FULL OUTER JOIN fresh ON fresh.id = kept.id""")
def merge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh records over stored ones, field by field, empty values included."""
    rows = refreshed(spark, sf_dir).catalog
    return rows.select(
        "id", "image_url", "post_date", "size_text", F.array_join("genres", "|").alias("genres"),
        F.col("details.description").alias("description"),
    )


@query(f"""
WITH {_REFRESH},
detected AS (
  SELECT id, title, kind, reason, score, 'excluded-new' AS action, 0 AS turn FROM f WHERE kind <> 'game'
  UNION ALL
  SELECT id, title, kind, reason, score,
         CASE WHEN kind = 'non_game' THEN 'removed-existing' ELSE 'review-retained' END, 1 FROM o WHERE kind <> 'game'),
latest AS (SELECT * FROM detected QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1),
accepted AS (SELECT id FROM f WHERE kind = 'game' UNION SELECT id FROM o WHERE kind = 'game')
SELECT id, title, kind AS classification, reason, score, action FROM latest
UNION ALL
SELECT id, canonical_title, 'review', 'earlier', 0, 'excluded-new' FROM verified
WHERE id NOT IN (SELECT id FROM accepted) AND id NOT IN (SELECT id FROM latest)""")
def merge_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refreshed(spark, sf_dir).quarantine
    return rows.select("id", "title", "classification", "reason", "score", "action")


@query(r"""
WITH posts AS (
  SELECT starts_with(url, 'https://') AS known,
         regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://'), '[?#].*$', ''), '/*$', '') || '/' AS url
  FROM pages)
SELECT DISTINCT url FROM posts WHERE NOT known AND url NOT IN (SELECT url FROM posts WHERE known)""")
def new_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insecure page urls, made canonical, that no secure page already has."""
    posts = tables.pages(spark, sf_dir).select(F.col("url").startswith("https://").alias("known"), post_url("url").alias("url"))
    feed = posts.filter(~F.col("known")).select("url").distinct()
    return merge.new_arrivals(feed, posts.filter("known"))


@query(f"""
WITH {CATALOG}
SELECT c.id, c.post_date IS DISTINCT FROM v.checked_at OR c.title IS DISTINCT FROM v.canonical_title AS changed,
       v.canonical_title AS title
FROM catalog c JOIN verified v USING (id)
WHERE c.post_date IS DISTINCT FROM v.checked_at OR c.title IS DISTINCT FROM v.canonical_title""")
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that an update from verified metadata really changes."""
    updates = tables.verified(spark, sf_dir).select(
        "id", F.col("canonical_title").alias("title"), F.col("checked_at").alias("post_date")
    )
    rows = merge.write_back(
        tables.catalog(spark, sf_dir), updates, ["title", "post_date"], F.lit("2001-01-15"), ["details_checked_at"]
    )
    return rows.filter("changed").select("id", "changed", "title")


@query("""
SELECT doc_id, left(sha256(CAST(doc_id AS VARCHAR)), 24) AS detail_name, sha256(text) AS text_hash,
       sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint
FROM documents""")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir)
    return rows.select(
        "doc_id",
        detail_name(F.col("doc_id").cast("string")).alias("detail_name"),
        text_hash("text").alias("text_hash"),
        fingerprint("doc_id", "lang", "source").alias("fingerprint"),
    )


@query(f"""
WITH {CATALOG}
SELECT id, row_number() OVER (ORDER BY COALESCE(post_date, '') DESC, id) - 1 AS ordinal FROM catalog""")
def catalog_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.catalog(spark, sf_dir).select("id", "post_date")
    return ordinals.with_ordinals(rows, merge.catalog_order()).select("id", "ordinal")


@query("""
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)
SELECT ordinal // 50 AS batch, count(*)::INTEGER AS size, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM n GROUP BY 1""")
def key_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinals.key_batches(tables.documents(spark, sf_dir), "doc_id", 50)
    return rows.select("batch", "size", F.array_min("keys").alias("first_id"), F.array_max("keys").alias("last_id"))


@query("""
SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) % 4)::INTEGER AS shard FROM orders""")
def work_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt round-robin over four shards, newest first."""
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ordinals.shards(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 4).select("o_orderkey", "shard")


