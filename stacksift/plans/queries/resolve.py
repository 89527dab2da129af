"""Titles, candidates, decisions and review."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.claims import CLAIM_MAP, VALUE_MAP
from ...functions.decisions import parse_decision, validate_result
from ...functions.fold import let, match_fold
from ...functions.text import json_list, merged_ids
from ...functions.titles import (
    aggressive_title,
    conservative_title,
    display_title,
    edition_title,
    evidence_key,
    lookup_title,
    title_parts,
    title_variants,
)
from ...operators import quality, resolve, review
from ...operators.publish import public_evidence
from ...session import cut_lineage
from .. import hooks, tables
from .registry import CATALOG, query

FETCHED = datetime(2001, 1, 1)


def listed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names dressed up like listing titles."""
    size = F.col("p_size").cast("string")
    dressed = (
        F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" – v1."), size, F.lit(".2 + 3 DLCs")))
        .when(F.col("p_size") % 5 == 1, F.concat("p_name", F.lit(": Deluxe Edition")))
        .when(F.col("p_size") % 5 == 2, F.concat("p_name", F.lit(" Build "), size, F.lit(" (Portable)")))
        .when(F.col("p_size") % 5 == 3, F.concat("p_name", F.lit(" &amp; "), "p_type", F.lit(" [Crack Fix]")))
        .otherwise(F.concat("p_name", F.lit(", update 1."), size))
    )
    return tables.parts(spark, sf_dir).select("p_partkey", "p_name", dressed.alias("title"))


_BY_SIZE = "CASE p_size % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
_TITLED = "p_name || ' & ' || p_type || ' [Crack Fix]'"


_CONSERVATIVE = _BY_SIZE.format('p_name', "p_name || ': Deluxe Edition'", 'p_name', _TITLED, "p_name || ', update 1.' || p_size")
_AGGRESSIVE = _BY_SIZE.format('p_name', 'p_name', 'p_name', "p_name || ' & ' || p_type", 'p_name')


@query(f"""
SELECT p_partkey, p_partkey % 4 AS version,
  CASE p_partkey % 4 WHEN 0 THEN {_CONSERVATIVE} WHEN 1 THEN {_CONSERVATIVE} WHEN 2 THEN {_AGGRESSIVE} END AS cleaned FROM part""")
def title_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as the cleaner of each row's version gives them; there is none of version 3."""
    version = F.pmod("p_partkey", F.lit(4))
    return listed_titles(spark, sf_dir).select("p_partkey", version.alias("version"), hooks.title_of_version("title", version).alias("cleaned"))


@query(f"""
SELECT p_partkey,
  {_BY_SIZE.format('p_name', "p_name || ': Deluxe Edition'", 'p_name', _TITLED, "p_name || ', update 1.' || p_size")} AS lookup,
  {_BY_SIZE.format('p_name', "p_name || ': Deluxe Edition'", 'p_name', _TITLED, "p_name || ', update 1.' || p_size")} AS conservative,
  {_BY_SIZE.format('p_name', 'p_name', 'p_name', "p_name || ' & ' || p_type", 'p_name')} AS aggressive,
  {_BY_SIZE.format('p_name', "p_name || ' deluxe edition'", 'p_name', "p_name || ' and ' || lower(p_type) || ' crack fix'", "p_name || ' update 1 ' || p_size")} AS cache_key
FROM part""")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_titles(spark, sf_dir).select(
        "p_partkey",
        lookup_title("title").alias("lookup"),
        conservative_title("title").alias("conservative"),
        aggressive_title("title").alias("aggressive"),
        evidence_key("title").alias("cache_key"),
    )


_DASHED = "p_name || ' – v1.' || p_size || '.2 + 3 DLCs'"


@query(f"""
SELECT p_partkey,
  {_BY_SIZE.format('p_name', "p_name || ': Deluxe Edition'", "p_name || ' Build ' || p_size || ' (Portable)'", "p_name || ' &amp; ' || p_type || ' [Crack Fix]'", "p_name || ', update 1.' || p_size")} AS name,
  CASE WHEN p_size % 5 = 0 THEN 'v1.' || p_size || '.2 + 3 DLCs' ELSE '' END AS version,
  upper(p_name) AS display,
  {_BY_SIZE.format("'v1.' || p_size || '.2 + 3 DLCs'", "'Deluxe Edition'", "'Build ' || p_size || ' (Portable)'", "'&amp; ' || p_type || ' [Crack Fix]'", "', update 1.' || p_size")} AS edition
FROM part""")
def title_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and version, display title, and what an edition adds to the canonical title."""
    parts = title_parts("title")
    canonical = F.upper("p_name")
    return listed_titles(spark, sf_dir).select(
        "p_partkey",
        parts["name"].alias("name"),
        parts["version"].alias("version"),
        display_title("title", canonical).alias("display"),
        edition_title("title", canonical).alias("edition"),
    )


@query("""
SELECT p_partkey, p_name || ': ' || p_type AS longest, 2 + CASE WHEN length(p_type) >= 8 THEN 1 ELSE 0 END
  + CASE WHEN length(p_type) >= 3 AND length(string_split(p_name, ' ')[2]) >= 3 THEN 1 ELSE 0 END AS variants FROM part""")
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest name of a title and how many names it has."""
    title = F.concat("p_name", F.lit(": "), "p_type", F.lit(" – v1.0"))
    found = let(title_variants(title), lambda v: F.struct(F.get(v, F.lit(0)).alias("longest"), F.size(v).alias("variants")))
    return tables.parts(spark, sf_dir).select("p_partkey", F.inline(F.array(found)))


# --- candidates ---------------------------------------------------------------------


@query("""
SELECT c_custkey, n_name || '|' || r_name || '|' || 'missing-' || c_nationkey AS places, c_mktsegment AS segment
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked ids of customers decoded in order; an unknown id stays."""
    nations, regions = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    labels = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(
        regions.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label"))
    )
    rows = tables.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.array(
            F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("missing-"), "n_nationkey")
        ).alias("places"),
        F.array("c_mktsegment").alias("segment"),
    )
    decoded = resolve.decode_lists(rows, "c_custkey", ["places", "segment"], labels)
    return decoded.select("c_custkey", F.array_join("places", "|").alias("places"), F.array_join("segment", "|").alias("segment"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified parts as external entities with nested claims, read back from JSON."""
    meta = tables.verified(spark, sf_dir)
    label = F.concat(F.lit('{"fr":{"value":"'), "canonical_title", F.lit('"}}'))
    about = F.concat(F.lit('{"en":{"value":"a video game by '), "developer", F.lit('"},"fr":{"value":"jeu"}}'))

    def claim(prop: str, field: str, *values) -> list:
        items = []
        for i, value in enumerate(values):
            snak = F.concat(F.lit('{"mainsnak":{"datavalue":{"value":{"' + field + '":"'), value, F.lit('"}}}}'))
            items += [F.lit(","), snak] if i else [snak]
        return [F.lit(f'"{prop}":['), *items, F.lit("]")]

    date = F.concat(F.lit("+"), "release_date", F.lit("T00:00:00Z"))
    earlier = F.concat(F.lit("+"), F.date_sub(F.to_date("release_date"), 30).cast("string"), F.lit("T00:00:00Z"))
    claims = F.concat(
        F.lit("{"), *claim("P31", "id", F.lit("Q7889")), F.lit(","), *claim("P577", "time", date, earlier, date),
        F.lit(","), *claim("P136", "id", F.element_at("genres", 1)), F.lit(","), *claim("P178", "id", F.col("developer")),
        F.lit(',"P123":[{"mainsnak":{"snaktype":"novalue"}}]}'),
    )
    return meta.select(
        F.col("entity_id").alias("id"),
        F.from_json(label, VALUE_MAP).alias("labels"),
        F.from_json(about, VALUE_MAP).alias("descriptions"),
        F.from_json(claims, CLAIM_MAP).alias("claims"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.lower("s_name").alias("label"))
    return resolve.build_candidates(entities(spark, sf_dir), names, "entities", "https://www.example.org/wiki/")


@query(f"""
WITH {CATALOG}
SELECT 'Q' || id AS id, 'https://www.example.org/wiki/Q' || id AS url, canonical_title AS label,
       'a video game by ' || developer AS description, 'Q7889' AS instance_of,
       strftime(CAST(release_date AS DATE) - 30, '%Y-%m-%d') || '|' || release_date AS release_dates,
       genre AS genres, lower(developer) AS developers, '' AS publishers
FROM verified""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate fields out of nested claims."""
    lists = ["instance_of", "release_dates", "genres", "developers", "publishers"]
    rows = candidates(spark, sf_dir)
    return rows.select("id", "url", "label", "description", *[F.array_join(n, "|").alias(n) for n in lists])


@query(f"""
WITH {CATALOG},
l AS (SELECT DISTINCT title AS l, list_distinct(string_split(title, ' ')) AS lw FROM catalog),
r AS (SELECT DISTINCT canonical_title AS r, list_distinct(string_split(canonical_title, ' ')) AS rw FROM verified)
SELECT l AS "left", r AS "right" FROM l, r
WHERE len(list_intersect(lw, rw)) / len(list_distinct(list_concat(lw, rw))) >= 0.4""")
def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part and canonical titles that share at least 40 percent of their words."""
    left = tables.catalog(spark, sf_dir).select(match_fold("title").alias("title"))
    right = tables.verified(spark, sf_dir).select(match_fold("canonical_title").alias("title"))
    return resolve.title_pairs(left, right)


def near_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names, and the same with letters around them or less of them."""
    names = tables.table(spark, sf_dir, "part").select("p_partkey", match_fold("p_name").alias("title"))
    kind = F.pmod("p_partkey", F.lit(4))
    changed = (
        F.when(kind == 0, F.concat(F.lit("w"), "title", F.lit("y")))
        .when(kind == 1, F.substring("title", 2, 1000))
        .when(kind == 2, F.concat("title", F.lit(" "), "title"))
        .otherwise(F.col("title"))
    )
    return names.select("title"), names.select(changed.alias("title"))


@query("""
WITH l AS (SELECT DISTINCT p_name AS l FROM part),
r AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'w' || p_name || 'y' WHEN 1 THEN substr(p_name, 2)
        WHEN 2 THEN p_name || ' ' || p_name ELSE p_name END AS r FROM part),
pairs AS (
  SELECT l, r, list_distinct(string_split(trim(l), ' ')) AS lw, list_distinct(string_split(trim(r), ' ')) AS rw FROM l, r),
seen AS (
  SELECT l, r, len(list_intersect(lw, rw)) / len(list_distinct(list_concat(lw, rw))) AS share,
         contains(l, r) OR contains(r, l) AS contained FROM pairs)
SELECT l AS "left", r AS "right", share >= 0.4 AS by_words, l = r AS exact, contained
FROM seen WHERE share >= 0.4 OR (contained AND greatest(length(l), length(r)) <= 1.4 * least(length(l), length(r)))""")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of titles: by shared words, or by one containing the other."""
    left, right = near_titles(spark, sf_dir)
    by_words = resolve.title_pairs(left, right).withColumn("by_words", F.lit(True))
    pairs = by_words.join(resolve.contained_pairs(left, right), ["left", "right"], "full_outer")
    a, b = F.col("left"), F.col("right")
    return pairs.select("left", "right", F.coalesce("by_words", F.lit(False)).alias("by_words"), (a == b).alias("exact"),
                        (a.contains(b) | b.contains(a)).alias("contained"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part listings: canonical name plus an edition suffix."""
    title = F.concat(F.initcap(F.concat_ws(" ", "p_type", "p_name")), F.lit(": Ultimate Edition"))
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), title.alias("title"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence cache of all listings, searched twice where the first search finds nothing."""
    asked = jobs(spark, sf_dir).select("title")
    known = resolve.titled_candidates(candidates(spark, sf_dir))
    found = resolve.two_pass(asked, lambda titles: resolve.find_candidates(titles, known))
    return cut_lineage(resolve.evidence_cache(found, asked, F.lit(FETCHED)))


@query(f"""
WITH {CATALOG}
SELECT CAST(p_partkey AS VARCHAR) AS id, best IS NOT NULL AS accepted,
       CASE WHEN best IS NOT NULL THEN 'done' ELSE 'review' END AS outcome, best AS chosen_id
FROM part LEFT JOIN (SELECT canonical_title, min('Q' || id) AS best FROM verified GROUP BY canonical_title)
     ON canonical_title = lower(p_type || ' ' || p_name)""")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose base title is that of a complete entity are accepted; all others go to review."""
    decided = resolve.decide(jobs(spark, sf_dir), evidence(spark, sf_dir))
    return decided.select("id", "accepted", "outcome", F.col("candidate.id").alias("chosen_id"))


@query(f"""
WITH {CATALOG},
best AS (SELECT canonical_title, min('Q' || id) AS best FROM verified GROUP BY canonical_title)
SELECT CAST(p_partkey AS VARCHAR) AS id, canonical_title, strftime(CAST(v.release_date AS DATE) - 30, '%Y-%m-%d') AS release_date,
       v.genre AS genres, lower(v.developer) AS developer, CAST(NULL AS VARCHAR) AS publisher, CAST(0.99 AS DOUBLE) AS confidence,
       'https://www.example.org/wiki/' || best AS evidence, 'by title' AS notes, 3 AS version, best AS raw_id
FROM part JOIN best ON canonical_title = lower(p_type || ' ' || p_name) JOIN verified v USING (canonical_title)
WHERE 'Q' || v.id = best""")
def accepted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows copied from the accepted candidate of every listing that has one."""
    decided = resolve.decide(jobs(spark, sf_dir), evidence(spark, sf_dir))
    rows = resolve.results_of(decided, "deterministic", "by title", 3, F.lit(FETCHED).cast("timestamp"))
    return rows.select(
        "id", "canonical_title", "release_date", F.array_join("genres", "|").alias("genres"), "developer", "publisher",
        F.round("confidence", 9).alias("confidence"), F.array_join("evidence_urls", "|").alias("evidence"), "notes", "version",
        F.get_json_object("raw", "$.candidate.id").alias("raw_id"),
    )


@query()
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score, runner-up and reason of every listing; the sequence ratio has no SQL form."""
    decided = resolve.decide(jobs(spark, sf_dir), evidence(spark, sf_dir))
    return decided.select("id", F.round("confidence", 9).alias("confidence"), F.round("second", 9).alias("second"), "reason")


@query(f"""
WITH {CATALOG}, cache AS (SELECT DISTINCT title AS search_title FROM catalog WHERE details_ready)
SELECT p_partkey, p_name || CASE WHEN p_size % 5 = 1 THEN ' deluxe edition' ELSE '' END AS search_title,
       p_size % 5 IN (0, 2) AND p_name IN (SELECT search_title FROM cache) AS hit
FROM part WHERE p_size % 5 IN (0, 1, 2)
UNION ALL
SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN p_name || ' and ' || lower(p_type) || ' crack fix' ELSE p_name || ' update 1 ' || p_size END, false
FROM part WHERE p_size % 5 NOT IN (0, 1, 2)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits of listing titles by their cleaned form."""
    known = tables.catalog(spark, sf_dir).filter("details_version = 1").select(evidence_key("title").alias("search_title")).distinct()
    cache = known.withColumn("evidence", F.array("search_title"))
    found = resolve.cache_lookup(listed_titles(spark, sf_dir), cache)
    return found.select("p_partkey", "search_title", F.col("evidence").isNotNull().alias("hit"))


# --- decisions --------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
d AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN 'Q' || k WHEN 'click' THEN 'Q' || k WHEN 'purchase' THEN 'Q' || k END AS id,
  CASE WHEN event_type = 'error' THEN 'contains no usable supplied candidate'
       WHEN event_type IN ('view', 'purchase') AND k > 50 THEN 'selected a candidate outside the supplied evidence'
       WHEN event_type = 'click' AND k > 50 THEN 'contains no usable supplied candidate' END AS error,
  CASE event_type WHEN 'view' THEN k / 100.0 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN k / 100.0 WHEN 'signup' THEN 0.25 END AS confidence FROM e)
SELECT event_id, CASE WHEN error IS NULL THEN id END AS candidate_id,
       CASE WHEN error IS NULL THEN CAST(confidence AS DOUBLE) END AS confidence, error FROM d""")
def parse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in five shapes: fenced JSON, prose, percent and synonyms, null words, nonsense."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('```json\n{"candidate_id": "q'), k, F.lit('", "confidence": '), k.cast("int") / 100.0, F.lit("}\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("I would pick Q"), k, F.lit(" with confidence: 0,5 or so")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('So: {"candidate": "it is Q'), k, F.lit(' I think", "confidence_score": "'), k, F.lit('%", "rationale": "x"} ok')))
        .when(F.col("event_type") == "signup", '{"id": "None", "confidence": 0.25}')
        .otherwise("no idea, confidence 0.3")
    )
    allowed = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.concat(F.lit("Q"), i.cast("string")))
    parsed = tables.table(spark, sf_dir, "events").select("event_id", parse_decision(text, allowed).alias("d"))
    return parsed.select("event_id", "d.candidate_id", "d.confidence", "d.error")


@query("""
WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'forbidden field' WHEN value > 100 THEN 'confidence must be between 0 and 1'
   END AS error FROM e)
SELECT event_id, 'T' || k AS title, CASE WHEN event_type <> 'view' THEN '2024-01-0' || (k % 9 + 1) END AS release_date,
       'a|' || event_type AS genres, 'https://x.example/' || k AS urls, round(value / 100, 6) AS confidence, error,
       CASE WHEN event_type <> 'view' AND value / 100 >= 0.5 THEN 'done' ELSE 'review' END AS status
FROM r""")
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed results checked field by field, and their acceptance."""
    from ...functions.decisions import acceptance

    k = F.get_json_object("props", "$.k")
    date = F.when(F.col("event_type") == "view", "2024").otherwise(F.concat(F.lit("2024-01-0"), (k.cast("int") % 9 + 1).cast("string")))
    extra = F.when(F.col("event_type") == "error", F.lit(',"Torrent":1')).otherwise("")
    text = F.concat(
        F.lit('{"canonical_title":" T'), k, F.lit('","release_date":"'), date, F.lit('","genres":["a"," a ","'), "event_type",
        F.lit('",""],"confidence":'), F.col("value") / 100, F.lit(',"evidence_urls":["https://x.example/'), k,
        F.lit('","https://y.example/"]'), extra, F.lit("}"),
    )
    url = F.array(F.concat(F.lit("https://x.example/"), k))
    def fields(r):
        return F.struct(
            r["canonical_title"].alias("title"), r["release_date"].alias("release_date"),
            F.array_join(r["genres"], "|").alias("genres"), F.array_join(r["evidence_urls"], "|").alias("urls"),
            F.round(r["confidence"], 6).alias("confidence"), r["error"].alias("error"), acceptance(r, 0.5).alias("status"),
        )

    events = tables.spread(tables.table(spark, sf_dir, "events"))
    return events.select("event_id", F.inline(F.array(let(validate_result(text, url), fields))))


@query("""
SELECT event_id, event_type || '|' || json_extract_string(props, '$.k') AS items, 1::INTEGER AS capped,
       list_distinct([event_type, 'x'])[1] IS NOT NULL AS filled, json_extract_string(props, '$.k') || '|' || event_type AS merged
FROM events""")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists cleaned, capped and merged; anything else is an empty list."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('[" '), "event_type", F.lit('", "'), "event_type", F.lit(' ", "", null, '), k, F.lit("]"))
    return tables.table(spark, sf_dir, "events").select(
        "event_id",
        F.array_join(json_list(text), "|").alias("items"),
        F.size(json_list(text, count=1)).alias("capped"),
        ((F.size(json_list(text)) > 0) & (F.size(json_list(F.lit("{bad"))) == 0)).alias("filled"),
        F.array_join(merged_ids(F.array(k, F.col("event_type")), F.array(F.col("event_type"), F.lit("late")), 2), "|").alias("merged"),
    )


@query("SELECT count(*) AS forbidden FROM events WHERE json_exists(props, '$.k')")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").filter(quality.forbidden_keys(F.col("props"), ["k", "downloads"]))
    return rows.agg(F.count(F.lit(1)).alias("forbidden"))


@query(r"""
SELECT page_id, CASE WHEN starts_with(url, 'https://') AND regexp_matches(url, '^https://[^/]*\.example\.net/')
  THEN regexp_replace(url, '#.*$', '') || '|' ELSE '' END || 'https://www.example.org/x' AS evidence FROM pages""")
def evidence_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence urls of allowed hosts, without fragments."""
    urls = F.array("url", F.concat("url", F.lit("#again")), F.lit("https://www.example.org/x#y"), F.lit("ftp://www.example.org/"))
    kept = public_evidence(urls, ["www.example.org"], [".example.net"])
    clean = F.array_distinct(F.transform(kept, lambda u: u))
    return tables.pages(spark, sf_dir).select("page_id", F.array_join(clean, "|").alias("evidence"))


# --- review ------------------------------------------------------------------------------


def review_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    return rows.select(
        "id", "title", F.sha2("title", 256).alias("fingerprint"), F.lit("review").alias("status"), F.lit(True).alias("active"),
        F.lit(FETCHED).cast("timestamp").alias("updated_at"),
    )


def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier rounds: small parts were resolved, promoted ones failed, some too often."""
    rows = tables.table(spark, sf_dir, "part").filter(F.col("p_type").isin("SMALL", "PROMO"))
    title = F.concat(F.initcap(F.concat_ws(" ", "p_type", "p_name")), F.lit(": Ultimate Edition"))
    return rows.select(
        F.col("p_partkey").cast("string").alias("id"), F.sha2(title, 256).alias("fingerprint"), F.lit(1).alias("worker_version"),
        F.when(F.col("p_type") == "SMALL", "resolved").otherwise("error").alias("status"),
        F.pmod("p_size", F.lit(5)).alias("attempts"),
    )


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_type WHEN 'PROMO' THEN 'error' END AS review_status FROM part
WHERE p_type NOT IN ('SMALL', 'PROMO') OR (p_type = 'PROMO' AND p_size % 5 < 3)""")
def review_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs for the second stage: never tried, or failed with attempts left."""
    return review.work(review_jobs(spark, sf_dir), review_state(spark, sf_dir)).select("id", "review_status")


@query(f"""
WITH {CATALOG},
w AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_type || ' ' || p_name) AS t, p_type, p_size FROM part
  WHERE p_type NOT IN ('SMALL', 'PROMO') OR (p_type = 'PROMO' AND p_size % 5 < 3)),
asked AS (SELECT DISTINCT t, list_distinct(string_split(t, ' ')) AS tw FROM w),
known AS (SELECT DISTINCT canonical_title AS c, list_distinct(string_split(canonical_title, ' ')) AS cw FROM verified),
found AS (
  SELECT DISTINCT t FROM asked, known
  WHERE len(list_intersect(tw, cw)) / len(list_distinct(list_concat(tw, cw))) >= 0.4
     OR ((contains(t, c) OR contains(c, t)) AND greatest(length(t), length(c)) <= 1.4 * least(length(t), length(c))))
SELECT id, CASE WHEN t NOT IN (SELECT t FROM found) THEN 'ineligible' WHEN p_size >= 25 THEN 'resolved' ELSE 'unresolved' END AS status,
       CASE WHEN p_type = 'PROMO' THEN p_size % 5 + 1 ELSE 1 END AS attempts
FROM w""")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review round whose decisions take the first candidate, surely for large parts only; jobs without any are ineligible."""
    waiting = review.work(review_jobs(spark, sf_dir), review_state(spark, sf_dir))
    catalog = tables.catalog(spark, sf_dir)
    cache = evidence(spark, sf_dir)
    eligible = review.eligibility(waiting, catalog, cache)
    sure = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") >= 25).alias("sure"))
    heads, bodies = review.requests(eligible, cache)
    first = bodies.select("search_title", F.get_json_object("candidates", "$[0].id").alias("first"))
    asked = heads.join(first, "search_title").join(sure, "id")
    answer = F.concat(F.lit('{"candidate_id":"'), "first", F.lit('","confidence":'), F.when(F.col("sure"), "0.95").otherwise("0.9"), F.lit("}"))
    decided = review.outcomes(eligible, asked.select("id", answer.alias("response")), cache)
    return decided.select("id", "status", "attempts")
