"""Schemas of the catalog, its side tables and its queues."""

from __future__ import annotations

DETAILS = "struct<description:string,features:array<string>,package_features:array<string>>"
MEDIA = "array<struct<type:string,url:string,preview_url:string>>"

SCANNED_FIELDS = ["title", "source_url", "image_url", "post_date", "genres", "size_text"]
STORED_ONLY_FIELDS = [
    "details", "details_version", "details_checked_at", "media", "media_version", "media_checked_at",
]

SCANNED = (
    "id string, title string, source_url string, image_url string, post_date string,"
    " genres array<string>, size_text string"
)
CATALOG = (
    f"{SCANNED}, details {DETAILS}, details_version int, details_checked_at string,"
    f" media {MEDIA}, media_version int, media_checked_at string"
)
QUARANTINE = (
    "id string, title string, source_url string, classification string, reason string,"
    " score int, signals array<string>, action string"
)
VERIFIED = (
    "id string, canonical_title string, release_date string, genres array<string>, confidence double,"
    " evidence_urls array<string>, checked_at string, developer string, publisher string,"
    " platforms array<string>, entity_id string"
)
CANDIDATE_FIELDS = (
    "source string, url string, id string, label string, description string, instance_of array<string>,"
    " release_dates array<string>, genres array<string>, developers array<string>,"
    " publishers array<string>, platforms array<string>"
)
CANDIDATE = "struct<" + ",".join(
    f"{name}:{kind}" for name, kind in (f.split() for f in CANDIDATE_FIELDS.split(","))
) + ">"
JOBS = (
    "id string, title string, fingerprint string, status string, active boolean, attempts int,"
    " last_error string, queued_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp"
)
RESULTS = (
    "id string, canonical_title string, release_date string, genres array<string>, developer string,"
    " publisher string, platforms array<string>, description string, confidence double,"
    " evidence_urls array<string>, notes string, version int, checked_at timestamp, raw string"
)
EVIDENCE_CACHE = f"search_title string, evidence array<{CANDIDATE}>, fetched_at timestamp"
REVIEW_STATE = (
    "id string, fingerprint string, worker_version int, status string, attempts int, candidate_id string,"
    " confidence double, reason string, last_error string, attempted_at timestamp"
)
FIELD_JOBS = (
    "id string, field_key string, fingerprint string, source_sha256 string, source_text string,"
    " terms array<string>, worker_version int, status string, attempts int, translated_text string,"
    " last_error string, active boolean, created_at timestamp, updated_at timestamp"
)
BATCH_LOG = (
    "run string, batch int, pending_before bigint, pending_after bigint, processed bigint, done bigint,"
    " review bigint, failed bigint, deferred bigint"
)
LIBRARY = "user_id string, list string, id string"

# --- Fixed values: parser and snapshot versions ------------------------------
CATALOG_VERSION = 2
MEDIA_VERSION = 7
DETAILS_VERSION = 1
METADATA_VERSION = 1
SEARCH_INDEX_VERSION = 1
TRANSLATION_VERSION = 1
LEGACY_MEDIA_VERSIONS = [2, 3, 4, 5, 6]
# -----------------------------------------------------------------------------
