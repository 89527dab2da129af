"""Merging scans into the stored catalog and the quarantine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SCANNED_FIELDS, STORED_ONLY_FIELDS
from .classify import Rule, classify, quarantine_entries
from .dedupe import first_per_key


class Refresh(NamedTuple):
    catalog: DataFrame
    quarantine: DataFrame


def latest_scan(scanned: DataFrame, page: str = "page", position: str = "position") -> DataFrame:
    """One row per id when listings overlap: the newest listing page wins."""
    return first_per_key(scanned, ["id"], [F.col(page), F.col(position).desc()]).drop(page, position)


def overlay(stored: DataFrame, fresh: DataFrame, fields: list[str] = SCANNED_FIELDS) -> DataFrame:
    """Fresh records over stored ones, field by field, empty values included.

    Fields that a scan does not produce keep their stored value.
    """
    new = fresh.select("id", F.struct(*fields).alias("_new"))
    joined = stored.join(new, "id", "full_outer")
    present = F.col("_new").isNotNull()
    merged = {f: F.when(present, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(merged).drop("_new")


def merge_quarantine(previous: DataFrame, detections: DataFrame, accepted: DataFrame) -> DataFrame:
    """Earlier entries without accepted ids, replaced where detected again.

    ``detections`` carries ``_turn``: of several detections of one id the last wins.
    """
    named = detections.filter(F.coalesce(F.col("id"), F.lit("")) != "")
    latest = first_per_key(named, ["id"], [F.col("_turn").desc(), F.col("action")]).drop("_turn")
    kept = previous.filter(F.coalesce(F.col("id"), F.lit("")) != "").join(accepted, "id", "left_anti")
    return kept.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def refresh_catalog(
    stored: DataFrame,
    scanned: DataFrame,
    quarantine: DataFrame,
    rules: list[Rule],
    exact: DataFrame | None = None,
    replace: bool = False,
) -> Refresh:
    """Classify a scan and the stored catalog, merge both, maintain the quarantine.

    Stored rejects always leave the catalog. Stored rows without enough signals stay and
    are also quarantined; only ``replace`` drops them, and then nothing stored survives.
    """
    empty = {f: F.lit(None) for f in STORED_ONLY_FIELDS}
    as_stored = stored.schema
    padded = scanned.withColumns({f: empty[f].cast(as_stored[f].dataType) for f in STORED_ONLY_FIELDS if f in as_stored.names})
    fresh = classify(padded, rules, exact)
    old = classify(stored.filter(F.coalesce(F.col("id"), F.lit("")) != ""), rules, exact)

    accepted_fresh = fresh.filter(F.col("kind") == "game")
    held = quarantine_entries(fresh.filter(F.col("kind") != "game"), F.lit("excluded-new"))
    retained = "review-dropped-on-replace" if replace else "review-retained"
    flagged = quarantine_entries(
        old.filter(F.col("kind") != "game"),
        F.when(F.col("kind") == "non_game", "removed-existing").otherwise(retained),
    )
    detections = held.withColumn("_turn", F.lit(0)).unionByName(flagged.withColumn("_turn", F.lit(1)))
    accepted = accepted_fresh.select("id").unionByName(old.filter(F.col("kind") == "game").select("id")).distinct()

    kept = old.filter(F.lit(False)) if replace else old.filter(F.col("kind") != "non_game")
    catalog = overlay(kept.select(*stored.columns), accepted_fresh.select(*scanned.columns))
    return Refresh(catalog, merge_quarantine(quarantine, detections, accepted))


def catalog_order() -> list[Column]:
    """Newest post first, then id."""
    return [F.coalesce(F.col("post_date"), F.lit("")).desc(), F.col("id")]


def quarantine_order() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")) for c in ("classification", "title", "id")]


def write_back(catalog: DataFrame, updates: DataFrame, fields: list[str], stamp: Column, stamped: list[str]) -> DataFrame:
    """Apply enrichment updates where something differs, and stamp those rows.

    Adds ``changed``. A row whose stamp is missing counts as different.
    """
    new = updates.select("id", F.struct(*fields).alias("_new"))
    joined = catalog.join(new, "id", "left")
    differs = F.lit(False)
    for field in fields:
        differs = differs | ~F.col(f"_new.{field}").eqNullSafe(F.col(field))
    for field in stamped:
        differs = differs | (F.coalesce(F.col(field), F.lit("")) == "")
    joined = joined.withColumn("changed", F.col("_new").isNotNull() & differs)
    values = {f: F.when(F.col("changed"), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    values |= {f: F.when(F.col("changed"), stamp).otherwise(F.col(f)) for f in stamped}
    return joined.withColumns(values).drop("_new")


def new_arrivals(feed: DataFrame, catalog: DataFrame, url: str = "url") -> DataFrame:
    """Feed urls that the catalog does not have. Both sides carry normalized urls."""
    return feed.join(catalog.select(F.col(url)), url, "left_anti")


def refresh_mode(stored_rows: int, stored_version: int | None, version: int, full_scan: bool) -> tuple[str, bool]:
    """Mode of a refresh, and whether it scans every page."""
    if stored_rows == 0:
        return "bootstrap", True
    if stored_version != version:
        return "schema-rebuild", True
    return ("full-scan", True) if full_scan else ("incremental", False)


def refresh_mode_of(stored_rows: Column, stored_version: Column, version: Column, full_scan: Column) -> tuple[Column, Column]:
    """``refresh_mode`` for many catalogs at once."""
    mode = (
        F.when(stored_rows == 0, "bootstrap")
        .when(~stored_version.eqNullSafe(version), "schema-rebuild")
        .when(full_scan, "full-scan")
        .otherwise("incremental")
    )
    return mode, mode != "incremental"


def full_scan_stamp(previous: str | None, now: str, full_scan: bool, failed_pages: int) -> str | None:
    """The full-scan stamp moves only when a full scan lost no page."""
    return now if full_scan and failed_pages == 0 else previous
