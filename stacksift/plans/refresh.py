"""Refresh job: listing pages to catalog and quarantine, written when changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Rule
from ..operators.merge import full_scan_stamp, latest_scan, refresh_catalog, refresh_mode
from ..schemas import CATALOG, CATALOG_VERSION, QUARANTINE
from ..sources.pages import listing_records
from ..sources.snapshots import publish, read_current

ENVELOPE = "catalog_version int, source_pages int, last_full_scan_at string, mode string"


def refresh(
    spark: SparkSession,
    pages: DataFrame,
    root: str,
    rules: list[Rule],
    now: datetime,
    exact: DataFrame | None = None,
    full_scan: bool = False,
    replace: bool = False,
    wanted_pages: int = 8,
) -> dict:
    """Merge the listing ``pages`` (``page, html``; null html for a failed page) into ``root``.

    Incremental runs read the newest pages only. Fails when every page failed.
    """
    stored = read_current(spark, f"{root}/catalog", CATALOG)
    quarantine = read_current(spark, f"{root}/quarantine", QUARANTINE)
    envelope = read_current(spark, f"{root}/envelope", ENVELOPE).first()
    known_version = envelope["catalog_version"] if envelope else None
    has_rows = 0 if stored.isEmpty() else 1
    mode, everything = refresh_mode(has_rows, known_version, CATALOG_VERSION, full_scan)

    total = pages.agg(F.max("page")).first()[0] or 0
    chosen = pages if everything else pages.filter(F.col("page") <= max(1, wanted_pages))
    counts = chosen.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("html").isNull()).alias("failed")).first()
    if counts["pages"] and counts["pages"] == counts["failed"]:
        raise RuntimeError("all requested listing pages failed")

    scanned = latest_scan(listing_records(chosen.filter(F.col("html").isNotNull())))
    result = refresh_catalog(stored, scanned, quarantine, rules, exact, replace)
    previous = envelope["last_full_scan_at"] if envelope else None
    stamp = full_scan_stamp(previous, now.isoformat(), everything, counts["failed"])
    catalog_written = publish(result.catalog, f"{root}/catalog", now)
    quarantine_written = publish(result.quarantine, f"{root}/quarantine", now)
    facts = spark.createDataFrame([(CATALOG_VERSION, total, stamp, mode)], ENVELOPE)
    publish(facts, f"{root}/envelope", now, ignore=["mode"])
    return {
        "mode": mode, "pages": counts["pages"], "failed_pages": counts["failed"],
        "catalog_written": catalog_written, "quarantine_written": quarantine_written,
    }
