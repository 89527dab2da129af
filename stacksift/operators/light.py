"""Light catalog, detail records and the health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import detail_name
from ..functions.text import array_or_empty, newest_text, size_mb, strip_text, text_or_empty, year_of
from ..schemas import DETAILS_VERSION, MEDIA_VERSION, METADATA_VERSION

VERIFIED_FIELDS = [
    "canonical_title", "release_date", "genres", "developer", "publisher",
    "platforms", "evidence_urls", "checked_at",
]


def valid_rows(records: DataFrame) -> DataFrame:
    """Rows with a non-blank id and title, both trimmed."""
    trimmed = records.withColumn("id", strip_text("id")).withColumn("title", strip_text("title"))
    return trimmed.filter((F.col("id") != "") & (F.col("title") != ""))


def details_ready() -> Column:
    return F.col("details_version").eqNullSafe(F.lit(DETAILS_VERSION))


def media_ready() -> Column:
    return F.col("media_version").eqNullSafe(F.lit(MEDIA_VERSION))


def pending() -> Column:
    """Has a source page and is not fully enriched."""
    return (text_or_empty("source_url") != "") & ~(details_ready() & media_ready())


def stale(refresh: bool = False) -> Column:
    """Work for the enrichment batch: a page to read, and an outdated version or a forced refresh."""
    outdated = F.lit(True) if refresh else ~(details_ready() & media_ready())
    return (text_or_empty("source_url") != "") & outdated


def with_verified(records: DataFrame, verified: DataFrame) -> DataFrame:
    """Every record with its verified metadata as one struct, null when there is none."""
    packed = verified.select("id", F.struct(*[F.col(c) for c in verified.columns if c != "id"]).alias("verified_metadata"))
    return records.join(packed, "id", "left")


def unmatched_verified(records: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified rows that no record uses."""
    return verified.join(records.select("id"), "id", "left_anti")


def light_catalog(records: DataFrame, verified: DataFrame) -> DataFrame:
    """The projection the catalog is browsed with."""
    joined = with_verified(valid_rows(records), verified)
    meta = F.col("verified_metadata")
    media = F.coalesce("media", F.array().cast("array<struct<type:string,url:string,preview_url:string>>"))
    animated = F.exists(media, lambda m: (m["type"] == "gif") & (text_or_empty(m["url"]) != ""))
    return joined.select(
        "id",
        "title",
        "source_url",
        "image_url",
        "post_date",
        "genres",
        "size_text",
        F.concat(F.lit("data/details/"), detail_name("id"), F.lit(".json")).alias("detail_path"),
        year_of("post_date").alias("year"),
        size_mb("size_text").alias("size_mb"),
        details_ready().alias("details_ready"),
        (strip_text(F.col("details.description")) != "").alias("has_description"),
        F.size(media).alias("media_count"),
        F.coalesce(animated, F.lit(False)).alias("has_gif"),
        meta.isNotNull().alias("metadata_ready"),
        meta["canonical_title"].alias("canonical_title"),
        meta["release_date"].alias("game_release_date"),
        array_or_empty(meta["genres"]).alias("metadata_genres"),
        meta["developer"].alias("metadata_developer"),
        meta["publisher"].alias("metadata_publisher"),
        array_or_empty(meta["platforms"]).alias("metadata_platforms"),
        F.slice(array_or_empty(meta["evidence_urls"]), 1, 2).alias("metadata_evidence_urls"),
        newest_text("details_checked_at", "media_checked_at", meta["checked_at"]).alias("detail_updated_at"),
        pending().alias("enrichment_pending"),
    )


def renderable() -> Column:
    """Whether a detail record has anything to show."""
    features = F.exists(array_or_empty(F.col("details.features")), lambda x: strip_text(x) != "")
    package = F.exists(array_or_empty(F.col("details.package_features")), lambda x: strip_text(x) != "")
    described = strip_text(F.col("details.description")) != ""
    shown = F.size(sane_media(F.col("media"))) > 0
    return F.coalesce(F.col("verified_metadata").isNotNull() | described | features | package | shown, F.lit(False))


def sane_media(media: Column) -> Column:
    """Https media of a known type, at most twelve."""
    kept = F.filter(media, lambda m: m["url"].startswith("https://") & m["type"].isin("image", "gif"))
    return F.slice(F.coalesce(kept, F.array().cast("array<struct<type:string,url:string,preview_url:string>>")), 1, 12)


def health_report(light: DataFrame, verified: DataFrame) -> DataFrame:
    """Counters and coverage percentages of a light catalog, one row."""

    def count(flag: Column) -> Column:
        return F.count_if(flag).cast("long")

    matched = verified.select("id").join(light.select("id", F.lit(True).alias("used")), "id", "left")
    snapshot = matched.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"), count(F.col("used").isNull()).alias("unmatched")
        ).alias("s")
    ).scalar()
    stats = light.agg(
        F.count(F.lit(1)).alias("total_games"),
        count(F.col("details_ready")).alias("details_ready"),
        count(F.col("has_description")).alias("with_description"),
        count(F.col("media_count") > 0).alias("with_gallery"),
        count(F.col("has_gif")).alias("with_gif"),
        F.coalesce(F.sum("media_count"), F.lit(0)).cast("long").alias("media_items"),
        count(F.col("enrichment_pending")).alias("enrichment_pending"),
        count(F.col("metadata_ready")).alias("metadata_verified"),
    )

    def share(column: str) -> Column:
        return F.round(F.col(column) * 100.0 / F.greatest(F.col("total_games"), F.lit(1)), 1)

    return stats.select(
        "*",
        snapshot["rows"].alias("metadata_snapshot_count"),
        snapshot["unmatched"].alias("metadata_unmatched"),
        share("details_ready").alias("coverage_details"),
        share("with_description").alias("coverage_descriptions"),
        share("with_gallery").alias("coverage_galleries"),
        share("with_gif").alias("coverage_gifs"),
        share("metadata_verified").alias("coverage_metadata"),
        F.lit(DETAILS_VERSION).alias("expected_details"),
        F.lit(MEDIA_VERSION).alias("expected_media"),
        F.lit(METADATA_VERSION).alias("expected_metadata"),
    )
