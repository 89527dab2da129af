"""Constraint checks over the catalog. Every check yields ``(id, rule)`` violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_text, text_or_empty
from ..functions.urls import DISPLAY_SKIP_HINTS, host_allowed, host_of, is_https
from ..schemas import DETAILS_VERSION, LEGACY_MEDIA_VERSIONS, MEDIA_VERSION
from .dedupe import repeated_keys

# --- Fixed values -----------------------------------------------------------
META_LABEL = r"(?i)\b(?:Company|Companies|Languages|Original Size|Repack Size):"
FORBIDDEN_TEXT = ["magnet:"]
MEDIA_CAP, LEGACY_MEDIA_CAP = 8, 12
# -----------------------------------------------------------------------------


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule. A rule is a condition that holds when it is broken."""
    broken = F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def _unparseable(column: str) -> Column:
    text = text_or_empty(column)
    return (text != "") & F.try_to_timestamp(text).isNull()


def catalog_rules(hosts: list[str] = (), host_suffixes: list[str] = ()) -> dict[str, Column]:
    """The constraint suite of a stored catalog; hosts are checked when given."""
    media = F.col("media")
    current = F.col("media_version").eqNullSafe(F.lit(MEDIA_VERSION))
    animations = F.size(F.filter(media, lambda m: m["type"] == "gif"))
    previews = F.filter(media, lambda m: m["preview_url"].isNotNull())
    row_text = F.lower(F.to_json(F.struct("*")))
    forbidden = F.lit(False)
    for text in FORBIDDEN_TEXT:
        forbidden = forbidden | row_text.contains(text)
    rules = {
        "missing-id": strip_text("id") == "",
        "missing-title": strip_text("title") == "",
        "missing-source-url": strip_text("source_url") == "",
        "source-url-not-https": (strip_text("source_url") != "") & ~is_https("source_url"),
        "image-url-not-https": (text_or_empty("image_url") != "") & ~is_https("image_url"),
        "forbidden-text": forbidden,
        "post-date-unparseable": _unparseable("post_date"),
        "media-checked-unparseable": _unparseable("media_checked_at"),
        "details-checked-unparseable": _unparseable("details_checked_at"),
        "blank-genre": F.exists("genres", lambda g: strip_text(g) == ""),
        "label-in-genre": F.exists("genres", lambda g: g.rlike(META_LABEL)),
        "media-version-unknown": F.col("media_version").isNotNull()
        & ~current
        & ~F.col("media_version").isin(LEGACY_MEDIA_VERSIONS),
        "too-many-media": F.size(media) > F.when(current, MEDIA_CAP).otherwise(LEGACY_MEDIA_CAP),
        "media-type-unknown": F.exists(media, lambda m: ~F.coalesce(m["type"], F.lit("")).isin("image", "gif")),
        "media-url-not-https": F.exists(media, lambda m: ~is_https(m["url"])),
        "preview-needs-current-version": (F.size(previews) > 0) & ~current,
        "preview-url-not-https": F.exists(previews, lambda m: ~is_https(m["preview_url"])),
        "repeated-media-url": F.size(F.array_distinct(F.transform(media, lambda m: m["url"]))) < F.size(media),
        "animation-not-first": current & F.exists(F.slice(media, 2, 1 << 20), lambda m: m["type"] == "gif"),
        "too-many-animations": current & (animations > 1),
        "details-version-unknown": F.col("details_version").isNotNull()
        & (F.col("details_version") != DETAILS_VERSION),
        "details-missing": F.col("details_version").isNotNull() & F.col("details").isNull(),
        "blank-feature": F.exists(F.col("details.features"), lambda f: strip_text(f) == ""),
        "blank-package-feature": F.exists(F.col("details.package_features"), lambda f: strip_text(f) == ""),
    }
    if hosts or host_suffixes:
        rules["source-host-not-allowed"] = is_https("source_url") & ~host_allowed(
            "source_url", list(hosts), list(host_suffixes)
        )
    return rules


def catalog_violations(records: DataFrame, hosts: list[str] = (), host_suffixes: list[str] = ()) -> DataFrame:
    """All broken rules of a catalog, repeated ids included."""
    found = violations(records, F.col("id"), catalog_rules(hosts, host_suffixes))
    repeats = repeated_keys(records, ["id"]).select("id", F.lit("repeated-id").alias("rule"))
    return found.unionByName(repeats)


def forbidden_keys(document: Column, keys: list[str]) -> Column:
    """Whether the top level of a JSON document has one of ``keys``, without regard to case."""
    names = F.transform(F.json_object_keys(document), F.lower)
    return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(k) for k in keys])), F.lit(False))


def displayable_media(media: Column, blocked_hosts: list[str] = ()) -> Column:
    """Media without blocked hosts and without decoration such as logos or banners."""
    pattern = "|".join(DISPLAY_SKIP_HINTS)

    def keep(item: Column) -> Column:
        host = host_of(item["url"])
        path = F.lower(F.coalesce(F.try_parse_url(item["url"], F.lit("PATH")), F.lit("")))
        blocked = host.isin(list(blocked_hosts)) if blocked_hosts else F.lit(False)
        return (host != "") & ~blocked & ~F.concat_ws(" ", host, path).rlike(pattern)

    return F.filter(media, keep)


def health_violations(health: DataFrame) -> DataFrame:
    """Counters of a health report that contradict each other."""
    total = F.col("total_games")
    rules = {
        "described-over-total": ~F.col("with_description").between(0, total),
        "galleries-over-total": ~F.col("with_gallery").between(0, total),
        "verified-over-total": ~F.col("metadata_verified").between(0, total),
        "unmatched-over-snapshot": F.col("metadata_unmatched") > F.col("metadata_snapshot_count"),
    }
    return violations(health, F.lit("health").alias("id"), rules)
