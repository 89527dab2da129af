"""Public snapshots: export gate, entries, accounting and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped_list, collapse
from ..functions.urls import host_allowed, is_https, without_fragment

# --- Fixed values -----------------------------------------------------------
MIN_CONFIDENCE = 0.90
ITEM_CHARS = 180
EVIDENCE_LISTED, EVIDENCE_KEPT = 10, 6
ENTITY_LINK = r"(?i)/wiki/(Q\d+)$"
# -----------------------------------------------------------------------------


def _limited(value: Column | str, limit: int) -> Column:
    return F.nullif(F.left(collapse(value), F.lit(limit)), F.lit(""))


def public_evidence(urls: Column | str, hosts: list[str], suffixes: list[str]) -> Column:
    """Https urls of allowed hosts, without fragments, distinct, the first six."""
    listed = capped_list(F.col(urls) if isinstance(urls, str) else urls, ITEM_CHARS, EVIDENCE_LISTED)
    allowed = F.filter(listed, lambda u: is_https(u) & host_allowed(u, hosts, suffixes))
    return F.slice(F.array_distinct(F.transform(allowed, without_fragment)), 1, EVIDENCE_KEPT)


def eligible(jobs: DataFrame, results: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Results of active, finished jobs with enough confidence."""
    done = jobs.filter(F.col("active") & (F.col("status") == "done")).select("id")
    return results.filter(F.col("confidence") >= min_confidence).join(done, "id", "left_semi")


def entries(rows: DataFrame, hosts: list[str], suffixes: list[str]) -> DataFrame:
    """Public entry of every eligible row; ``exported`` is false for incomplete ones."""
    evidence = public_evidence("evidence_urls", hosts, suffixes)
    built = rows.select(
        F.btrim("id").alias("id"),
        _limited("canonical_title", 300).alias("canonical_title"),
        _limited("release_date", 32).alias("release_date"),
        capped_list(F.col("genres"), ITEM_CHARS, 12).alias("genres"),
        F.round("confidence", 4).alias("confidence"),
        evidence.alias("evidence_urls"),
        _limited(F.col("checked_at").cast("string"), 64).alias("checked_at"),
        _limited("developer", 300).alias("developer"),
        _limited("publisher", 300).alias("publisher"),
        capped_list(F.col("platforms"), ITEM_CHARS, 24).alias("platforms"),
    )
    first = F.get("evidence_urls", F.lit(0))
    named = F.nullif(F.upper(F.regexp_extract(first, ENTITY_LINK, 1)), F.lit(""))
    complete = (
        (F.col("id") != "")
        & F.col("canonical_title").isNotNull()
        & F.col("release_date").isNotNull()
        & (F.size("genres") > 0)
        & (F.size("evidence_urls") > 0)
    )
    return built.withColumn("entity_id", named).withColumn("exported", complete)


def snapshot(built: DataFrame) -> DataFrame:
    return built.filter("exported").drop("exported")


def export_counts(built: DataFrame) -> DataFrame:
    """Eligible, exported and skipped rows."""
    done = F.count_if(F.col("exported"))
    total = F.count(F.lit(1))
    return built.agg(total.alias("eligible_rows"), done.alias("exported"), (total - done).alias("skipped_incomplete"))


# --- change detection -----------------------------------------------------------


def content_hash(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Row count and order-insensitive hash of a table, one row.

    Row hashes are summed as decimals, so repeated rows do not cancel out.
    """
    columns = sorted(c for c in df.columns if c not in ignore)
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in columns]).cast("decimal(38,0)")
    total = F.coalesce(F.sum(hashed), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("content"))


def same_content(left: DataFrame, right: DataFrame, ignore: list[str] = ()) -> bool:
    """Whether two snapshots hold the same rows, volatile columns aside."""
    return content_hash(left, ignore).first() == content_hash(right, ignore).first()


def changes(previous: DataFrame, current: DataFrame, key: str, ignore: list[str] = ()) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    columns = [c for c in current.columns if c != key and c not in ignore]
    old = previous.select(key, F.struct(*columns).alias("_old"))
    new = current.select(key, F.struct(*columns).alias("_new"))
    both = old.join(new, key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def input_gate(inputs: dict[str, DataFrame], version: int) -> DataFrame:
    """Content hash per input plus the worker version, one row per input.

    A job that stored these rows can skip its sync while they stay the same.
    """
    parts = [
        content_hash(df).select(F.lit(name).alias("input"), F.lit(version).alias("version"), "rows", "content")
        for name, df in sorted(inputs.items())
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def inputs_unchanged(gate: DataFrame, stored: DataFrame) -> bool:
    """Whether a gate equals the stored one; a bounded comparison of a few rows."""
    return same_content(gate, stored)
