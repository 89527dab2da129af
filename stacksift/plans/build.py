"""Build job: catalog and verified snapshot to light catalog, index, health and details."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import light, quality, search
from ..operators.merge import catalog_order
from ..operators.ordinals import with_ordinals
from ..schemas import SEARCH_INDEX_VERSION
from ..sources.snapshots import write_details


class Site(NamedTuple):
    catalog: DataFrame
    index: DataFrame
    health: DataFrame


def build_site(records: DataFrame, verified: DataFrame) -> Site:
    """Light catalog numbered in catalog order, its postings by ordinal, and its health."""
    numbered = with_ordinals(light.light_catalog(records, verified), catalog_order())
    prepared = search.prepare(numbered)
    index = search.postings(prepared, "ordinal", "index_words")
    return Site(numbered, index, light.health_report(numbered, verified))


def check_site(site: Site) -> DataFrame:
    """Violations of the published-output invariants: ``id, rule``."""
    missing = search.missing_postings(site.catalog, "ordinal", "title", site.index)
    lost = missing.select(F.col("ordinal").cast("string").alias("id"), F.concat(F.lit("missing-posting-"), "kind").alias("rule"))
    return lost.unionByName(quality.health_violations(site.health))


def write_site(site: Site, records: DataFrame, verified: DataFrame, path: str) -> None:
    """Write every part. The index is laid out by key prefix for lookups."""
    site.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
    postings = site.index.withColumn("version", F.lit(SEARCH_INDEX_VERSION))
    postings.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key").write.mode("overwrite").parquet(
        f"{path}/index"
    )
    site.health.write.mode("overwrite").json(f"{path}/health")
    write_details(light.with_verified(light.valid_rows(records), verified), f"{path}/details")
