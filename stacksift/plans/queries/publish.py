"""Export gate, public entries, accounting and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import publish
from .. import tables
from .registry import CATALOG, query

HOSTS = ["www.example.org"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified parts as stored results; economy parts lack a release date."""
    return tables.verified(spark, sf_dir).withColumn("confidence", F.round(F.col("confidence") * 1.6, 6)).withColumn(
        "release_date", F.when(~F.array_contains("genres", "economy video game"), F.col("release_date"))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") > 5).alias("active"),
        F.when(F.pmod("p_size", F.lit(3)) == 0, "review").otherwise("done").alias("status"),
    )


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publish.eligible(jobs(spark, sf_dir), results(spark, sf_dir))
    return publish.entries(rows, HOSTS, [])


_ELIGIBLE = f"""{CATALOG},
eligible AS (
  SELECT v.*, round(confidence * 1.6, 6) AS c FROM verified v JOIN catalog USING (id)
  WHERE p_size > 5 AND p_size % 3 <> 0 AND round(confidence * 1.6, 6) >= 0.90)"""


@query(f"""
WITH {_ELIGIBLE}
SELECT id, canonical_title, release_date, genre AS genres, round(c, 4) AS confidence, evidence_url AS evidence,
       checked_at, developer, publisher, 'Microsoft Windows' AS platforms, 'Q' || id AS entity_id
FROM eligible WHERE genre <> 'economy video game'""")
def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public entries of complete, confident results."""
    rows = publish.snapshot(built(spark, sf_dir))
    return rows.select(
        "id", "canonical_title", "release_date", F.array_join("genres", "|").alias("genres"), "confidence",
        F.array_join("evidence_urls", "|").alias("evidence"), "checked_at", "developer", "publisher",
        F.array_join("platforms", "|").alias("platforms"), "entity_id",
    )


@query(f"""
WITH {_ELIGIBLE}
SELECT count(*) AS eligible_rows, count_if(genre <> 'economy video game')::BIGINT AS exported,
       count_if(genre = 'economy video game')::BIGINT AS skipped_incomplete FROM eligible""")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.export_counts(built(spark, sf_dir))


@query(f"""
WITH {CATALOG}, old AS (SELECT id, canonical_title AS title, checked_at FROM verified), new AS (SELECT id, title, post_date AS checked_at FROM catalog WHERE details_ready)
SELECT COALESCE(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old FULL OUTER JOIN new ON old.id = new.id WHERE old.title IS DISTINCT FROM new.title""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between two snapshots, a volatile column aside."""
    old = tables.verified(spark, sf_dir).select("id", F.col("canonical_title").alias("title"), "checked_at")
    new = tables.catalog(spark, sf_dir).filter("details_version = 1").select("id", "title", F.col("post_date").alias("checked_at"))
    return publish.changes(old, new, "id", ignore=["checked_at"])


@query("""
SELECT (SELECT count(*) FROM documents) AS rows, true AS same_rows,
       (SELECT count(DISTINCT lang) FROM documents) = 1 AS same_without_language""")
def snapshot_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes: equal for the same rows in another order, different for changed ones."""
    rows = tables.documents(spark, sf_dir)
    shuffled = rows.repartition("doc_id").withColumn("seen_at", F.current_timestamp())
    changed = rows.withColumn("lang", F.lit("en"))
    a, b, c = (publish.content_hash(df, ["seen_at"]).agg(F.first(F.struct("rows", "content")).alias("h")) for df in (rows, shuffled, changed))
    marked = a.select(F.lit("a").alias("n"), "h").unionByName(b.select(F.lit("b").alias("n"), "h")).unionByName(c.select(F.lit("c").alias("n"), "h"))
    hashes = marked.groupBy().pivot("n", ["a", "b", "c"]).agg(F.first("h"))
    return hashes.select(
        F.col("a.rows").alias("rows"), (F.col("a") == F.col("b")).alias("same_rows"), (F.col("a") == F.col("c")).alias("same_without_language")
    )


@query("""
SELECT 'documents' AS input, 1::INTEGER AS version, count(*) AS rows FROM documents
UNION ALL SELECT 'labels', 1, count(*) FROM labels""")
def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and content hash per input of a gated job; the hash itself has no SQL form."""
    inputs = {"documents": tables.documents(spark, sf_dir), "labels": tables.table(spark, sf_dir, "labels")}
    return publish.input_gate(inputs, 1).select("input", "version", "rows")
