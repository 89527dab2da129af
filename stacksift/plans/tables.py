"""Catalog entities read out of the TPC-H-like test tables.

Parts are the catalog: name, brand and type tags, size, and the last shipping date as
post date. A part's verified metadata comes from its shipments: first shipping date,
the supplier as developer and the supplier's nation as publisher. Only parts with a high
enough mean discount are verified, so that some stay unmatched.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETAILS, DETAILS_VERSION, MEDIA, MEDIA_VERSION

NOW = datetime(2001, 1, 15, 12, 0, 0)
LIST_EVENTS = {"purchase": "favorites", "signup": "backlog", "click": "completed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: first and last shipping date, lowest supplier, mean discount, lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("id"))
        .agg(
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.min("l_suppkey").alias("s_suppkey"),
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the shape of stored catalog records."""
    parts = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    shipped = shipments(spark, sf_dir).select("id", "last_ship", "lines")
    even = F.pmod(F.col("p_size"), F.lit(2)) == 0
    described = F.struct(
        F.when(even, F.concat_ws(" ", "p_name", "p_type")).otherwise("").alias("description"),
        F.array("p_type").alias("features"),
        F.array().cast("array<string>").alias("package_features"),
    ).cast(DETAILS)
    media = F.when(
        F.col("p_size") > 25,
        F.array(
            F.struct(
                F.when(even, "gif").otherwise("image").alias("type"),
                F.concat(F.lit("https://media.example.com/"), "id").alias("url"),
                F.lit(None).cast("string").alias("preview_url"),
            )
        ),
    ).cast(MEDIA)
    return parts.join(shipped, "id", "left").select(
        "id",
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://parts.example.com/"), "id", F.lit("/")).alias("source_url"),
        F.when(F.col("p_retailprice") > 1000, F.concat(F.lit("https://img.example.com/"), "id")).alias("image_url"),
        day("last_ship").alias("post_date"),
        F.array("p_brand", "p_type").alias("genres"),
        F.concat(F.col("p_size").cast("string"), F.lit(" GB")).alias("size_text"),
        described.alias("details"),
        F.when(even, DETAILS_VERSION).alias("details_version"),
        day("last_ship").alias("details_checked_at"),
        media.alias("media"),
        F.when(F.col("p_size") > 10, MEDIA_VERSION).otherwise(MEDIA_VERSION - 1).alias("media_version"),
        day("last_ship").alias("media_checked_at"),
    )


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified metadata of the parts that ship more than a set quantity per line."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("canonical_title"), "p_type"
    )
    return (
        shipments(spark, sf_dir)
        .filter(F.col("quantity") >= 25 * F.col("lines"))
        .join(names, "id")
        .join(suppliers.select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
        .join(nations, "s_nationkey")
        .select(
            "id",
            F.lower("canonical_title").alias("canonical_title"),
            day("first_ship").alias("release_date"),
            F.array(F.concat(F.lower("p_type"), F.lit(" video game"))).alias("genres"),
            (F.col("quantity") / (50 * F.col("lines"))).alias("confidence"),
            F.array(F.concat(F.lit("https://www.example.org/wiki/Q"), "id")).alias("evidence_urls"),
            day("last_ship").alias("checked_at"),
            F.col("s_name").alias("developer"),
            F.col("n_name").alias("publisher"),
            F.array(F.lit("Microsoft Windows")).alias("platforms"),
            F.concat(F.lit("Q"), "id").alias("entity_id"),
        )
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User lists from events: purchases, signups and clicks on the item in ``props.k``."""
    kinds = F.create_map(*[F.lit(x) for pair in LIST_EVENTS.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            F.element_at(kinds, F.col("event_type")).alias("list"),
            F.get_json_object("props", "$.k").alias("id"),
        )
        .filter(F.col("list").isNotNull() & F.col("id").isNotNull())
        .distinct()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores when it has fewer splits than there are cores.

    A table in one small file is one task; its texts are costly enough to share out. A
    table in many files has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts for queries that work long on each title."""
    return spread(table(spark, sf_dir, "part"))
