"""Sorted results that are stored once and paged by seeking.

A run is a result in its total order, cut into parts of about ``ROWS`` rows, each in a folder
of its own, beside a table of parts with the number of their first row. A page reads the one
or two parts that hold it, however deep it is, and the neighbours of a row at most three.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 100_000
PART, POS = "_part", "_pos"
PARTS = "part int, first bigint, rows bigint"


def write_run(rows: DataFrame, order: list[Column], path: str, size: int = ROWS) -> None:
    """Store ``rows`` in ``order``, which must be total, under a new ``path``."""
    parts = max(1, -(-rows.count() // size))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged.select("*", F.spark_partition_id().alias(PART), place.alias(POS)).write.partitionBy(PART).parquet(f"{path}/rows")
    # Beside the parts, for runs without any.
    rows.sparkSession.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/empty")
    counts = rows.sparkSession.read.schema(f"{PART} int").parquet(f"{path}/rows").groupBy(F.col(PART).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")  # a row per part
    counts.select("part", before.alias("first"), "rows").coalesce(1).write.parquet(f"{path}/parts")


def run_rows(spark: SparkSession, path: str) -> int:
    return spark.read.schema(PARTS).parquet(f"{path}/parts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def rows_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of a run, both included, with their number as ``ordinal``."""
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts")
    held = parts.filter((F.col("first") <= last) & (F.col("first") + F.col("rows") > first)).collect()
    if not held:
        return spark.read.parquet(f"{path}/empty").withColumn("ordinal", F.lit(None).cast("long"))
    # A page has one or two parts, and only their folders are listed and read.
    stored = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{PART}={p['part']}" for p in held])
    wanted, ordinal = F.lit(False), F.lit(None).cast("long")
    for p in held:
        here = F.col(PART) == p["part"]
        wanted = wanted | (here & F.col(POS).between(max(0, first - p["first"]), last - p["first"]))
        ordinal = F.when(here, F.col(POS) + p["first"]).otherwise(ordinal)
    return stored.filter(wanted).withColumn("ordinal", ordinal).drop(PART, POS)


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` of a run, counted from 0, in order; empty beyond the end."""
    return rows_between(spark, path, number * size, (number + 1) * size - 1).orderBy("ordinal")


def neighbours(spark: SparkSession, path: str, ordinal: int, key: str) -> DataFrame:
    """``previous_key`` and ``next_key`` of a row of a run, wrapping at both ends; one row."""
    total = run_rows(spark, path)
    if not 0 <= ordinal < total:
        raise IndexError(f"row {ordinal} of {total}")
    names = ("previous_key", "next_key")
    found = None
    for name, at in zip(names, ((ordinal - 1) % total, (ordinal + 1) % total)):
        row = rows_between(spark, path, at, at).select(F.lit(name).alias("side"), F.col(key).alias("value"))
        found = row if found is None else found.unionByName(row)
    return found.agg(*[F.max(F.when(F.col("side") == n, F.col("value"))).alias(n) for n in names])


def stored_run(rows: DataFrame, order: list[Column], folder: str, size: int = ROWS) -> str:
    """Store ``rows`` below ``folder`` and return the path of the run."""
    path = f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"
    write_run(rows, order, path, size)
    return path
