"""Readers for catalogs, side tables, snapshots, feeds, libraries and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_text
from ..functions.urls import post_url
from ..operators.dedupe import first_per_key
from ..schemas import CATALOG, LIBRARY


def read_catalog(
    spark: SparkSession, path: str, rows: str = "games", schema: str = CATALOG, rename: dict[str, str] = {}
) -> DataFrame:
    """Records of a JSON catalog: an envelope with a list of records, or a bare list.

    ``rename`` maps our field names to those of the file. An envelope is one JSON value
    and is parsed by one task, so large catalogs should be stored as JSON lines or Parquet
    and read with ``spark.read`` directly.
    """
    kept = [f for f in spark.createDataFrame([], schema).schema]
    source = ", ".join(f"`{rename.get(f.name, f.name)}` {f.dataType.simpleString()}" for f in kept)
    raw = spark.read.schema(f"`{rows}` array<struct<{source.replace('` ', '`:')}>>, {source}").json(path, multiLine=True)
    nested = raw.filter(F.col(rows).isNotNull()).select(F.explode(rows).alias("r")).select("r.*")
    bare = raw.filter(F.col(rows).isNull()).drop(rows)
    both = nested.unionByName(bare)
    return both.select(*[F.col(rename.get(f.name, f.name)).alias(f.name) for f in kept])


def read_envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Envelope fields of a JSON file, without its records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def usable(records: DataFrame) -> DataFrame:
    """Strict variant: rows without id or title are dropped."""
    return records.filter((strip_text("id") != "") & (strip_text("title") != ""))


def read_tolerant(spark: SparkSession, path: str, schema: str, rows: str = "entries") -> DataFrame:
    """A side table that may be missing, unreadable or of another shape: then it is empty."""
    empty = spark.createDataFrame([], schema)
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in empty.schema)
    try:
        raw = spark.read.schema(f"`{rows}` array<struct<{fields}>>, _bad string").json(
            path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad"
        )
    except Exception as error:  # a missing path is reported when the reader is built
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    good = raw.filter(F.col("_bad").isNull() & F.col(rows).isNotNull())
    return good.select(F.explode(rows).alias("r")).select("r.*").filter(F.col(empty.columns[0]).isNotNull())


def read_snapshot(spark: SparkSession, path: str, version: int, version_field: str, entry: str, rows: str = "games") -> DataFrame:
    """Entries of a versioned snapshot, keyed by ``id``.

    Fails on a wrong version or when the declared count differs from the entries present.
    """
    schema = f"`{version_field}` int, count bigint, generated_at string, `{rows}` map<string,struct<{entry}>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    declared = raw.select(version_field, "count", F.size(rows).alias("present")).first()
    if declared is None or declared[version_field] != version:
        raise ValueError("snapshot has an unsupported version")
    if declared["present"] < 0:
        raise ValueError(f"snapshot must contain {rows}")
    if declared["count"] != declared["present"]:
        raise ValueError("snapshot count mismatch")
    flat = raw.select("generated_at", F.explode(rows).alias("id", "entry"))
    return flat.filter((F.trim("id") != "") & F.col("entry").isNotNull()).select("id", "entry.*", "generated_at")


def read_feed(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Post urls of an RSS or Atom feed in feed order, first seen only: ``position, url``."""
    rss = _feed_items(spark, path, "item", "link string", F.col("link"))
    atom = _feed_items(spark, path, "entry", "link array<struct<_href:string,_VALUE:string>>",
                       F.coalesce(F.expr("link[0]._href"), F.expr("link[0]._VALUE")))
    links = rss.unionByName(atom).withColumn("url", post_url("link", host)).filter(F.col("url").isNotNull())
    order = [F.col("file"), F.col("position")]
    return first_per_key(links, ["url"], order).select("position", "url")


def _feed_items(spark: SparkSession, path: str, tag: str, schema: str, link) -> DataFrame:
    # Items of one file are read by one task in file order, so the row id orders them.
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return raw.select(
        link.alias("link"), F.monotonically_increasing_id().alias("position"), F.input_file_name().alias("file")
    )


LIBRARY_LISTS = ["favorites", "backlog", "completed"]


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Exported libraries as ``user_id, list, id``; the user is the folder ``user_id=``, or else the file."""
    schema = "version int, exported_at string, " + ", ".join(f"{n} array<string>" for n in LIBRARY_LISTS)
    raw = spark.read.schema(schema).json(path, multiLine=True).drop("user_id")
    name = F.input_file_name()
    named = F.nullif(F.regexp_extract(name, r"/user_id=([^/]+)/", 1), F.lit(""))
    user = F.coalesce(named, F.regexp_extract(name, r"([^/]+?)(?:\.[^./]*)?$", 1))
    lists = F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("ids")) for n in LIBRARY_LISTS])
    flat = raw.select(user.alias("user_id"), F.explode(lists).alias("l"))
    return flat.select("user_id", "l.list", F.explode("l.ids").alias("id")).distinct()


def library_export(library: DataFrame, exported_at: str, version: int = 2) -> DataFrame:
    """One JSON document per user."""
    lists = [
        F.array_sort(F.collect_set(F.when(F.col("list") == n, F.col("id")))).alias(n) for n in LIBRARY_LISTS
    ]
    packed = library.groupBy("user_id").agg(*lists)
    body = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(exported_at).alias("exported_at"), *LIBRARY_LISTS))
    return packed.select("user_id", body.alias("value"))


def empty_library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LIBRARY)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from CSV with a header: tier, priority, pattern, reason."""
    schema = "tier string, priority int, pattern string, reason string"
    return spark.read.schema(schema).csv(path, header=True, escape='"', quote='"')
