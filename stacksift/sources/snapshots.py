"""Writers: generations of state tables, snapshots, detail files and change-only output."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import detail_name
from ..operators.dedupe import repeated_keys
from ..operators.publish import content_hash
from . import deltas
from .folders import delete_folder, path_exists


POINTER = "generation int, folder string, written_at timestamp, rows bigint, content string"
#: Generations that stay, for readers that have begun.
KEPT = 4
#: Records in a detail file, about.
DETAIL_ROWS = 50_000


def _pointer(root: str) -> str:
    return f"{root}/pointer"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(POINTER).parquet(_pointer(root))


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the current generation; ``(0, None)`` before the first write."""
    if not path_exists(spark, _pointer(root)):
        return 0, None
    # Of two writers of one generation, the one with the smaller folder name holds it.
    held = _pointers(spark, root).groupBy("generation").agg(F.min("folder").alias("folder"))
    newest = held.agg(F.max(F.struct("generation", "folder")).alias("n")).first()["n"]
    return (newest["generation"], f"{root}/{newest['folder']}") if newest else (0, None)


def read_current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The current generation of a state table, or the newest rows of a log of deltas; empty before the first write."""
    if deltas.is_log(spark, root):
        return deltas.read(spark, root, schema)
    _, folder = current(spark, root)
    return spark.read.parquet(folder) if folder else spark.createDataFrame([], schema)


def publish(df: DataFrame, root: str, now: datetime, ignore: list[str] = (), partition_by: list[str] = ()) -> bool:
    """Write a new generation, unless the current one holds the same rows.

    Rows go into a folder of their own first and are hashed there, so ``df`` is computed
    once; readers see them once the pointer row is added. The content hash is kept with the
    pointer, so the old rows are not read again. Of two writers that start from the same
    generation one fails. Folders older than ``KEPT`` generations are deleted. Returns
    whether a new generation was published.
    """
    spark = df.sparkSession
    number, folder = current(spark, root)
    name = f"generation-{number + 1}-{uuid.uuid4().hex}"
    target = f"{root}/{name}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(target)
    measured = content_hash(spark.read.parquet(target), list(ignore)).first()
    if folder:
        known = _pointers(spark, root).filter(F.concat(F.lit(f"{root}/"), "folder") == folder).select("rows", "content").first()
        if measured == known:
            delete_folder(spark, target)
            return False
    pointer = spark.createDataFrame([(number + 1, name, now, measured["rows"], measured["content"])], POINTER)
    pointer.write.mode("append").parquet(_pointer(root))
    if current(spark, root)[1] != target:
        raise RuntimeError(f"another writer published generation {number + 1} of {root}")
    for old in _pointers(spark, root).filter(F.col("generation") <= number + 1 - KEPT).select("folder").collect():
        delete_folder(spark, f"{root}/{old['folder']}")
    return True


def write_details(records: DataFrame, path: str) -> None:
    """Full records as JSON, named by the hash of their id and spread over 256 folders.

    Fails when two ids share a name.
    """
    named = records.withColumn("name", detail_name("id"))
    clash = repeated_keys(named.select("name", "id").distinct(), ["name"]).limit(1).collect()
    if clash:
        raise ValueError(f"detail name collision: {clash[0]['name']}")
    body = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    out = named.select("name", F.left("name", F.lit(2)).alias("shard"), body.alias("value"))
    # Files per shard follow the rows, so that no task writes more than a part of a shard.
    salts = 1 + records.count() // (256 * DETAIL_ROWS)
    salt = F.pmod(F.xxhash64("name"), F.lit(salts))
    out.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").json(path)


def write_json_lines(rows: DataFrame, path: str, envelope: dict) -> None:
    """Rows as compact JSON lines, and the envelope fields with the row count beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    spark = rows.sparkSession
    count = spark.read.text(f"{path}/rows").count()
    line = json.dumps({**envelope, "count": count}, ensure_ascii=False, separators=(",", ":"))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/envelope")
