"""Watch a feed for posts that the catalog does not have yet."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import post_url, with_slash
from ..operators.merge import new_arrivals
from ..sources.folders import path_exists


def catalog_urls(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.coalesce("source_url", F.lit("")) != "").select(with_slash("source_url").alias("url"))


def watch_feed(
    feed: DataFrame,
    catalog: Callable[[SparkSession], DataFrame],
    table: str,
    checkpoint: str,
    link: str = "link",
    host: str | None = None,
) -> None:
    """Append new post urls of a feed stream to ``table``, each once.

    The catalog is read again for every batch. A url that an earlier batch reported is
    not reported again; a batch that is run again replaces its own folder. Streams with
    different checkpoints write folders of their own and read each other's.
    """
    run = zlib.crc32(checkpoint.encode())

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        urls = batch.select(post_url(link, host).alias("url")).filter(F.col("url").isNotNull()).distinct()
        fresh = new_arrivals(urls, catalog_urls(catalog(spark)))
        if path_exists(spark, table):
            own_later = (F.col("run") == run) & (F.col("batch_id") >= number)
            reported = spark.read.parquet(table).filter(~own_later)
            fresh = fresh.join(reported.select("url"), "url", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/run={run}/batch_id={number}")

    query = (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
