"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of every key in ``order``.

    Spark limits each key to one row per task before the shuffle, so a key that holds
    a large share of all rows sends one row per task, not its whole group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[Column | str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def heads_per_key(
    df: DataFrame, keys: list[str], order: list[Column], key: str, k: int, name: str = "rank", spread: int = 64
) -> DataFrame:
    """``top_per_key`` for deep heads and for few or no keys.

    Every group is first ranked in ``spread`` slices by a hash of the unique ``key``, and
    only the slice heads meet: at most ``spread * k`` rows of a group reach one task.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(spread)))
    slices = top_per_key(sliced, [*keys, "_slice"], order, k, "_first").drop("_first", "_slice")
    return top_per_key(slices, keys, order, k, name)
