"""Dense positions in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_part`` and ``_pos``; materialized."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    )


def with_ordinals(df: DataFrame, order: list[Column], name: str = "ordinal", start: int = 0) -> DataFrame:
    """Number the rows of ``df`` in ``order``, which must be total (end it with a key).

    Rows are range-partitioned and sorted; the sorted rows are materialized once, because
    range bounds are sampled and may differ between two runs of the same plan. Every row
    then adds the sizes of the partitions before its own. Only the partition sizes, one
    row per partition, go through a single-task window.
    """
    fixed = _ranged(df, order)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_offset"),
    )
    row_in_part = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row_in_part + start)
        .drop("_part", "_pos", "_offset")
    )


def with_neighbours(df: DataFrame, order: list[Column], key: str) -> DataFrame:
    """Previous and next key in the result order, wrapping at both ends.

    Inside a sorted partition they are its neighbouring rows; the first and last rows of
    partitions get theirs from a table of edges, one row per partition.
    """
    fixed = _ranged(df, order)
    inside = Window.partitionBy("_part").orderBy("_pos")
    rows = fixed.withColumn("previous_key", F.lag(key).over(inside)).withColumn("next_key", F.lead(key).over(inside))
    edges = fixed.groupBy("_part").agg(F.min_by(key, "_pos").alias("low"), F.max_by(key, "_pos").alias("high"))
    across = Window.orderBy("_part")
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "_part",
        F.coalesce(F.lag("high").over(across), F.last("high").over(every)).alias("_before"),
        F.coalesce(F.lead("low").over(across), F.first("low").over(every)).alias("_after"),
    )
    joined = rows.join(F.broadcast(edges), "_part")
    return joined.withColumns(
        {"previous_key": F.coalesce("previous_key", "_before"), "next_key": F.coalesce("next_key", "_after")}
    ).drop("_part", "_pos", "_before", "_after")


#: Rows up to which a page is the end of a sorted head; see ``sources.sort_runs`` for results that are paged often.
HEAD = 10_000


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order. A sorted head is one task; a long one is taken by ordinals and stays in its ranges."""
    if n <= HEAD:
        return df.orderBy(*order).limit(n)
    return with_ordinals(df, order, "_ordinal").filter(F.col("_ordinal") < n).drop("_ordinal")


def page(df: DataFrame, order: list[Column], number: int, size: int = 30) -> DataFrame:
    """One page of a sorted result; pages count from 0. Deep pages cost one sort of the whole."""
    if (number + 1) * size <= HEAD:
        return df.orderBy(*order).limit((number + 1) * size).offset(number * size)
    numbered = with_ordinals(df, order, "_ordinal")
    first = number * size
    return numbered.filter(F.col("_ordinal").between(first, first + size - 1)).orderBy("_ordinal").drop("_ordinal")


def shards(df: DataFrame, order: list[Column], count: int) -> DataFrame:
    """Deal ordered work round-robin over ``count`` shards."""
    numbered = with_ordinals(df, order)
    return numbered.withColumn("shard", F.pmod(F.col("ordinal"), F.lit(count)).cast("int"))


def key_batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Distinct keys in order, ``size`` to a batch."""
    numbered = with_ordinals(df.select(key).distinct(), [F.col(key)])
    batch = F.floor(F.col("ordinal") / size).cast("long")
    return (
        numbered.groupBy(batch.alias("batch"))
        .agg(F.sort_array(F.collect_list(key)).alias("keys"))
        .withColumn("size", F.size("keys"))
    )
