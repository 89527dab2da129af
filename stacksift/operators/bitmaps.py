"""Tag filters and facets on bitmaps of row numbers.

Rows are numbered from 0, and the numbers of the rows that have a key are bitmaps of 32,768
bits, one for each range in which the key occurs at all. A selection of keys is the bitwise
and of their bitmaps, range by range; a range that one of the keys lacks is empty. Facets
count the bits that a selection shares with the bitmap of every other key, so the rows of a
pool are never exploded, and many selections are answered in one job: selections and keys
meet in batches within their range.

Tags and yes-or-no properties of rows are keys alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bitmaps of one batch, 4 kB each.
BATCH = 256
BITS = 32_768
BYTES = BITS // 8


def key_bitmaps(rows: DataFrame, ordinal: str, keys: Column) -> DataFrame:
    """``key, range, bitmap`` out of rows with a number and an array of keys."""
    number = F.col(ordinal).cast("long") + 1  # ranges and bits of Spark's bitmaps count from 1
    each = rows.select(number.alias("_n"), F.explode(F.array_distinct(keys)).alias("key"))
    grouped = each.groupBy("key", (F.bitmap_bucket_number("_n") - 1).alias("range"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bitmap"))


def all_rows(rows: DataFrame, ordinal: str, key: str = "") -> DataFrame:
    """The bitmaps of a key that every row has, for selections without any key."""
    return key_bitmaps(rows, ordinal, F.array(F.lit(key)))


def pools(bitmaps: DataFrame, selections: DataFrame) -> DataFrame:
    """``selection, range, bitmap`` of the rows that have all ``keys`` of a selection; empty ranges are left out.

    Unknown keys make a selection empty. A selection without keys selects nothing.
    """
    wanted = selections.select("selection", F.array_distinct("keys").alias("keys"))
    each = wanted.select("selection", F.size("keys").alias("_n"), F.explode("keys").alias("key"))
    met = each.join(bitmaps, "key").groupBy("selection", "range").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_found"), F.max("_n").alias("_n")
    )
    return met.filter((F.col("_found") == F.col("_n")) & (F.bitmap_count("bitmap") > 0)).select("selection", "range", "bitmap")


def pool_sizes(pool: DataFrame) -> DataFrame:
    return pool.groupBy("selection").agg(F.sum(F.bitmap_count("bitmap")).alias("rows"))


def _batches(bitmaps: DataFrame, name: str, to: str) -> DataFrame:
    """Bitmaps of a range in batches of about ``BATCH``, as arrays of names and bitmaps."""
    fullest = bitmaps.groupBy("range").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    part = F.pmod(F.xxhash64(name), F.lit(-(-fullest // BATCH)))
    grouped = bitmaps.groupBy("range", part.alias("_p"))
    return grouped.agg(F.collect_list(F.struct(F.col(name).alias("name"), "bitmap")).alias(to)).select("range", to)


def facets(pool: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``selection, key, rows``: how many rows of a selection have each key, where any has."""

    def words(column) -> np.ndarray:
        data = b"".join(x.ljust(BYTES, b"\0") for x in column.field("bitmap").to_pylist())
        return np.frombuffer(data, "<u8").reshape(-1, BYTES // 8)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s, t in zip(batch.column(0), batch.column(1)):
                one, two = words(s.values), words(t.values)
                names, keys = s.values.field("name"), t.values.field("name")
                for i, mine in enumerate(one):
                    both = np.bitwise_count(mine & two).sum(1)
                    at = np.flatnonzero(both)
                    if len(at):
                        selection = pa.array([names[i].as_py()] * len(at), names.type)
                        yield pa.RecordBatch.from_arrays([selection, keys.take(pa.array(at)), pa.array(both[at].astype(np.int64))], names=["selection", "key", "rows"])

    met = _batches(pool, "selection", "s").join(_batches(bitmaps, "key", "t"), "range").select("s", "t")
    kind = {f.name: f.dataType.simpleString() for f in pool.schema.fields}["selection"]
    found = met.mapInArrow(run, f"selection {kind}, key string, rows long")
    return found.groupBy("selection", "key").agg(F.sum("rows").alias("rows"))


def selected_rows(pool: DataFrame) -> DataFrame:
    """``selection, ordinal`` of every selected row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, number, bitmap in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) + number * BITS
                names = pa.array([name.as_py()] * len(at), name.type)
                yield pa.RecordBatch.from_arrays([names, pa.array(at.astype(np.int64))], names=["selection", "ordinal"])

    kind = {f.name: f.dataType.simpleString() for f in pool.schema.fields}["selection"]
    return pool.select("selection", "range", "bitmap").mapInArrow(run, f"selection {kind}, ordinal long")
