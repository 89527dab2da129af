"""Joins whose keys may be very unequal: keys with many rows are split by measured counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of one key that go to one task.
MOST = 20_000
PARTS, SALT = "_parts", "_salt"


def hot_keys(rows: DataFrame, on: list[str], most: int = MOST) -> DataFrame:
    """Keys with more than ``most`` rows and the parts they are cut into; at most rows / ``most`` of them."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return counts.select(*on, F.ceil(F.col("_n") / most).cast("int").alias(PARTS))


def salted_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", most: int = MOST) -> DataFrame:
    """``many`` joined with ``few`` on the columns ``on``; ``how`` is inner, left, left_semi or left_anti.

    Rows of ``many`` with a hot key are dealt to its parts by their values, and the rows of
    ``few`` with that key are copied to each part, so a part has at most about ``most`` rows of
    ``many`` unless rows are equal in all columns. Other keys have one part.
    """
    hot = cut_lineage(hot_keys(many, on, most))
    if hot.isEmpty():
        return many.join(few, on, how)
    # One row per hot key; null keys meet nothing in an inner join of keys, so they are matched as equal.
    named = hot.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], PARTS)

    def with_parts(side: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(on):
            same = same & side[c].eqNullSafe(named[f"_k{i}"])
        kept = [side[c] for c in side.columns]
        return side.join(named, same, "left").select(*kept, F.coalesce(F.col(PARTS), F.lit(1)).alias(PARTS))

    # By all values of a row, so that a task that runs again deals it the same way.
    value = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in many.columns])))
    dealt = with_parts(many).withColumn(SALT, F.pmod(value, F.col(PARTS)).cast("int")).drop(PARTS)
    copied = with_parts(few).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col(PARTS) - 1))).drop(PARTS)
    return dealt.join(copied, [*on, SALT], how).drop(SALT)
