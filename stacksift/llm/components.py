"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds are logarithmic in the number of nodes; this only stops a loop that is broken.
MOST_ROUNDS = 60


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _roots(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.written_to = edges.written_to  # so that it can be discarded
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node it reaches.

    Each round hooks larger neighbours of a node to its smallest one, then smaller ones and
    the node itself. Every link gives one row per round, however many a node has; minima
    are combined before the shuffle. Rounds are written to the shared folder. Links with a
    null end and links of a node to itself make no difference.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.filter((F.col("a") != F.col("b")) & links["a"].isNotNull() & links["b"].isNotNull()).distinct(), "links")
    before = _state(edges)
    if not before[0]:
        return _roots(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        hooked = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        older, edges = edges, written(hooked.filter("a <> b").distinct(), "links")
        discard(older)
        after = _state(edges)
        if after == before:
            return _roots(edges)
        before = after
    raise RuntimeError("components did not settle")
