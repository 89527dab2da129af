"""Exact top-k by block-at-a-time pruning.

Vectors are sparse rows of integer term weights in principle; here every component is a
term. Rows are sorted by their strongest term and cut into ranges of ``BLOCK`` rows, with
the largest and smallest weight of every term per block; ``SHARD`` rows are one shard, which
carries its blocks' weights as a forward index. A block's bound for a query is the sum over
the terms of what its extremes allow.

Queries, in batches, meet every shard: the blocks of a shard are taken in the order of their
bounds, and a query is done with the shard once the bounds fall below its k-th score. Blocks
whose bound equals the k-th score are still read, for ties. Shards are searched in two waves;
the second starts from the k-th scores of the first, and a task keeps the k-th scores of a
batch from shard to shard. Few queries are sent to all executors; else shards are dealt to groups
and a batch is shuffled once to each group, so the driver never holds more than ``MOST_SENT`` bytes of them.

Scores are integers and exact: 64-bit sums, taken in double precision where all partial sums
stay below 2 ** 53. Vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; missing components count zero. Every row stands for itself:
of rows with equal ids each asks on its own, and a row with the query's id is a candidate if
it is another row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 256
SHARD = 4096
#: Queries in a batch.
BATCH = 1024
#: Shards of the first wave: one in so many.
FIRST = 8
#: Bytes of queries up to which all of them are sent to all executors; more are dealt by shuffles.
MOST_SENT = 4 << 20
SCALE = 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite, F.lit(False))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of int64 from an Arrow column of lists, shorter ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return lists.flatten().to_numpy().reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, x in enumerate(lists.to_pylist()):
        out[i, : len(x)] = x
    return out


def _extremes(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(rows), size)
    return np.maximum.reduceat(rows, at), np.minimum.reduceat(rows, at)


def _pack(items: list[tuple], kinds: list):
    import pyarrow as pa

    names = [n for n, _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array([i[c] for i in items], t) for c, (_, t) in enumerate(kinds)], names=names)


SHARDS = "slot int, wave int, rows binary, ids binary, weights binary"


def shards(held: DataFrame, width: int, size: int, slots: int) -> DataFrame:
    """Rows (row, vec_id, v), in the order they come, as shards of up to ``size``."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [("slot", pa.int32()), ("wave", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("weights", pa.binary())]
        number = TaskContext.get().partitionId() * 7919
        rows, ids, weights = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.int64)

        def out(n: int):
            return _pack([(number % slots, number // slots % FIRST, rows[:n].tobytes(), ids[:n].tobytes(), weights[:n].tobytes())], kinds)

        for batch in batches:
            rows, ids = np.r_[rows, batch.column(0).to_numpy()], np.r_[ids, batch.column(1).to_numpy()]
            weights = np.concatenate([weights, _matrix(batch.column(2), width)])
            while len(ids) >= size:
                yield out(size)
                rows, ids, weights, number = rows[size:], ids[size:], weights[size:], number + 1
        if len(ids):
            yield out(len(ids))

    return held.select("row", "vec_id", "v").mapInArrow(run, SHARDS)


ASKS = "asks binary, names binary, queries binary, least binary"


def ask_batches(queries: DataFrame, width: int) -> DataFrame:
    """Queries (row, vec_id, v, least) in batches."""

    def run(batches):
        import pyarrow as pa

        kinds = [("asks", pa.binary()), ("names", pa.binary()), ("queries", pa.binary()), ("least", pa.binary())]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows, ids, least = (batch.column(i).to_numpy().tobytes() for i in (0, 1, 3))
                yield _pack([(rows, ids, _matrix(batch.column(2), width).tobytes(), least)], kinds)

    return queries.select("row", "vec_id", "v", "least").mapInArrow(run, ASKS)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``b``, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries in blocks with these extremes."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


def top_in_shard(
    asks: np.ndarray, queries: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int,
    block: int = BLOCK,
) -> list[list[tuple[int, int, int]]]:
    """Per query up to ``k`` (-score, id, row) of a shard that may be among its best; ``least`` is a known lower bound."""
    high, low = _extremes(weights, block)
    bound = bounds(queries, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    best: list[list[tuple[int, int, int]]] = [[] for _ in asks]
    kth = least.astype(np.float64).copy()
    live = np.arange(len(asks))
    for place in range(bound.shape[1]):
        at = order[live, place]
        open_ = bound[live, at] >= kth[live]
        live, at = live[open_], at[open_]
        for b in np.unique(at):
            who = live[at == b]
            here = slice(b * block, (b + 1) * block)
            score = _product(queries[who], weights[here])
            near = score >= kth[who, None]
            near &= rows[here][None, :] != asks[who, None]
            for i in np.flatnonzero(near.any(1)):
                q, found = who[i], np.flatnonzero(near[i])
                if len(found) > 4 * k:  # of many, the k-th and its ties
                    cut = np.partition(score[i, found], len(found) - k)[len(found) - k]
                    found = found[score[i, found] >= cut]
                merged = sorted(best[q] + [(-int(s), int(d), int(r)) for s, d, r in zip(score[i, found], ids[here][found], rows[here][found])])[:k]
                best[q] = merged
                if len(merged) == k:
                    kth[q] = max(kth[q], -merged[-1][0])
        if not len(live):
            break
    return best


def _of(column, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(column, kind)


FOUND = "query long, query_id long, vec_id long, row long, score long"
#: Below any score.
NOTHING = -(2**62)


def _search(asks: DataFrame, size: int, held: DataFrame, slots: int, width: int, k: int) -> DataFrame:
    """Rows of shards that may be among the ``k`` best of the queries, which have ``size`` bytes."""

    def run(batches):
        import pyarrow as pa

        kinds = [(c.split()[0], pa.int64()) for c in FOUND.split(", ")]
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key, names, queries, least, rows, ids, weights = (c[i].as_py() for c in batch.columns)
                asks = _of(key)
                if len(known) > 256:
                    known.clear()
                least = known.setdefault(key, _of(least).copy())
                found = top_in_shard(asks, _of(queries).reshape(-1, width), least, _of(rows), _of(ids), _of(weights).reshape(-1, width), k, BLOCK)
                out = []
                for q, (ask, name, best) in enumerate(zip(asks, _of(names), found)):
                    out += [(int(ask), int(name), d, r, -s) for s, d, r in best]
                    if len(best) == k:
                        least[q] = max(least[q], -best[-1][0])
                if out:
                    yield _pack(out, kinds)

    if size <= MOST_SENT:
        # Once each, since what is sent goes through the driver.
        met = held.crossJoin(F.broadcast(asks))
    else:
        # Files of integers are far smaller than their rows, so Spark must not decide by them to send either side.
        copies = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        met = held.hint("merge").join(copies.hint("merge"), "slot")
    return met.select("asks", "names", "queries", "least", "rows", "ids", "weights").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every query row of (vec_id, embedding)."""
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    good = written(good, "quantised")
    facts = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("asks")).first()
    width, count = facts["width"] or 1, facts["n"]
    # The strongest term and its sign: rows alike come into one block, whose extremes are then tight.
    size = F.transform("v", lambda x: F.abs(x))
    term = F.array_position(size, F.array_max(size))
    strongest = term * 2 + (F.element_at("v", F.greatest(term, F.lit(1)).cast("int")) < 0).cast("long")
    # A vector without components has no strongest term.
    strongest = F.when(F.size("v") > 0, strongest).otherwise(F.lit(0))
    ordered = good.withColumn("_term", strongest).repartitionByRange(max(1, -(-count // (2 * shard))), "_term", "row")
    slots = max(1, min(-(-count // shard), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    held = written(shards(ordered.sortWithinPartitions("_term", "row"), width, shard, slots), "shards")

    parts = max(1, -(-facts["asks"] // (8 * BATCH)))
    # Per query its numbers and its weights, 8 bytes each.
    sent = facts["asks"] * 8 * (width + 3)
    asking = good.filter("asks").select("row", "vec_id", "v").repartition(parts, "row")
    asks = written(ask_batches(asking.withColumn("least", F.lit(NOTHING)), width), "queries")
    early = written(_best(_search(asks, sent, held.filter("wave = 0"), slots, width, k), k), "first-wave")
    kth = early.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("_kth"))
    known = asking.join(kth, "row", "left").withColumn("least", F.coalesce("_kth", F.lit(NOTHING)))
    asks = written(ask_batches(known, width), "queries")
    late = _search(asks, sent, held.filter("wave > 0"), slots, width, k)
    best = _best(early.drop("rank").unionByName(late), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
