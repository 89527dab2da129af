"""Approximate nearest neighbours by neighbour descent and greedy graph search.

Vectors that are equal are one node. A graph of the ``K`` nearest known neighbours of every
node starts from random groups and is improved by rounds of joins: the neighbours of a
node, in both directions, are compared with each other, and every node keeps the best it
has met. Only pairs with an edge that is new since the last round are looked at. Rounds end
when few edges change, however many it takes.

A search keeps the best nodes that a query has met and opens the nearest ones that are not
opened yet, all queries in step, until the best are open; it starts from the query and the
``LONGEST`` longest nodes. Vectors have single precision there, on a scale that a few long ones
do not set, and one more component that makes the lengths up to that scale equal: the graph
links the nearest by squared distance, in double precision, and a query, whose own component
is zero, ranks them by inner product. What is found is scored again exactly, in double precision.

Nodes are dealt to buckets by hash, and a bucket's nodes, vectors and edges are arrays in one row. Buckets
send each other arrays too: a vector goes once to every bucket that asks for it, and of a search pairs of a
query and a node go to the shard of the node, where the vectors of the queries are sent once a round. So no
vector is shuffled per pair, and none goes through the driver; a task holds what one bucket of ``BUCKET``
nodes or one shard of ``SHARD`` nodes gets. Only the exact scores at the end send the vectors to all
executors, up to ``MOST_SENT`` bytes; beyond it they are joined by shuffles.

Rows without an id and vectors that are null, zero or hold null or non-finite components take no part; vectors
with fewer components than others count zeros for the rest. Of rows with equal ids each is a
row of its own, as query and as candidate. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sent_if_small, small_batches, written

K = 40
#: Neighbours in the other direction that a node takes part with.
REVERSE = 32
#: Random groups that the graph starts from, and their size.
START_GROUPS, GROUP = 3, 1024
#: Rounds end when this share of the edges is new, or less.
SETTLED = 0.02
#: Pairs that a node gets out of one comparison at most.
BEST = 6
#: Nodes that a query keeps, and opens at once.
KEEP, OPEN = 192, 64
#: Longest nodes that every search meets first.
LONGEST = 64
#: The scale is at most so many times the length that this share of the nodes has at most.
SPREAD, USUAL = 2.0, 0.99
#: Found nodes that are scored exactly.
RESCORED = 64
#: Vectors that may be sent to all executors, in bytes.
MOST_SENT = 64 << 20
BATCH = 8192


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


class Vectors:
    """Nodes with their single-precision vectors, and how to join them."""

    def __init__(self, nodes: DataFrame) -> None:
        """``nodes``: (node, embedding), one row per different vector."""
        squared = _dot(F.col("embedding"), F.col("embedding"))
        facts = nodes.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"),
            F.max(squared).alias("longest"), F.percentile_approx(squared, USUAL, 1000).alias("usual"),
        ).first()
        self.count, self.width = facts["n"], (facts["width"] or 0) + 1
        # Longer rows get no further component, and stay as long as they are.
        scale, width = min(facts["longest"] or 1.0, SPREAD**2 * (facts["usual"] or 1.0)), self.width
        longest = nodes.orderBy(squared.desc(), "node").limit(LONGEST).select("node")
        small_batches(nodes.sparkSession, BATCH)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for x in batch.column(1).to_pylist():
                    v = np.zeros(width)
                    v[: len(x)] = x
                    v[-1] = np.sqrt(max(scale - v @ v, 0.0))
                    out.append((v / np.sqrt(scale)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "vec"])

        self.rows = written(nodes.select("node", "embedding").mapInArrow(run, "node long, vec binary"), "vectors")
        self.longest = written(longest, "longest")
        self.sent = self.count * (4 * self.width + 32) <= MOST_SENT


def closeness(vecs: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs of rows; of rows of the same length this orders as their products do."""
    lengths = np.einsum("ij,ij->i", vecs, vecs)
    return 2 * (vecs @ vecs.T) - lengths[:, None] - lengths[None, :]


#: Nodes of a bucket of the graph and of a shard of the search; entries of a message, and bytes that a task hands on at once.
BUCKET, SHARD, ENTRIES, HANDED = 8192, 1 << 16, 1 << 14, 4 << 20
MESSAGES = "to int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, n long, of long"


def owner(nodes: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The bucket of every node, out of ``parts``."""
    mixed = (nodes.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _sent(to: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of ``columns`` as messages to the buckets ``to``."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True]) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        for at in range(a, b, ENTRIES):
            rows = order[at : min(at + ENTRIES, b)]
            yield (int(to[rows[0]]), kind, *(c[rows] for c in columns))


def _messages(rows) -> Iterator:
    """Arrow batches of messages ``(to, kind, arrays...)``; a dictionary at the end has ``n`` and ``of``."""
    import pyarrow as pa

    names = [c.split()[0] for c in MESSAGES.split(", ")]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6 + [pa.int64()] * 2
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    for row in rows:
        counts = row[-1] if isinstance(row[-1], dict) else {}
        blobs = [np.ascontiguousarray(x).tobytes() for x in row[2:] if not isinstance(x, dict)]
        held.append((row[0], row[1], *blobs, *[None] * (6 - len(blobs)), counts.get("n", 0), counts.get("of", 0)))
        size += sum(map(len, blobs))
        if size >= HANDED:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _received(batches) -> Iterator[tuple[int, Iterator]]:
    """Per bucket its messages ``(kind, [buffers])``, in the order they come."""
    from itertools import groupby

    def rows():
        for batch in batches:
            to, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                yield to[i], kind[i], [x.as_buffer() if x.is_valid else b"" for x in (c[i] for c in batch.columns[2:8])]

    for to, mine in groupby(rows(), key=lambda x: x[0]):
        yield to, ((kind, blobs) for _, kind, blobs in mine)


def _stage(rows: DataFrame, parts: int, step) -> DataFrame:
    """What ``step(bucket, messages)`` sends when every bucket has its messages, sorted by kind."""

    def run(batches):
        for bucket, messages in _received(batches):
            yield from _messages(step(bucket, messages))

    return rows.repartitionById(parts, F.col("to")).sortWithinPartitions("to", "kind").mapInArrow(run, MESSAGES)


def _long(blob) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def _float(blob) -> np.ndarray:
    return np.frombuffer(blob, "<f4")


def _gathered(parts: list[list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    """Columns of messages, each in one array."""
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate(kinds)]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Per row of sorted ``keys`` its place among those with the same key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


def _nearest(score: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``best`` largest finite scores of every row."""
    finite = np.isfinite(score)
    if np.count_nonzero(finite) <= best * len(score):  # few: cheaper without a look at the others
        rows, columns = np.nonzero(finite)
        if len(rows) and np.bincount(rows).max() > best:
            order = np.lexsort((-score[rows, columns], rows))
            order = order[_runs(rows[order]) < best]
            rows, columns = rows[order], columns[order]
        return rows, columns
    if score.shape[1] > best:
        columns = np.argpartition(-score, best - 1, axis=1)[:, :best]
        rows = np.repeat(np.arange(len(score)), best)
        columns = columns.ravel()
    else:
        rows, columns = np.indices(score.shape).reshape(2, -1)
    good = np.isfinite(score[rows, columns])
    return rows[good], columns[good]


def first_of(keys: np.ndarray, nodes: np.ndarray, fresh: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Places of at most ``most`` rows of every key, fresh ones first, else by hash."""
    order = np.lexsort((owner(nodes, 1 << 30, seed), 1 - fresh.astype(np.int8), keys))
    return order[_runs(keys[order]) < most]


def _buckets(count_: int, most: int, spark) -> int:
    """Buckets of at most about ``most`` nodes, and enough for all cores."""
    return max(1, -(-count_ // most), min(2 * spark.sparkContext.defaultParallelism, -(-count_ // 512)))


def _dealt(vectors: Vectors, parts: int, seed: int = 0) -> DataFrame:
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            vecs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(len(nodes), -1)
            yield from _messages(_sent(owner(nodes, parts, seed), 1, nodes, vecs))

    return vectors.rows.select("node", "vec").mapInArrow(run, MESSAGES)


def _random_groups(vectors: Vectors, seed: int, parts: int) -> DataFrame:
    """Pairs of nearest neighbours inside random groups of about ``GROUP`` nodes."""
    groups, width = max(1, -(-vectors.count // GROUP)), vectors.width

    def step(bucket, messages):
        nodes, vecs = _gathered([[_long(x[0]), _float(x[1])] for _, x in messages], ["<i8", "<f4"])
        score = closeness(vecs.reshape(-1, width).astype(np.float64))
        np.fill_diagonal(score, -np.inf)
        i, j = _nearest(score, K)
        yield from _sent(owner(nodes[i], parts), 2, nodes[i], nodes[j], score[i, j].astype("<f4"))

    return _stage(_dealt(vectors, groups, seed + 1), groups, step)


def best_edges(nodes, old, pairs):
    """Per node the ``K`` best of its edges (v, sim) and of new ``pairs`` (u, v, sim); an edge that was there is not fresh."""
    size = len(nodes)
    at = np.flatnonzero(np.isfinite(old[1]))
    u = np.r_[at // K, np.searchsorted(nodes, pairs[0])]
    v, sim = np.r_[old[0][at], pairs[1]], np.r_[old[1][at], pairs[2]]
    fresh = np.r_[np.zeros(len(at), np.int8), np.ones(len(pairs[0]), np.int8)]
    order = np.lexsort((fresh, v, u))
    u, v, sim, fresh = u[order], v[order], sim[order], fresh[order]
    starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, np.int64)
    if len(u):
        sim = np.maximum.reduceat(sim, starts)
    u, v, fresh = u[starts], v[starts], fresh[starts]
    order = np.lexsort((v, -sim, u))
    u, place = u[order], _runs(u[order])
    kept = place < K
    to, order = u[kept] * K + place[kept], order[kept]
    out = np.zeros(size * K, "<i8"), np.full(size * K, -np.inf, "<f4"), np.zeros(size * K, "i1")
    for column, values in zip(out, (v, sim, fresh)):
        column[to] = values[order]
    return out


def _merged(bucket, messages):
    """A bucket's state: nodes in order, their vectors, and ``K`` edges each, as v, sim and fresh."""
    state, held, pairs = None, [], []
    for kind, x in messages:
        if kind == 0:
            state = [_long(x[0]), _float(x[1]), _long(x[2]), _float(x[3])]
        elif kind == 1:
            held.append([_long(x[0]), _float(x[1])])
        else:
            pairs.append([_long(x[0]), _long(x[1]), _float(x[2])])
    if state is None:
        nodes, vecs = _gathered(held, ["<i8", "<f4"])
        order = np.argsort(nodes)
        state = [nodes[order], vecs.reshape(len(nodes), -1)[order].ravel(), np.zeros(len(nodes) * K, "<i8"), np.full(len(nodes) * K, -np.inf, "<f4")]
    v, sim, fresh = best_edges(state[0], state[2:], _gathered(pairs, ["<i8", "<i8", "<f4"]))
    yield bucket, 0, state[0], state[1], v, sim, fresh, {"n": int(fresh.sum()), "of": int(np.isfinite(sim).sum())}


def _edges(x) -> tuple[np.ndarray, ...]:
    """u, v and fresh of a state's edges."""
    nodes, v, sim, fresh = _long(x[0]), _long(x[2]), _float(x[3]), np.frombuffer(x[4], "i1")
    at = np.flatnonzero(np.isfinite(sim))
    return nodes[at // K], v[at], fresh[at]


def _state_only(state: DataFrame) -> DataFrame:
    return state.withColumns({"n": F.lit(0).cast("long"), "of": F.lit(0).cast("long")})


def neighbour_graph(vectors: Vectors) -> DataFrame:
    """States of buckets: the nearest neighbours that descent finds for every node."""
    spark, width = vectors.rows.sparkSession, vectors.width
    parts = _buckets(vectors.count, BUCKET, spark)
    small_batches(spark)
    start = _dealt(vectors, parts)
    for seed in range(START_GROUPS):
        start = start.unionByName(_random_groups(vectors, seed, parts))
    state = written(_stage(start, parts, _merged), "neighbour-graph", "lz4")

    # Edges only get better, so rounds settle.
    for number in count():

        def against(batches):
            for _, messages in _received(batches):
                for _, x in messages:
                    u, v, fresh = _edges(x)
                    yield from _messages(_sent(owner(v, parts), 1, v, u, fresh))

        def asked(bucket, messages, number=number):
            """The neighbours of every key, in both directions, ask for their vectors."""
            keys, nodes, fresh, back = [], [], [], []
            for kind, x in messages:
                if kind == 0:
                    u, v, new = _edges(x)
                    keys, nodes, fresh = [u], [v], [new]
                else:
                    back.append([_long(x[0]), _long(x[1]), np.frombuffer(x[2], "i1")])
            key, node, new = _gathered(back, ["<i8", "<i8", "i1"])
            first = first_of(key, node, new, REVERSE, number)
            keys, nodes, fresh = (np.concatenate([*held, more[first]]) for held, more in ((keys, key), (nodes, node), (fresh, new)))
            yield from _sent(owner(nodes, parts), 1, nodes, keys, fresh)

        def answered(bucket, messages):
            """Vectors go once to every bucket that asks, with the keys that they are for."""
            asks = []
            for kind, x in messages:
                if kind == 0:
                    own, vecs = _long(x[0]), _float(x[1]).reshape(-1, width)
                    sims = _float(x[3]).reshape(-1, K)
                    least = sims.min(1)  # minus infinity where a node has fewer than K
                else:
                    asks.append([_long(x[0]), _long(x[1]), np.frombuffer(x[2], "i1")])
            node, key, fresh = _gathered(asks, ["<i8", "<i8", "i1"])
            to = owner(key, parts)
            order = np.lexsort((node, to))
            cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True]) if len(to) else np.zeros(0, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, ENTRIES):
                    rows = order[at : min(at + ENTRIES, b)]
                    wanted, place = np.unique(node[rows], return_inverse=True)
                    i = np.searchsorted(own, wanted)
                    yield int(to[rows[0]]), 2, wanted, vecs[i], least[i], key[rows], place.astype("<i8"), fresh[rows]

        def compared(bucket, messages):
            """The neighbours of a key are compared with each other."""
            held, base = [], 0
            for _, x in messages:
                nodes = _long(x[0])
                held.append([nodes, _float(x[1]), _float(x[2]), _long(x[3]), _long(x[4]) + base, np.frombuffer(x[5], "i1")])
                base += len(nodes)
            nodes, vecs, least, keys, place, fresh = _gathered(held, ["<i8", "<f4", "<f4", "<i8", "<i8", "i1"])
            vecs = vecs.reshape(-1, width)
            order = np.argsort(keys, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0, True]) if len(keys) else np.zeros(0, np.int64)
            out, n = [], 0
            for a, b in zip(at[:-1], at[1:]):
                rows = order[a:b]
                here = place[rows]
                own, new = nodes[here], fresh[rows] > 0
                score = closeness(vecs[here].astype(np.float64))
                score[~(new[:, None] | new[None, :])] = -np.inf
                score[score <= least[here, None]] = -np.inf
                score[own[:, None] == own[None, :]] = -np.inf
                i, j = _nearest(score, BEST)
                out.append([own[i], own[j], score[i, j].astype("<f4")])
                n += len(i)
                if n >= 1 << 19:
                    u, v, sim = [np.concatenate(c) for c in zip(*out)]
                    yield from _sent(owner(u, parts), 2, u, v, sim)
                    out, n = [], 0
            if n:
                u, v, sim = [np.concatenate(c) for c in zip(*out)]
                yield from _sent(owner(u, parts), 2, u, v, sim)

        held = _state_only(state)
        rows = _stage(held.unionByName(state.mapInArrow(against, MESSAGES)), parts, asked)
        rows = _stage(_stage(held.unionByName(rows), parts, answered), parts, compared)
        before, state = state, written(_stage(held.unionByName(rows), parts, _merged), "neighbour-graph", "lz4")
        discard(before)
        n, of = state.agg(F.sum("n"), F.sum("of")).first()
        if not of or n <= SETTLED * of:
            break
    return state


def _search_graph(state: DataFrame, parts: int, width: int) -> DataFrame:
    """Shards of the search: nodes in order, their vectors, and where their neighbours in both directions start."""

    def dealt(batches):
        for _, messages in _received(batches):
            for _, x in messages:
                nodes, (u, v, _) = _long(x[0]), _edges(x)
                yield from _messages(_sent(owner(nodes, parts), 0, nodes, _float(x[1]).reshape(len(nodes), -1)))
                yield from _messages(_sent(owner(u, parts), 1, u, v))
                yield from _messages(_sent(owner(v, parts), 2, v, u))

    def step(bucket, messages):
        held = ([], [], [])
        for kind, x in messages:
            held[kind].append([_long(x[0]), _long(x[1]) if kind else _float(x[1])])
        nodes, vecs = _gathered(held[0], ["<i8", "<f4"])
        order = np.argsort(nodes)
        nodes, vecs = nodes[order], vecs.reshape(-1, width)[order]
        u, v = _gathered(held[1], ["<i8", "<i8"])
        key, node = _gathered(held[2], ["<i8", "<i8"])
        first = first_of(key, node, np.zeros(len(key), "i1"), K, -1)
        u, v = np.r_[u, key[first]], np.r_[v, node[first]]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        one = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
        u, v = u[one], v[one]
        yield bucket, 0, nodes, vecs, np.searchsorted(u, np.r_[nodes, np.iinfo("<i8").max]).astype("<i8"), v

    return written(_stage(state.mapInArrow(dealt, MESSAGES), parts, step), "search-graph", "lz4")


def kept_best(state, found, most: int):
    """Entries (query, node, score, opened) of a search with those ``found``: of every query the ``most`` best; what was there keeps its mark."""
    query, node, score, opened = (np.r_[a, b] for a, b in zip(state, found))
    order = np.lexsort((1 - opened, node, query))
    query, node, score, opened = query[order], node[order], score[order], opened[order]
    one = np.r_[True, (query[1:] != query[:-1]) | (node[1:] != node[:-1])] if len(query) else np.zeros(0, bool)
    query, node, score, opened = query[one], node[one], score[one], opened[one]
    order = np.lexsort((node, -score, query))
    order = order[_runs(query[order]) < most]
    return query[order], node[order], score[order], opened[order]


class Searches:
    """The queries of a shard and what they keep, best first."""

    def __init__(self, blobs, width: int) -> None:
        self.keys, self.vecs, counts = _long(blobs[0]), _float(blobs[1]).reshape(-1, width), _long(blobs[2])
        self.query = np.repeat(np.arange(len(self.keys)), counts)
        self.node, self.score, self.opened = _long(blobs[3]), _float(blobs[4]), np.frombuffer(blobs[5], "i1")

    def entries(self):
        return self.query, self.node, self.score, self.opened


def _kept(bucket: int, keys, vecs, entries) -> tuple:
    query, node, score, opened = entries
    return bucket, 1, keys, vecs, np.bincount(query, minlength=len(keys)).astype("<i8"), node, score, opened.astype("i1"), {"n": int((opened == 0).sum())}


def greedy_search(vectors: Vectors, state: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, node, score) of the best nodes that the nodes ``queries`` (key) reach from themselves.

    Pairs of a query and a node go to the shard of the node; the vector of a query goes once to every shard,
    with the score that its last node has, and only better nodes come back.
    """
    spark, width = vectors.rows.sparkSession, vectors.width
    parts = _buckets(vectors.count, SHARD, spark)
    small_batches(spark)
    graph = _search_graph(state, parts, width)
    longest = np.array([r[0] for r in vectors.longest.collect()], "<i8")
    graph_only = _state_only(graph)

    def asking(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield from _messages(_sent(owner(keys, parts), 1, keys))

    def begun(bucket, messages):
        keys, own, vecs = [], np.empty(0, "<i8"), np.empty((0, width), "<f4")
        for kind, x in messages:
            if kind == 0:
                own, vecs = _long(x[0]), _float(x[1]).reshape(-1, width)
            else:
                keys.append(_long(x[0]))
        if keys:
            keys = np.sort(np.concatenate(keys))
            mine = vecs[np.searchsorted(own, keys)].copy()
            mine[:, -1] = 0  # so that scores are inner products
            score = np.einsum("ij,ij->i", mine, mine)
            yield _kept(bucket, keys, mine, (np.arange(len(keys)), keys, score, np.zeros(len(keys), "i1")))

    first = graph_only.unionByName(queries.select("key").mapInArrow(asking, MESSAGES))
    searches = written(_stage(first, parts, begun), "search", "lz4")

    def passed(kind: int, bucket: int, x) -> tuple:
        return (bucket, kind, *(np.frombuffer(b, "u1") for b in x))

    def fronts(also: np.ndarray):
        def run(batches):
            for bucket, messages in _received(batches):
                for _, x in messages:
                    yield from _messages(opening(bucket, Searches(x, width)))

        def opening(bucket, s):
            closed = np.flatnonzero(s.opened == 0)
            front = closed[_runs(s.query[closed]) < OPEN]
            opened = s.opened.copy()
            opened[front] = 1
            yield _kept(bucket, s.keys, s.vecs, (s.query, s.node, s.score, opened))
            yield from _sent(owner(s.node[front], parts), 2, s.keys[s.query[front]], s.node[front])
            active = np.unique(s.query[front])
            last = np.full(len(s.keys), -np.inf, "<f4")
            full = np.bincount(s.query, minlength=len(s.keys)) >= KEEP
            ends = np.cumsum(np.bincount(s.query, minlength=len(s.keys))) - 1
            last[full] = s.score[ends[full]]
            for at in range(0, len(active), ENTRIES):
                some = active[at : at + ENTRIES]
                for shard in range(parts):
                    yield shard, 3, s.keys[some], s.vecs[some], last[some]
                if len(also):
                    nodes = np.tile(also, len(some))
                    yield from _sent(owner(nodes, parts), 4, np.repeat(s.keys[some], len(also)), nodes)

        return run

    def reached(bucket, messages):
        for kind, x in messages:
            if kind == 0:
                own, starts, v = _long(x[0]), _long(x[2]), _long(x[3])
            elif kind != 2:
                yield passed(kind, bucket, x)
            else:
                keys, i = _long(x[0]), np.searchsorted(own, _long(x[1]))
                sizes = starts[i + 1] - starts[i]
                at = np.repeat(starts[i] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                yield from _sent(owner(v[at], parts), 4, np.repeat(keys, sizes), v[at])

    def scored(bucket, messages):
        asks, known = [], None
        for kind, x in messages:
            if kind == 0:
                own, vecs = _long(x[0]), _float(x[1]).reshape(-1, width)
            elif kind == 1:
                yield passed(kind, bucket, x)
            elif kind == 3:
                asks.append([_long(x[0]), _float(x[1]), _float(x[2])])
            else:
                if known is None:
                    known, sent, last = _gathered(asks, ["<i8", "<f4", "<f4"])
                    order = np.argsort(known)
                    known, sent, last = known[order], sent.reshape(-1, width)[order], last[order]
                pairs = np.unique(np.searchsorted(known, _long(x[0])) * len(own) + np.searchsorted(own, _long(x[1])))
                q, i = pairs // len(own), pairs % len(own)
                score = np.einsum("ij,ij->i", vecs[i], sent[q])
                better = score >= last[q]
                q, i, score = q[better], i[better], score[better]
                if len(q):
                    yield from _sent(owner(known[q], parts), 5, known[q], own[i], score)

    def merged(bucket, messages):
        s, found = None, []
        for kind, x in messages:
            if kind == 1:
                s = Searches(x, width)
            else:
                found.append([_long(x[0]), _long(x[1]), _float(x[2])])
        key, node, score = _gathered(found, ["<i8", "<i8", "<f4"])
        more = np.searchsorted(s.keys, key), node, score, np.zeros(len(key), "i1")
        yield _kept(bucket, s.keys, s.vecs, kept_best(s.entries(), more, KEEP))

    # What a query keeps only gets better, so searches end.
    for number in count():
        rows = searches.mapInArrow(fronts(longest if not number else longest[:0]), MESSAGES)
        rows = _stage(graph_only.unionByName(rows), parts, reached)
        rows = _stage(graph_only.unionByName(rows), parts, scored)
        before, searches = searches, written(_stage(rows, parts, merged), "search", "lz4")
        discard(before)
        if not searches.agg(F.sum("n")).first()[0]:
            break

    def found(batches):
        import pyarrow as pa

        for _, messages in _received(batches):
            for _, x in messages:
                s = Searches(x, width)
                for at in range(0, len(s.node), BATCH):
                    some = slice(at, at + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (s.keys[s.query], s.node, s.score)], names=["key", "node", "score"])
                # A query's own node, whose other rows are candidates.
                own = np.setdiff1d(s.keys, s.keys[s.query][s.keys[s.query] == s.node])
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(np.full(len(own), -np.inf, "<f4"))], names=["key", "node", "score"])

    return searches.mapInArrow(found, "key long, node long, score float")


def nearest(vectors_table: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for every query row.

    ``vectors_table`` has vec_id and embedding; ``is_query`` picks the rows that are queries.
    """
    rows = vectors_table.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    # Ids may repeat, so a row is known by a number of its own from here on.
    rows = written(rows, "numbered")
    nodes = written(rows.groupBy("embedding").agg(F.min("row").alias("node")), "nodes")
    vectors = Vectors(nodes)
    if not vectors.count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    small = 0 if vectors.sent else 1
    named = sent_if_small(nodes, small, 0)
    members = written(rows.join(named, "embedding").select("node", "vec_id", "asks", "row"), "members")
    # Ties go to smaller ids: of equal vectors, the first k + 1 rows suffice.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))
    heads = written(members.withColumn("_r", rank).filter(F.col("_r") <= k + 1).select("node", "vec_id", "row"), "heads")
    edges = neighbour_graph(vectors)
    asking = members.filter("asks").select("node", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    found = greedy_search(vectors, edges, asking.select(F.col("node").alias("key")).distinct())
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))
    found = found.withColumn("_r", best).filter((F.col("_r") <= RESCORED) | (F.col("key") == F.col("node"))).select("key", "node")
    embedded = nodes.select("node", "embedding")
    one = sent_if_small(embedded.select(F.col("node").alias("key"), F.col("embedding").alias("a")), small, 0)
    two = sent_if_small(embedded.select("node", F.col("embedding").alias("b")), small, 0)
    exact = written(found.join(one, "key").join(two, "node").select("key", "node", _dot(F.col("a"), F.col("b")).alias("score")), "found")
    # Per node the rows that can be among the first k of a query: k + 1, with one to spare for the query itself.
    options = exact.join(heads, "node").select("key", "vec_id", "row", "score")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row"))
    options = written(options.withColumn("_r", first).filter(F.col("_r") <= k + 1).drop("_r"), "options")
    answers = asking.join(options, asking["node"] == options["key"]).filter(F.col("own") != F.col("row"))
    last = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return answers.withColumn("rank", last).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
