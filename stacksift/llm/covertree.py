"""Hard negatives by best-first descent of cover trees over norm-augmented candidates.

Every row gets one more component, so that all rows of a shard lie on one sphere and the
largest inner product is the smallest angle. A shard of ``SHARD`` rows carries its cover
tree: the members of a node are covered by centers that are more than half the node's
radius apart, each member goes to the nearest center, and a center keeps the radius that
covers its own members; nodes of at most ``LEAF`` rows, or of copies only, are leaves. The
angle of a query to a center and the radius bound the inner products of all rows below.

A query of a tree has windows of scores. Nodes wait in a heap by their upper bounds; a node
is skipped when its bounds lie outside all windows, or below the worst row kept of each, or
when its labels rule it out. Rows of leaves are scored exactly. Bounds are floating point
and widened; scores are integers, in double precision where sums stay below 2 ** 53.

First each anchor looks for the rows of its own label, then, with a window of scores for
every positive row, for rows of other labels; that in two waves, whose second starts from
the worst score of the first. Anchors are packed in batches, shards are dealt to groups, and
every batch meets every group, so vectors are sent once per group and not once per shard.

Defined cases: rows without an id or a label, and vectors that are null or hold a null or a
component that is not finite, take no part; missing components count zero. Every row stands
for itself: of rows with equal ids each anchor asks on its own, and a row with the anchor's
id is a candidate if it is another row. Ties go to the smaller id. An anchor without
positive rows, or a positive score below zero, has no negatives.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SCALE, quantised, usable
from .common import written

SHARD = 2048
LEAF = 32
#: Anchors in a batch.
BATCH = 512
#: Shards of the first wave of negatives: one in so many.
FIRST = 8
#: Share by which bounds are widened.
SLACK = 1e-9
NOTHING = -(2**62)
#: Batches that are sent to all executors, about 300 kB each at 64 components.
MOST_SENT = 16

NODES = np.dtype([("center", "<i4"), ("first", "<i4"), ("children", "<i4"), ("low", "<i4"), ("high", "<i4"), ("least", "<i8"), ("most", "<i8"), ("radius", "<f8")])


def augmented(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows with one more component that gives all of them the largest norm, and that norm."""
    rows = rows.astype(np.float64)
    squares = np.einsum("ij,ij->i", rows, rows)
    most = squares.max(initial=0.0)
    return np.column_stack([rows, np.sqrt(most - squares)]), float(np.sqrt(most))


def _covered(points: np.ndarray, center: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centers more than ``radius`` apart that cover all points within it, the first given; each point's center and distance."""
    centers = [center]
    squares = np.einsum("ij,ij->i", points, points)

    def distance(i: int) -> np.ndarray:
        found = np.maximum(squares + squares[i] - 2 * (points @ points[i]), 0.0)
        found[i] = 0.0
        return found

    nearest = distance(center)
    owner = np.zeros(len(points), np.int64)
    limit = radius * radius
    while True:
        far = int(nearest.argmax())
        if nearest[far] <= limit:
            return centers, owner, np.sqrt(nearest)
        found = distance(far)
        closer = found < nearest
        owner[closer] = len(centers)
        nearest[closer] = found[closer]
        centers.append(far)


def tree(rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows and the nodes; a node's rows are ``low`` to ``high`` of that order, its children are consecutive."""
    points, _ = augmented(rows)
    nodes, todo, order = [], [], np.arange(len(rows))

    def node(members: np.ndarray, center: int, low: int) -> int:
        gap = points[members] - points[center]
        far = np.einsum("ij,ij->i", gap, gap).max(initial=0.0)
        kinds = labels[members]
        nodes.append([center, 0, 0, low, low + len(members), kinds.min(), kinds.max(), np.sqrt(far)])
        order[low : low + len(members)] = members
        if len(members) > leaf and far > 0:
            todo.append((len(nodes) - 1, members, center))
        return len(nodes) - 1

    node(order.copy(), 0, 0)
    while todo:
        at, members, center = todo.pop()
        here = points[members]
        centers, owner, _ = _covered(here, int(np.flatnonzero(members == center)[0]), nodes[at][7] / 2)
        sizes = np.bincount(owner, minlength=len(centers))
        parts = np.split(members[np.argsort(owner, kind="stable")], np.cumsum(sizes)[:-1])
        nodes[at][1:3] = [len(nodes), len(centers)]
        low = nodes[at][3]
        for c, part in zip(centers, parts):
            node(part, int(members[c]), low)
            low += len(part)
    return order, np.array([tuple(n) for n in nodes], NODES)


class Shard:
    """A packed shard: rows in the order of their tree, and its nodes."""

    def __init__(self, row, ids, labels, weights, nodes, width: int) -> None:
        self.row, self.ids, self.labels = (np.frombuffer(x, "<i8") for x in (row, ids, labels))
        self.exact = np.frombuffer(weights, "<i8").reshape(len(self.ids), width)
        self.weights = self.exact.astype(np.float64)
        self.nodes = np.frombuffer(nodes, NODES)
        #: The place of each center in the order of rows.
        self.centers = self.weights[self.nodes["center"]]
        squares = np.einsum("ij,ij->i", self.weights, self.weights)
        self.norm = float(np.sqrt(squares.max(initial=0.0)))
        self.most = float(np.abs(self.exact).max(initial=0))
        ratio = self.nodes["radius"] / (2 * self.norm) if self.norm else np.zeros(len(self.nodes))
        self.angles = 2 * np.arcsin(np.minimum(ratio, 1.0))

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer scores."""
        if self.most * float(np.abs(query).max(initial=0)) * len(query) < 2**53:
            return (self.weights[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.exact[rows] @ query

    def bounds(self, query: np.ndarray, norm: float, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that rows below these nodes can have."""
        scale = norm * self.norm
        if not scale:
            zero = np.zeros(nodes.stop - nodes.start)
            return zero, zero
        angle = np.arccos(np.clip((self.centers[nodes] @ query) / scale, -1, 1))
        wide = SLACK * scale + 1
        low = scale * np.cos(np.minimum(angle + self.angles[nodes] + 1e-7, np.pi)) - wide
        return low, scale * np.cos(np.maximum(angle - self.angles[nodes] - 1e-7, 0)) + wide


def descend(shard: Shard, row: int, label: int, same: bool, query: np.ndarray, low, high, least, k: int, seen: list | None = None):
    """Per window up to ``k`` (-score, id, row) with scores from ``low`` to ``high`` and not below ``least``.

    ``same``: rows of the label of the query, else rows of other labels. ``seen`` counts scored rows.
    """
    nodes = shard.nodes
    best: list[list[tuple[int, int, int]]] = [[] for _ in low]
    floor = np.maximum(low, least).astype(np.float64)
    top = np.asarray(high, np.float64)
    q = query.astype(np.float64)
    norm = float(np.sqrt(q @ q))

    def wanted(at: slice, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        kinds = nodes[at]
        if same:
            fits = (kinds["least"] <= label) & (label <= kinds["most"])
        else:
            fits = (kinds["least"] != label) | (kinds["most"] != label)
        inside = (above[:, None] >= floor[None, :]) & (below[:, None] <= top[None, :]) & (floor <= top)[None, :]
        return fits & inside.any(1)

    def verify(rows: np.ndarray) -> None:
        kinds = shard.labels[rows]
        rows = rows[((kinds == label) == same) & (shard.row[rows] != row)]
        if not len(rows):
            return
        if seen is not None:
            seen.append(len(rows))
        score = shard.scores(query, rows)
        for w in range(len(best)):
            near = np.flatnonzero((score >= floor[w]) & (score <= top[w]))
            if not len(near):
                continue
            if len(near) > 4 * k:  # of many, the k-th and its ties
                near = near[score[near] >= np.partition(score[near], len(near) - k)[len(near) - k]]
            new = [(-int(s), int(i), int(r)) for s, i, r in zip(score[near], shard.ids[rows[near]], shard.row[rows[near]])]
            best[w] = sorted(best[w] + new)[:k]
            if len(best[w]) == k:
                floor[w] = max(floor[w], -best[w][-1][0])

    heap: list[tuple[float, int, float]] = []
    root = slice(0, 1)
    below, above = shard.bounds(q, norm, root)
    if wanted(root, below, above)[0]:
        heap.append((-above[0], 0, below[0]))
    while heap:
        above_, at, below_ = heapq.heappop(heap)
        if not ((-above_ >= floor) & (below_ <= top) & (floor <= top)).any():
            continue
        if not nodes["children"][at]:
            verify(np.arange(nodes["low"][at], nodes["high"][at]))
            continue
        children = slice(int(nodes["first"][at]), int(nodes["first"][at] + nodes["children"][at]))
        below, above = shard.bounds(q, norm, children)
        kept = np.flatnonzero(wanted(children, below, above))
        is_leaf = nodes["children"][children][kept] == 0
        leaves = children.start + kept[is_leaf]
        if len(leaves):  # all leaves of a node at once
            size = (nodes["high"] - nodes["low"])[leaves]
            start = np.repeat(nodes["low"][leaves] - np.r_[0, np.cumsum(size)[:-1]], size)
            verify(start + np.arange(size.sum()))
        for c in kept[~is_leaf]:
            heapq.heappush(heap, (-above[c], children.start + int(c), below[c]))
    return best


def _padded(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists.to_pylist()):
        out[i, : len(x)] = x
    return out


SHARDS = "slot int, wave int, size int, least long, most long, row binary, ids binary, labels binary, weights binary, nodes binary"


def shards(rows: DataFrame, width: int, size: int, slots: int) -> DataFrame:
    """Rows (row, vec_id, label, v), in the order they come, as shards with their trees."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * 7919
        names = [c.split()[0] for c in SHARDS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
        held = [np.empty(0, np.int64)] * 3 + [np.empty((0, width), np.int64)]

        def out(part):
            nonlocal number
            order, nodes = tree(part[3], part[2])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            nodes["center"] = place[nodes["center"]]
            number += 1
            row = [number % slots, number // slots % FIRST, len(order), part[2].min(), part[2].max()]
            row += [x[order].tobytes() for x in part] + [nodes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)] + [_padded(batch.column(3), width)]
            held = [np.concatenate(x) for x in zip(held, new)]
            while len(held[0]) >= size:
                yield out([x[:size] for x in held])
                held = [x[size:] for x in held]
        if len(held[0]):
            yield out(held)

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, SHARDS)


ASKS = "size int, least long, most long, row binary, ids binary, labels binary, weights binary, positives binary, floor binary"


def _asks(rows: DataFrame, width: int, windows: int) -> DataFrame:
    """Anchors (row, vec_id, label, v, positives, floor) in batches; ``windows`` slots of (id, score) each."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in ASKS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                row, ids, labels = (batch.column(i).to_numpy() for i in range(3))
                found = np.zeros((len(row), windows, 3), np.int64)  # whether it is used, id, score
                floor = np.full((len(row), windows), NOTHING, np.int64)
                for i, (p, f) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                    for w, x in enumerate(p):
                        found[i, w] = (1, x["vec_id"], x["score"])
                    for x in f:
                        floor[i, x["place"] - 1] = x["score"]
                out = [len(row), labels.min(), labels.max()]
                out += [x.tobytes() for x in (row, ids, labels, _padded(batch.column(3), width), found, floor)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)], names=names)

    return rows.select("row", "vec_id", "label", "v", "positives", "floor").mapInArrow(run, ASKS)


FOUND = "anchor long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, row long, score long"


def _search(asks: DataFrame, n_asks: int, held: DataFrame, slots: int, width: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """Rows of shards in the windows of anchors: at most ``k`` per anchor, window and shard, and fewer once a task knows better."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in FOUND.split(", ")]
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                shard = Shard(*(x[f"s_{n}"] for n in ("row", "ids", "labels", "weights", "nodes")), width)
                row, ids, labels = (np.frombuffer(x[n], "<i8") for n in ("row", "ids", "labels"))
                queries = np.frombuffer(x["weights"], "<i8").reshape(len(row), width)
                windows = len(x["positives"]) // (24 * len(row))
                positives = np.frombuffer(x["positives"], "<i8").reshape(len(row), windows, 3)
                if x["row"] not in known:
                    if len(known) > 256:
                        known.clear()
                    known[x["row"]] = np.frombuffer(x["floor"], "<i8").reshape(len(row), windows).copy()
                least = known[x["row"]]
                out = []
                for i in range(len(row)):
                    if same:
                        bottom, top = np.array([NOTHING]), np.array([-NOTHING])
                    else:
                        used, _, score = positives[i].T
                        bottom, top = -(-low * score // 100), high * score // 100
                        top = np.where(used == 1, top, bottom - 1)
                    best = descend(shard, int(row[i]), int(labels[i]), same, queries[i], bottom, top, least[i], k)
                    for w, found in enumerate(best):
                        for s, d, r in found:
                            out.append((int(row[i]), int(ids[i]), w + 1, int(positives[i, w, 1]), int(positives[i, w, 2]), d, r, -s))
                        if len(found) == k:
                            least[i, w] = max(least[i, w], -found[-1][0])
                if out:
                    kinds = [pa.int32() if n == "place" else pa.int64() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    sent = asks.select("*", every)
    sides = held.select("slot", *[F.col(n).alias(f"s_{n}") for n in ("least", "most", "row", "ids", "labels", "weights", "nodes")])
    if same:
        fits = (F.col("least") <= F.col("s_most")) & (F.col("s_least") <= F.col("most"))
    else:
        fits = ~((F.col("s_least") == F.col("s_most")) & (F.col("least") == F.col("s_least")) & (F.col("most") == F.col("s_most")))
    sent = F.broadcast(sent) if n_asks * slots <= MOST_SENT * 64 and n_asks <= MOST_SENT else sent
    met = sides.join(sent, "slot").filter(fits)
    columns = ["row", "ids", "labels", "weights", "positives", "floor"] + [f"s_{n}" for n in ("row", "ids", "labels", "weights", "nodes")]
    return met.select(*columns).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = SCALE, shard: int = SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score out of (vec_id, embedding, label).

    A negative's score is at least ``low`` and at most ``high`` per cent of the positive's.
    """
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    good = good.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    good = written(good, "mined-rows")
    facts = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("asks")).first()
    width, count, n_asks = facts["width"] or 1, facts["n"], facts["asks"]
    # Rows of one label and with the same strongest component come into one shard.
    size = F.transform("v", lambda x: F.abs(x))
    term = F.coalesce(F.array_position(size, F.array_max(size)), F.lit(0))
    ordered = good.withColumn("_term", term).repartitionByRange(max(1, -(-count // (4 * shard))), "label", "_term", "row")
    ordered = ordered.sortWithinPartitions("label", "_term", "row")
    spark = rows.sparkSession
    slots = max(1, min(-(-count // shard), 4 * spark.sparkContext.defaultParallelism))
    held = written(shards(ordered, width, shard, slots), "cover-trees")

    parts = max(1, -(-n_asks // (8 * BATCH)))
    anchors = good.filter("asks").select("row", "vec_id", "label", "v")
    none = F.array().cast("array<struct<place:int,score:bigint>>").alias("floor")

    def batches(asking: DataFrame, windows: int, name: str) -> DataFrame:
        dealt = asking.repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row")
        return written(_asks(dealt, width, windows), name)

    open_ = F.array(F.struct(F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))).alias("positives")
    asks = batches(anchors.select("*", open_, none), 1, "anchors")
    n_batches = -(-n_asks // BATCH) + parts
    near = written(_ranked(_search(asks, n_batches, held, slots, width, True, positives, low, high), positives), "positives")

    kept = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))
    wanted = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(kept, lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("positives"))
    paired = anchors.join(wanted, "row")

    first, rest = held.filter("wave = 0"), held.filter("wave > 0")
    asks = batches(paired.select("*", none), positives, "paired")
    early = written(_ranked(_search(asks, n_batches, first, slots, width, False, negatives, low, high), negatives), "first-wave")
    floors = early.filter(F.col("rank") == negatives).groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("place", "score")).alias("_f"))
    known = paired.join(floors, "row", "left").withColumn("floor", F.coalesce("_f", none))
    late = _search(batches(known, positives, "known"), n_batches, rest, slots, width, False, negatives, low, high)
    out = _ranked(early.drop("rank").unionByName(late), negatives)
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
