"""N-gram Jaccard join by partitions of the universe of shingles.

Sets link when ``100 * shared >= 85 * union``. Sets are dealt to bands by size. For a band
the largest difference of two linked sets is known, and the universe of shingle hashes is
cut into enough segments that two linked sets must agree on one of them (pigeonhole). A
segment is indexed by the hash of the subset that falls into it; segments chosen by cost
are also indexed by their one-deletion neighbourhoods, and then count for two differences,
so fewer and larger segments do. A set is indexed in its own band and, where a smaller set
of the band below may link with it, in that band as well.

Segments that are empty in both sets agree without saying anything. They are left out and
made up for by spare segments; only a set with more empty segments than there are spare
ones indexes them too. So nothing is lost and no segment is common to all.

Equal sets are one node, named by its hash. In every index group, nodes are first checked
against one leader of the group, which is linear, and linked nodes are contracted; this is
done ``LEADERS`` times with other leaders, for groups that still hold several components.
The first leader is the node of the group that shares most with others; further ones go by hash.
Then all pairs of a group that are in different components are looked at. A pair is verified
exactly, by the sets, unless its sizes or its parity sketches rule it out: each shingle flips
one bit, so differing bits are no more than differing shingles, and no linked pair is lost.
Sketches grow with their sets; the rows of the groups that are still open carry a short one of fixed size.

Defined cases: a null or empty text, or white space alone, has no shingles and no links; a
text with fewer words than a shingle has one, of all its words. Rows without an id link
nothing and keep a null component; repeated rows get the same result each.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sent_if_small, small_batches, written
from .components import components

SHINGLE = 4
PER_CENT = 85
#: Ratio of the sizes of a band.
BAND = 1.4
#: Cost in index rows of two unrelated sets in one group: where the short sketches rule them out, and where they can't.
PAIR_COST = 0.05
BLIND_COST = 1.0
#: The share of shingles that unrelated sets have in common.
COMMON = 0.01
#: The least numbers of spare segments to choose from; further ones grow by an eighth up to a third of the segments.
SPARES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Rounds of comparing nodes with one leader of their groups.
LEADERS = 2
#: Words of 64 bits in the short parity sketch of a set; the whole one has a bit per shingle or more.
SKETCH = 16
#: Word hashes kept per worker.
CACHE_WORDS = 100_000
#: Rows of 16 bytes that may be sent to all executors; beyond it, both sides are shuffled.
MOST_SENT = 500_000


class Band(NamedTuple):
    """Sizes from ``low`` to ``high``; ``segments``, the first ``deletions`` of them with neighbourhoods."""

    low: int
    high: int
    segments: int
    deletions: int
    spare: int


def band_plan(low: int, high: int, sets: float, per_cent: int = PER_CENT) -> Band:
    """Segments of a band and their kinds, at the least cost for about ``sets`` sets in it.

    The cost is the index rows of all sets and the meetings of unrelated sets that agree on a
    segment by chance, once for each segment; both follow from the mean number of shingles in a segment.
    """
    # The difference follows from the sum of the sizes; it jumps by two at most, so the last sums suffice.
    top = high + high * 100 // per_cent
    most = max(n - 2 * -(-per_cent * n // (100 + per_cent)) for n in range(max(2, top - 60), top + 1))
    if most <= 0:
        return Band(low, high, 1, 0, 0)
    meeting = PAIR_COST if _short_tells(low, most) else max(PAIR_COST, BLIND_COST)
    best, least = None, math.inf
    for share in (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0):
        for spare in _spares(most):
            need = most + 1 + spare
            segments = math.ceil(need / (1 + share))
            deletions = min(segments, need - segments)
            mean = low / segments
            none = math.exp(-mean)
            empty = (segments - deletions) * none + 2 * deletions * none * (1 + mean)
            # Sets with more empty segments than spare ones index those, and meet others that do.
            thin = _more_than(spare, empty)
            both = (segments - deletions) * none**2 + deletions * (none * (1 + mean)) ** 2
            alike = none * none * (math.exp(mean * COMMON) - 1)  # the same subset, not empty
            chance = alike * (segments - deletions + deletions * (1 + mean) ** 2) + thin * thin * both
            mean = (low + high) / 2 / segments
            # Empty segments are rows of thin sets only.
            rows = segments * (1 - (1 - thin) * math.exp(-mean)) + deletions * mean
            cost = sets * rows + meeting * sets * sets / 2 * chance
            if cost < least:
                best, least = Band(low, high, segments, deletions, spare), cost
    return best


def _spares(most: int) -> list[int]:
    """Numbers of spare segments to choose from where linked sets differ in up to ``most`` shingles.

    About a twelfth of the segments is empty in a set, so fewer spare ones than that make up for nothing.
    """
    out = list(SPARES)
    while out[-1] < most / 3:
        out.append(out[-1] * 9 // 8)
    return out


def _short_tells(size: int, most: int) -> bool:
    """Whether short sketches of unrelated sets differ in more bits than those of linked ones may."""
    bits = 64 * SKETCH
    return bits / 2 * (1 - math.exp(-4 * size / bits)) > most + 2 * math.sqrt(bits)


def _more_than(most: int, mean: float) -> float:
    """The chance that a Poisson number is above ``most``."""
    if mean > 100:  # about normal; the sum would run out of range
        return math.erfc((most + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def bands(counts: dict[int, int], most_words: int, per_cent: int = PER_CENT, ratio: float = BAND) -> list[Band]:
    """Bands for sizes up to ``most_words``; ``counts`` has documents by rough size class."""
    out, low = [], 1
    while low <= most_words or not out:
        high = max(low, math.ceil(low * ratio) - 1)
        sets = sum(n for c, n in counts.items() if low <= ratio ** (c + 1) and ratio**c <= high)
        out.append(band_plan(low, high, max(sets, 1), per_cent))
        low = high + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int = SHINGLE) -> None:
        import xxhash

        self.size, self.hash, self.words = size, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        # Bytes: lower() changes A-Z alone, and split() splits at ASCII white space alone.
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        hashes = list(map(known.get, words))
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[words[i]] = self.hash(words[i])
        h = np.array(hashes, np.uint64)
        wide = min(self.size, len(h))
        out = np.full(len(h) - wide + 1, wide, np.uint64)
        for i in range(wide):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - wide + 1 + i])
        return np.unique(out)


def _band_entries(shingles: np.ndarray, number: int, band: Band) -> np.ndarray:
    """Index entries of a set in a band."""
    top = shingles >> np.uint64(32)
    slots = (top * np.uint64(band.segments)) >> np.uint64(32)  # sorted, as the shingles are
    starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    held = slots[starts]
    mixed = _mix(shingles + np.uint64(0x632BE59BD9B4E019))
    sums = np.add.reduceat(mixed, starts)
    sizes = np.diff(np.r_[starts, len(slots)])
    # A segment whose common neighbours may be the empty set alone: empty, or one shingle that may be deleted.
    deletions = np.uint64(band.deletions)
    present = np.zeros(band.segments, np.int64)
    present[held.astype(np.int64)] = sizes
    thin = int((present[band.deletions :] == 0).sum() + 2 * (present[: band.deletions] <= 1).sum())
    seed = np.uint64((number << 32) & 0xFFFFFFFFFFFFFFFF)

    def entry(slot: np.ndarray, total: np.ndarray) -> np.ndarray:
        return _mix(total ^ _mix(seed + slot + np.uint64(1)))

    out = [entry(held, sums)]
    if band.deletions:
        of = np.repeat(np.arange(len(starts)), sizes)
        chosen = (slots < deletions) & (sizes[of] > 1)
        out.append(entry(slots[chosen], (sums[of] - mixed)[chosen]))
    if thin > band.spare:
        empty = np.flatnonzero(present == 0).astype(np.uint64)
        single = np.flatnonzero(present[: band.deletions] == 1).astype(np.uint64)
        none = np.r_[empty, single]
        out.append(entry(none, np.zeros(len(none), np.uint64)))
    return np.unique(np.concatenate(out))


def index_entries(shingles: np.ndarray, plan: list[Band], lows: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Index entries of a set in all bands where it may meet a linked set."""
    size = len(shingles)
    if not size:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(lows, size, "right")) - 1
    out = [_band_entries(shingles, own, plan[own])]
    below = own - 1
    while below >= 0 and 100 * plan[below].high >= per_cent * size:
        out.append(_band_entries(shingles, below, plan[below]))
        below -= 1
    return np.concatenate(out)


def set_name(shingles: np.ndarray) -> int:
    """A signed number that names a set by its content."""
    mixed = _mix(shingles)
    return int(_mix(np.array([mixed.sum() ^ np.uint64(len(shingles))], np.uint64))[0].astype(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles falls on, as signed numbers: a power of two of them, ``SKETCH`` at least."""
    bits = 64 * SKETCH
    while bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def short_sketch(whole: np.ndarray) -> np.ndarray:
    """The sketch with the fewest bits; shingles that fall together cancel out."""
    return np.bitwise_xor.reduce(whole.reshape(-1, SKETCH), axis=0)


def _sizes_fit(one: str, two: str, per_cent: int) -> tuple[Column, Column]:
    """Whether two sizes allow a link, and the most shingles that linked sets of these sizes differ in."""
    small, large = F.least(f"{one}s", f"{two}s"), F.greatest(f"{one}s", f"{two}s")
    both = F.col(f"{one}s") + F.col(f"{two}s")
    return 100 * small >= per_cent * large, both - 2 * F.ceil(per_cent * both / (100 + per_cent) - 1e-9)


def short_fit(one: str, two: str, per_cent: int = PER_CENT) -> Column:
    """Whether two sets, as columns ending in ``s`` (size) and ``k`` (short sketch), can link."""
    sizes, most = _sizes_fit(one, two, per_cent)
    return sizes & (_short_differing(F.col(f"{one}k"), F.col(f"{two}k")) <= most)


def _short_differing(a: Column, b: Column) -> Column:
    """Differing bits of two sketches of ``SKETCH`` words."""
    differing = F.lit(0)
    for i in range(SKETCH):
        differing = differing + F.bit_count(a[i].bitwiseXOR(b[i]))
    return differing


def whole_fit(one: str, two: str, per_cent: int = PER_CENT) -> Column:
    """The same by the whole sketches, columns ending in ``w``; the longer one is folded to the other."""

    def folded(longer: Column) -> Column:
        half = (F.size(longer) / 2).cast("int")
        return F.zip_with(F.slice(longer, F.lit(1), half), F.slice(longer, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    a, b = F.col(f"{one}w"), F.col(f"{two}w")
    x, y = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    sizes, most = _sizes_fit(one, two, per_cent)
    short = (F.size(a) == SKETCH) & (F.size(b) == SKETCH)
    # Sketches more than one fold apart belong to sizes that don't fit.
    return sizes & F.when(short, _short_differing(a, b) <= most).otherwise((F.size(x) == F.size(y)) & (differing <= most))


def indexed(docs: DataFrame, plan: list[Band], shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, the name of the set, its sketch and its index entries."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = Shingler(shingle)
        lows = np.array([b.low for b in plan])
        for batch in batches:
            sizes, names, sketches, short, entries = [], [], [], [], []
            for text in batch.column(1):
                shingles = of(text.as_py())
                sizes.append(len(shingles))
                names.append(set_name(shingles) if len(shingles) else None)
                sketches.append(sketch(shingles) if len(shingles) else None)
                short.append(short_sketch(sketches[-1]) if len(shingles) else None)
                entries.append(index_entries(shingles, plan, lows, per_cent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "sketch", "short", "entries"],
            )

    schema = "doc_id long, n_shingles long, node long, sketch array<long>, short array<long>, entries array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) of documents (node, text) whose set has the name ``node``, one row per node."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        of, seen = Shingler(shingle), set()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node not in seen and len(found := of(text.as_py())) and set_name(found) == node:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = written(docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")
    # Repeated rows in several tasks name the same node more than once.
    again = sets.groupBy("node").count().filter("count > 1")
    if again.isEmpty():
        return sets
    once = sets.join(again, "node", "left_semi").dropDuplicates(["node"])
    return written(sets.join(again, "node", "left_anti").unionByName(once), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """``pairs`` (a, b) of nodes with ``shared``, ``both`` (size of the union) and ``linked``."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = pairs.join(one, "a").join(two, "b").select(
        "a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("both")
    )
    return out.withColumn("linked", 100 * F.col("shared") >= per_cent * F.col("both"))


def link(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, node), and (node, root) of all nodes that link with another."""
    chars = F.char_length("text")
    # A rough size, for costs only: words of six characters. One row per power of BAND.
    rough = F.floor(F.log(F.greatest(chars / 6, F.lit(1))) / math.log(BAND)).cast("int")
    classes = docs.select(rough.alias("c"), chars.alias("n")).filter("n > 0").groupBy("c").agg(
        F.count(F.lit(1)).alias("docs"), F.max("n").alias("longest")
    ).collect()
    most_words = max((r["longest"] + 1) // 2 for r in classes) if classes else 1
    plan = bands({r["c"]: r["docs"] for r in classes}, most_words, per_cent)
    found = written(indexed(docs, plan, shingle, per_cent), "shingles")
    groups = _shared_entries(found)
    named = written(found.select("doc_id", "n_shingles", "node"), "named")
    needed = groups.select("node").distinct()
    # One text per node: its smallest id.
    facts = found.select("node", "doc_id", "n_shingles", "sketch", "short").filter("doc_id IS NOT NULL").join(needed, "node")
    facts = written(facts.groupBy("node").agg(F.min_by(F.struct("doc_id", "n_shingles", "sketch", "short"), "doc_id").alias("f")), "nodes")
    discard(found)
    chosen = sent_if_small(facts.select("node", "f.doc_id"), facts.count(), MOST_SENT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    nodes = facts.select("node", F.col("f.n_shingles").alias("size"), F.col("f.sketch").alias("sketch"), F.col("f.short").alias("short"))
    return named, _contracted(groups, nodes, shingle_sets(texts, shingle), per_cent)


def _shared_entries(found: DataFrame) -> DataFrame:
    """(entry, node, leads) of entries that at least two nodes have; one node leads each.

    It is the one that shares most with others: of near copies, the fewer shingles one has changed, the more
    segments it has in common with the rest. So the middle of a group leads, and what is near it links with it.
    """
    rows = found.filter(F.col("doc_id").isNotNull()).select(F.explode("entries").alias("entry"), "node")
    at = Window.partitionBy("entry")
    shared = rows.select("entry", "node", F.min("node").over(at).alias("first"), F.max("node").over(at).alias("last"))
    shared = written(shared.filter("first <> last").select("entry", "node").distinct(), "shared-entries")
    sizes = shared.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    weights = shared.join(sizes, "entry").groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = written(shared.join(weights, "node").select("entry", "node", "weight"), "weighed-entries")
    order = F.struct(-F.col("weight"), F.xxhash64("node", F.lit(0)), "node")
    lead = weighed.groupBy("entry").agg(F.min_by("node", order).alias("lead"))
    led = written(weighed.join(lead, "entry").select("entry", "node", (F.col("node") == F.col("lead")).alias("leads")), "led-entries")
    discard(shared, weighed)
    return led


def _contracted(groups: DataFrame, nodes: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Components of the nodes (node, size, sketch, short) that share entries."""

    def facts(name: str, sketch: str, mark: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("size").alias(f"{name}s"), F.col(sketch).alias(f"{name}{mark}"))

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and whole sketches allow. A short sketch says nothing about sets of many
        shingles, which are the ones that meet by chance most; the whole one is the short one for all others."""
        near = pairs.join(facts("a", "sketch", "w"), "a").join(facts("b", "sketch", "w"), "b")
        return near.filter(whole_fit("a", "b", per_cent)).select("a", "b")

    def ordered(one: str, two: str) -> list[Column]:
        return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]

    rows = groups.withColumn("root", F.col("node"))
    checked, roots = None, None
    for number in range(LEADERS):
        # Every node of a group against a node that leads it in this round.
        if number == 0:
            lead = rows.filter("leads").select("entry", F.struct("node", "root").alias("lead"))
        else:
            order = F.struct(F.xxhash64("node", F.lit(number)), "node")
            lead = rows.groupBy("entry").agg(F.min_by(F.struct("node", "root"), order).alias("lead"))
        led = rows.join(lead, "entry").filter(F.col("root") != F.col("lead.root"))
        pairs = led.select(*ordered("node", "lead.node")).distinct()
        near = fitting(pairs)
        if checked is not None:
            near = near.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = written(verified(near, sets, per_cent), "leader-pairs")
        links = found.filter("linked").select("a", "b")
        checked = found.select("a", "b") if checked is None else checked.unionByName(found.select("a", "b"))
        if links.isEmpty():
            break
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        older, roots = roots, components(links)
        if older is not None:
            discard(older, rows)
        rows = _open_groups(groups, roots)
    # All pairs of a group that are still in different components. The leaders of the first
    # round have met their whole groups, so they and groups of two are done. The largest
    # component of a group needs no pairs inside; the others meet all rows.
    older, rows = rows, _mixed(rows.filter(~F.col("leads")))
    if roots is not None:
        discard(older)
    parts = rows.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("entry").agg(F.max(F.struct("n", "root")).alias("top"))
    minor = rows.join(largest, "entry").filter(F.col("root") != F.col("top.root")).drop("top")

    def side(some: DataFrame, name: str) -> DataFrame:
        return some.select("entry", F.col("node").alias(name), F.col("root").alias(f"{name}r")).join(facts(name, "short", "k"), name)

    apart = (F.col("xr") != F.col("yr")) & short_fit("x", "y", per_cent)
    met = side(minor, "x").join(side(rows, "y"), "entry").filter(apart)
    more = met.select(*ordered("x", "y")).distinct().join(checked, ["a", "b"], "left_anti")
    late = written(verified(fitting(more), sets, per_cent).filter("linked").select("a", "b"), "late-links")
    if roots is None:
        return components(late)
    if late.isEmpty():
        return roots
    return components(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _open_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (entry, node, leads, root) of the groups that hold more than one component."""
    placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _mixed(placed.select("entry", "node", "leads", "root"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of groups with more than one root."""
    mixed = rows.groupBy("entry").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2")
    return written(rows.join(mixed.select("entry"), "entry", "left_semi"), "open-entries")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach."""
    named, roots = link(docs, shingle, per_cent)
    rooted = written(
        named.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root")), "rooted"
    )
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = rooted.filter("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = rooted.join(least, "root").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return found.unionByName(own)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """All columns of one document of each component: the one with the smallest id.

    Rows without an id stay. Of repeated rows with the kept id one stays.
    """
    kept = written(similar_documents(docs, shingle, per_cent).filter("doc_id = component_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows")).withColumnRenamed("doc_id", "_kept"), "kept")
    single = docs.join(kept.filter("rows = 1"), F.col("doc_id") == F.col("_kept"), "left_semi")
    several = docs.join(kept.filter("rows > 1"), F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.filter(F.col("doc_id").isNull()))
