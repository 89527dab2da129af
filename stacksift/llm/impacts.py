"""Ranked lexical search over buckets of impact vectors by length.

A document is a sparse vector of integer impacts, one for every term that some item has; an
item is a vector of how often it has a term, and a score is their inner product. Vectors are
range-partitioned by length, longest first, and cut into buckets of ``BUCKET``, stored term
by term. For an item whose k-th score so far is the threshold,

- a bucket is skipped when the item's length times the bucket's longest vector is below the
  threshold (Cauchy-Schwarz), or the sum of the largest coordinates is;
- of the item's terms, the longest lists whose largest coordinates sum to less than the
  threshold are left for later: only documents with one of the other, focus terms can reach it;
- of those, a document stays when its focus part, and the smaller of both bounds on the rest
  (largest coordinates; length of what is left of item and document), reach the threshold;
- what stays is scored exactly, in 64-bit integers.

The longest eighth of all documents goes first; its k-th scores are the thresholds of the
others, and every task raises them for itself. Bounds in floating point are widened.

Items are taken in groups of about ``GROUP`` terms, so that what executors hold of them is
bounded; each group is one pass over the documents.

Defined cases: a null text has no terms. Documents without terms are not counted; documents
without an id are counted but not ranked; every row is a document, also if its id repeats.
Rows of items with equal ids are one item with the terms of all; items without an id rank
nothing, and so do items without terms.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKET = 2048
#: One in so many range partitions goes first.
FIRST = 8
#: Item terms in a group.
GROUP = 200_000
SLACK = 1 + 1e-9

#: Everything but letters, digits and what is not ASCII becomes a space; A-Z become small.
_LETTERS = bytes(32 if re.match(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([b]), re.S) else bytes([b]).lower()[0] for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: what the items of (item_id, text) look for."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, words = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                ids += [i] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "term"])

    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def term_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms) and, of the terms of a broadcast ``vocabulary``, numbers and occurrences."""

    def run(batches):
        import pyarrow as pa

        known = vocabulary.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, ids, times = [], [], []
                for text in batch.column(1):
                    words = terms(text.as_py())
                    found = np.array([i for i in map(known, words) if i is not None], np.int32)
                    here, often = np.unique(found, return_counts=True)
                    n.append(len(words))
                    ids.append(here.tobytes())
                    times.append(often.astype(np.int32).tobytes())
                arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "ids", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary, times binary")


def holders(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.frombuffer(ids.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = vectors.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for row in found.toLocalIterator():
        out[row["term"]] = row["df"]
    return out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, length: int, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impacts of terms that a document of ``length`` terms has so many times."""
    m = 100 - 75 + (75 * length * n_docs) // n_terms
    times = times.astype(np.int64)
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def lengths(vectors: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """``vectors`` with the Euclidean length of their impacts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, ids, times in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                here = weights.value[np.frombuffer(ids.as_buffer(), "<i4")]
                x = impacts(np.frombuffer(times.as_buffer(), "<i4"), n, here, n_docs, n_terms).astype(np.float64)
                out.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["doc_id", "n", "ids", "times", "norm"])

    kept = vectors.filter("doc_id IS NOT NULL AND length(ids) > 0")
    return kept.mapInArrow(run, "doc_id long, n long, ids binary, times binary, norm double")


BUCKETS = "first boolean, ids binary, norms binary, terms binary, starts binary, places binary, weights binary"


def buckets(ordered: DataFrame, weights, n_docs: int, n_terms: int, firsts: int, size: int) -> DataFrame:
    """Vectors, in the order they come, as buckets that are stored term by term."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() < firsts
        names = [c.split()[0] for c in BUCKETS.split(", ")]
        held = []

        def out():
            ids = np.array([x[0] for x in held], np.int64)
            norms = np.array([x[1] for x in held])
            counts = [len(x[2]) for x in held]
            place = np.repeat(np.arange(len(held), dtype=np.int32), counts)
            term = np.concatenate([x[2] for x in held])
            impact = np.concatenate([x[3] for x in held])
            order = np.argsort(term, kind="stable")
            term, place, impact = term[order], place[order], impact[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            row = [first] + [x.tobytes() for x in (ids, norms, term[starts].astype("<i4"), np.r_[starts, len(term)].astype("<i8"), place, impact)]
            types = [pa.bool_()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for doc, n, ids, times, norm in zip(*(c.to_pylist() for c in batch.columns)):
                term = np.frombuffer(ids, "<i4")
                held.append((doc, norm, term, impacts(np.frombuffer(times, "<i4"), n, weights.value[term], n_docs, n_terms)))
                if len(held) == size:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return ordered.select("doc_id", "n", "ids", "times", "norm").mapInArrow(run, BUCKETS)


class Bucket:
    def __init__(self, ids, norms, terms, starts, places, weights) -> None:
        self.ids, self.norms = np.frombuffer(ids, "<i8"), np.frombuffer(norms, "<f8")
        self.terms, self.starts = np.frombuffer(terms, "<i4"), np.frombuffer(starts, "<i8")
        self.places, self.weights = np.frombuffer(places, "<i4"), np.frombuffer(weights, "<i8")
        self.peaks = np.maximum.reduceat(self.weights, self.starts[:-1])
        self.longest = float(self.norms.max(initial=0))


def best_of(bucket: Bucket, want: np.ndarray, times: np.ndarray, least: int, k: int, seen: list | None = None) -> list[tuple[int, int]]:
    """Up to ``k`` (-score, id) with scores of ``least`` or more; ``seen`` gets the number of exact scores."""
    if math.sqrt(float(times @ times)) * bucket.longest * SLACK < least:
        return []
    at = np.searchsorted(bucket.terms, want)
    found = at < len(bucket.terms)
    found[found] = bucket.terms[at[found]] == want[found]
    at, times = at[found], times[found]
    peaks = bucket.peaks[at] * times
    if not len(at) or int(peaks.sum()) < least:
        return []
    long_first = np.argsort(bucket.starts[at] - bucket.starts[at + 1], kind="stable")
    later = np.zeros(len(at), bool)
    later[long_first[np.cumsum(peaks[long_first]) < least]] = True
    part = np.zeros(len(bucket.ids), np.int64)
    square = np.zeros(len(bucket.ids))

    def add(i: int) -> None:
        here = slice(bucket.starts[at[i]], bucket.starts[at[i] + 1])
        part[bucket.places[here]] += times[i] * bucket.weights[here]

    for i in np.flatnonzero(~later):
        here = slice(bucket.starts[at[i]], bucket.starts[at[i] + 1])
        square[bucket.places[here]] += bucket.weights[here].astype(np.float64) ** 2
        add(i)
    near = part > 0
    if later.any():
        rest = times[later].astype(np.float64)
        left = np.sqrt(np.maximum(bucket.norms**2 * SLACK - square, 0)) * math.sqrt(float(rest @ rest))
        bound = part + np.minimum(left * SLACK + 1, float(peaks[later].sum()))
        near &= bound >= least
        if near.any():
            for i in np.flatnonzero(later):
                add(i)
    if seen is not None:
        seen.append(int(near.sum()))
    rows = np.flatnonzero(near & (part >= least))
    if len(rows) > 4 * k:  # of many, the k-th and its ties
        rows = rows[part[rows] >= np.partition(part[rows], len(rows) - k)[len(rows) - k]]
    return sorted((-int(s), int(d)) for s, d in zip(part[rows], bucket.ids[rows]))[:k]


def _search(held: DataFrame, queries, k: int) -> DataFrame:
    """item_id, doc_id, score out of buckets; broadcast ``queries`` are (item_id, terms, times, least)."""

    def run(batches):
        import pyarrow as pa

        least = [q[3] for q in queries.value]
        best: list[list[tuple[int, int]]] = [[] for _ in least]
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = Bucket(*(c[i].as_buffer() for c in batch.columns))
                for q, (_, want, times, _) in enumerate(queries.value):
                    found = best_of(bucket, want, times, least[q], k)
                    if found:
                        best[q] = sorted(best[q] + found)[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], -best[q][-1][0])
        rows = [(queries.value[q][0], d, -s) for q, found in enumerate(best) for s, d in found]
        if rows:
            names = ["item_id", "doc_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return held.select("ids", "norms", "terms", "starts", "places", "weights").mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rank_group(docs: DataFrame, wanted: list, k: int, size: int) -> DataFrame:
    """The documents of each of the items of ``wanted``, rows of (item_id, term, times)."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    number: dict[bytes, int] = {}
    items: dict[int, list[tuple[int, int]]] = {}
    for item, term, times in wanted:
        items.setdefault(item, []).append((number.setdefault(bytes(term), len(number)), times))
    vectors = written(term_vectors(docs, send(number)), "term-vectors")
    facts = vectors.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.count_if(F.length("ids") > 0).alias("held")).first()
    n_docs, n_terms = facts["docs"], facts["terms"] or 1
    df = holders(vectors, len(number))
    weights = send(np.array([weight(int(x), n_docs) for x in df], np.int64))
    sized = written(lengths(vectors, weights, n_docs, n_terms), "impact-lengths")
    parts = max(1, -(-facts["held"] // (4 * size)))
    ordered = sized.repartitionByRange(parts, F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")
    held = written(buckets(ordered, weights, n_docs, n_terms, -(-parts // FIRST), size), "impact-buckets")

    def queries(least: dict[int, int]):
        out = []
        for item, pairs in items.items():
            want, times = np.array(sorted(pairs), np.int64).T
            out.append((item, want.astype(np.int32), times, least.get(item, 1)))
        return send(out)

    early = written(_ranked(_search(held.filter("first"), queries({}), k), k), "first-bests")
    least = {r["item_id"]: r["score"] for r in early.filter(F.col("rank") == k).select("item_id", "score").toLocalIterator()}
    late = _search(held.filter("NOT first"), queries(least), k)
    return _ranked(early.drop("rank").unionByName(late), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, size: int = BUCKET, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of (doc_id, text) for every item of (item_id, text)."""
    wanted = written(item_terms(items), "item-terms")
    groups = max(1, -(-wanted.count() // group))
    dealt = wanted.withColumn("_g", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    out = None
    for g in range(groups):
        rows = [tuple(r) for r in dealt.filter(F.col("_g") == g).select("item_id", "term", "times").toLocalIterator()]
        found = _rank_group(docs, rows, k, size)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
