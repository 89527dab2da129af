"""Recurring passages found by sharded automata.

A window is ``WINDOW`` consecutive words of one document. Passages that recur are confirmed
first, and located by Aho-Corasick automata after that:

1. Of every window the smallest hash of its ``ANCHOR``-word phrases is its anchor; equal
   windows have the same one. Anchors seen in one document only are dropped.
2. What is left of a document is cut into stretches: the words of consecutive windows with
   the same anchor. Equal stretches are one passage, with its smallest and largest document.
   An anchor with more than ``HOT`` passages is dealt anew: each of its windows is a stretch
   of its own, under its own hash.
3. Passages are dealt to shards by anchor, so all occurrences of a window are in one shard.
   A shard confirms by the words themselves which windows occur in two documents, compiles
   those that several passages hold, and whole passages that recur, into one automaton, and
   streams all its passages through it. A word is two letters of the automaton, from two
   alphabets, so no node has many branches and matches start at words.
4. The stretches of all documents get the windows located in their passage; those that start
   in a document with a smaller id are marked, and the marked words are left out.

Documents meet their anchors and marks by joins on the id; copies are combined before every
shuffle, and joins of anchors or passages with their many occurrences can be split, as the
smaller side has every key once. Passages are joined by two hashes of 64 bits.

Defined cases: a null, empty or blank text has no words, and an empty text is kept of it.
Rows without an id lose nothing and take nothing from others; of rows with equal ids none is
smaller. Windows are judged on the input alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

WINDOW = 13
ANCHOR = 7
#: Passages of one anchor beyond which its windows are dealt one by one.
HOT = 2000
#: Passages in a shard, about.
SHARD = 12_000
#: Texts whose words a worker holds at once.
TEXTS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Words of a text: bytes are split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _word_hashes(found: list[bytes]) -> np.ndarray:
    import pandas as pd

    held = np.empty(len(found), object)
    held[:] = found
    return pd.util.hash_array(held, categorize=False)


def anchors(hashes: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> np.ndarray:
    """The anchor of every window of a row of word hashes."""
    n = len(hashes) - size + 1
    phrase = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            phrase = phrase * _MIX + hashes[j : j + n]
        phrase ^= phrase >> np.uint64(29)
        phrase *= _STIR
        phrase ^= phrase >> np.uint64(32)
    span, least = 1, phrase
    while span < window - size + 1:  # the least of twice as many neighbours, and of as many as are left at last
        step = min(span, window - size + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least.view(np.int64)


def _texts(batches):
    """Batches in slices, each with the words of its texts and where each text starts."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            found: list[bytes] = []
            starts = [0]
            for text in batch.column(1):
                found += words(text.as_py())
                starts.append(len(found))
            yield batch, found, starts


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id), once per row of (doc_id, text) and anchor."""

    def run(batches):
        import pyarrow as pa

        for batch, found, starts in _texts(batches):
            hashes = _word_hashes(found)
            keys, ids = [], []
            for doc, a, b in zip(batch.column(0).to_pylist(), starts, starts[1:]):
                if b - a >= window:
                    here = np.unique(anchors(hashes[a:b], window))
                    keys.append(here)
                    ids.append(np.full(len(here), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


STRETCHES = "anchor long, doc_id long, row long, start long, windows int, text string"


def runs(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys, cut to at most ``most``."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    if size.max(initial=0) > most:
        pieces = -(-size // most)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(np.repeat(size, pieces) - step * most, most)
        first = np.repeat(first, pieces) + step * most
    return first, size


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """Stretches of (doc_id, text, row, anchors): windows from ``start`` on that have one of the shared anchors."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in STRETCHES.split(", ")]
        for batch, found, starts in _texts(batches):
            hashes = _word_hashes(found)
            size = np.fromiter(map(len, found), np.int64, len(found)) + 1
            numbers: list[list[np.ndarray]] = [[] for _ in range(5)]
            texts: list[bytes] = []
            for doc, row, shared, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), starts, starts[1:]):
                if b - a < window:
                    continue
                key = anchors(hashes[a:b], window)
                first, n = runs(key, window - ANCHOR + 1)
                kept = np.isin(key[first], shared.values.to_numpy())
                first, n = first[kept], n[kept]
                joined = b" ".join(found[a:b])
                at = np.r_[0, np.cumsum(size[a:b])]
                texts += [joined[s:e] for s, e in zip(at[first].tolist(), (at[first + n + window - 1] - 1).tolist())]
                for column, values in zip(numbers, (key[first], np.full(len(n), doc), np.full(len(n), row), first, n)):
                    column.append(values)
            if texts:
                arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in numbers[:4]]
                arrays += [pa.array(np.concatenate(numbers[4]).astype(np.int32)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = docs.select("doc_id", "text", "row", "anchors").mapInArrow(run, STRETCHES)
    return found.withColumn("words", F.xxhash64("text"))


def single_windows(held: DataFrame, window: int) -> DataFrame:
    """Every window of ``held`` as a stretch of its own, under its own hash."""
    split = F.split("text", " ")
    each = F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("_j")
    rows = held.select("doc_id", "row", "start", split.alias("_w"), each)
    text = F.array_join(F.slice("_w", F.col("_j") + 1, window), " ")
    rows = rows.select("doc_id", "row", (F.col("start") + F.col("_j")).alias("start"), F.lit(1).alias("windows"), text.alias("text"))
    words = F.xxhash64("text").alias("words")
    return rows.select(F.xxhash64(F.lit(window), "text").alias("anchor"), "doc_id", "row", "start", "windows", "text", words)


def passages(held: DataFrame) -> DataFrame:
    """Different stretches: anchor, words, and the smallest and largest document."""
    found = held.groupBy("anchor", "words")
    return found.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("text").alias("text"))


class Shard:
    """An automaton for what recurs in the passages of a shard, each (text, least, most)."""

    def __init__(self, rows: list[tuple[str, int, int]], window: int = WINDOW) -> None:
        import ahocorasick

        number: dict[str, int] = {}
        split = [text.split(" ") for text, _, _ in rows]
        ids = np.array([number.setdefault(w, len(number)) for s in split for w in s], np.uint32)
        #: Letters of the two alphabets; two letters make a word.
        bits = max(1, (max(len(number) - 1, 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        letters = np.column_stack([(ids >> bits) + 1, (ids & mask) + mask + 2]).astype("<u4").tobytes().decode("utf-32-le")
        ends = np.cumsum([2 * len(s) for s in split]).tolist()
        self.letters = [letters[a:b] for a, b in zip([0, *ends], ends)]
        self.window = window
        span = 2 * window
        # Of every window: its smallest and largest document, and whether several passages hold it.
        seen: dict[str, tuple[int, int, bool]] = {}
        for letters, (_, least, most) in zip(self.letters, rows):
            for at in range(0, len(letters) - span + 1, 2):
                key = letters[at : at + span]
                known = seen.get(key)
                seen[key] = (least, most, False) if known is None else (min(least, known[0]), max(most, known[1]), True)
        self.automaton = ahocorasick.Automaton()
        for letters, (_, least, most) in zip(self.letters, rows):
            alone = False
            for at in range(0, len(letters) - span + 1, 2):
                key = letters[at : at + span]
                low, high, several = seen[key]
                if several and low < high:
                    self.automaton.add_word(key, (len(key), low))
                alone |= not several
            if alone and least < most:  # the whole passage stands for the windows that no other holds
                self.automaton.add_word(letters, (len(letters), least))
        if len(self.automaton):
            self.automaton.make_automaton()

    def located(self, letters: str) -> list[int | None]:
        """Of every window of a passage: the smallest document it starts in, if it recurs."""
        found: list[int | None] = [None] * (len(letters) // 2 - self.window + 1)
        if len(self.automaton):
            for end, (size, least) in self.automaton.iter(letters):
                first = (end + 1 - size) // 2
                for at in range(first, first + size // 2 - self.window + 1):
                    if found[at] is None or least < found[at]:
                        found[at] = least
        return found


def located(held: DataFrame, window: int, size: int) -> DataFrame:
    """``anchor``, ``words`` and, of every window of the passage, the smallest document (``firsts``)."""
    shards = max(1, -(-held.count() // size))

    def run(key, table):
        import pyarrow as pa

        texts, least, most = (table.column(c).to_pylist() for c in ("text", "least", "most"))
        shard = Shard(list(zip(texts, least, most)), window)
        found = pa.array([shard.located(x) for x in shard.letters], pa.list_(pa.int64()))
        return pa.table([table.column("anchor"), table.column("words"), found], names=["anchor", "words", "firsts"])

    dealt = held.select("anchor", "words", "text", "least", "most", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "anchor long, words long, firsts array<long>")


def recurring(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``doc_id``, ``row`` and marks of the windows of (doc_id, text, row) that start in a smaller document.

    A mark is the start of a stretch, shifted by the most windows a stretch has, and a bit per window.
    """
    if window - ANCHOR + 1 > 32:
        raise ValueError("a window has at most 38 words")
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    pairs = written(document_anchors(known.select("doc_id", "text"), window), "anchors")
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("anchor")
    by_doc = written(pairs.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    discard(pairs)
    sharing = written(known.join(by_doc, "doc_id"), "sharing")
    discard(by_doc)
    held = written(stretches(sharing, window), "stretches")
    discard(sharing)
    kinds = written(passages(held), "passages")
    made = [held, kinds]
    crowded = written(kinds.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "crowded")
    if crowded.count():
        alone = written(single_windows(held.join(crowded, "anchor", "left_semi"), window), "single-windows")
        made.append(alone)
        held = held.join(crowded, "anchor", "left_anti").unionByName(alone)
        kinds = kinds.join(crowded, "anchor", "left_anti").unionByName(passages(alone))
    # A passage of one document can still share a window with another passage of its anchor.
    firsts = written(located(kinds, window, shard).filter(F.exists("firsts", lambda x: x.isNotNull())), "located")
    marked = held.select("anchor", "words", "doc_id", "row", "start").join(firsts, ["anchor", "words"])
    # One number: where the stretch starts, and a bit for each of its windows that goes.
    smaller = F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(smaller, F.lit(0).cast("long"), lambda s, x: s + x)
    marked = marked.select("doc_id", "row", "start", bits.alias("bits")).filter("bits > 0")
    mark = F.col("start") * (1 << (window - ANCHOR + 1)) + F.col("bits")
    marks = written(marked.groupBy("doc_id", "row").agg(F.collect_list(mark).alias("marks")), "marks")
    discard(firsts, crowded, *made)
    return marks


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """What is left of (doc_id, text, marks)."""
    most = window - ANCHOR + 1

    def run(batches):
        import pyarrow as pa

        for batch, found, starts in _texts(batches):
            n, removed, kept = [], [], []
            for marks, a, b in zip(batch.column(2), starts, starts[1:]):
                here = found[a:b]
                if marks.is_valid:
                    marks = marks.values.to_numpy()
                    at = np.concatenate([(marks >> most)[(marks >> i & 1) == 1] + i for i in range(most)])
                    edges = np.zeros(len(here) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    here = [w for w, gone in zip(here, covered.tolist()) if not gone]
                n.append(b - a)
                removed.append(b - a - len(here))
                kept.append(b" ".join(here).decode("utf-8", "surrogatepass"))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "marks").mapInArrow(run, KEPT)


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words of (doc_id, text) that no repeated window covers."""
    row = F.xxhash64("text").alias("row")  # rows with the same id and text have the same marks
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    marks = recurring(slim, window, hot, shard)
    return _kept(slim.join(marks, ["doc_id", "row"], "left"), window)

