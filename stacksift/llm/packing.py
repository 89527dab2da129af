"""Packing documents into windows of tokens by the sum-of-squares rule.

A document is its ids and a closing id. Whole windows are cut off its front; the rest goes,
as it comes, to the fill level where the sum of squared counts of partly filled windows
gets least. The counts per level are one array; ties go to the fullest window.

Each task packs the documents of its own partition, so nothing is shuffled and a lost task
is packed again alike. Documents may be cut, and that is used for what the rule leaves
open: at the end of a partition, or when ``OPEN_WINDOWS`` windows are open, the emptiest
windows are cut into the gaps of the fullest. The last window of a partition is cut at
powers of two, which need no padding. So nothing is padded.

A null or empty text is its closing id alone. Repeated rows are packed each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches
from .tokens import encoder, vocabulary

WINDOW = 1024
CLOSING_ID = 0
#: Open windows of a task, 4 KB each.
OPEN_WINDOWS = 8192
OUT_ROWS = 2048

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])

#: A piece: document, start, ids of four bytes, tokens of the document.
Piece = tuple[int | None, int, bytes, int]


class LevelArray:
    """Open windows by fill level."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.clear()

    def clear(self) -> None:
        window = self.window
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.windows = 0
        # Change of the sum of squares when a window leaves or enters a level.
        self.leave = np.full(window, np.inf)
        self.leave[0] = 0
        self.enter = np.ones(window + 1)
        self.enter[window] = 0

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.leave[level] = 1 - 2 * n if n else np.inf
        self.enter[level] = 1 + 2 * n

    def place(self, piece: Piece, size: int) -> list[Piece] | None:
        """Put a piece shorter than a window into a level; a window that this fills."""
        change = self.leave[: self.window - size + 1] + self.enter[size:]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces: list[Piece] = []
        if level:
            pieces = self.open[level].pop()
            self.windows -= 1
            self._count(level)
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.add(pieces, level + size)
        return None

    def add(self, pieces: list[Piece], level: int) -> None:
        self.open[level].append(pieces)
        self.windows += 1
        self._count(level)

    def drain(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Full windows made of the open ones by cutting the emptiest; and what is left over."""
        stock = [(level, pieces) for level in range(1, self.window) for pieces in self.open[level]]
        self.clear()
        full, low, high = [], 0, len(stock) - 1
        spare: list[Piece] = []  # reversed: the next piece is the last
        while low <= high:
            fill, pieces = stock[high]
            high -= 1
            while fill < self.window:
                if not spare:
                    if low > high:
                        break
                    spare = stock[low][1][::-1]
                    low += 1
                head, rest = cut(spare.pop(), self.window - fill)
                pieces.append(head)
                fill += len(head[2]) // 4
                if rest:
                    spare.append(rest)
            if fill < self.window:
                return full, pieces
            full.append(pieces)
        size = sum(len(p[2]) for p in spare) // 4
        return full, spare[::-1] if size else []


def cut(piece: Piece, tokens: int) -> tuple[Piece, Piece | None]:
    """The first ``tokens`` of a piece, and the rest if there is any."""
    doc, start, ids, total = piece
    if len(ids) <= 4 * tokens:
        return piece, None
    return (doc, start, ids[: 4 * tokens], total), (doc, start + tokens, ids[4 * tokens :], total)


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Windows whose fills are the powers of two that add up to the pieces' tokens."""
    left = sum(len(p[2]) for p in pieces) // 4
    rest = pieces[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        window = []
        while want:
            head, tail = cut(rest.pop(), want)
            window.append(head)
            want -= len(head[2]) // 4
            if tail:
                rest.append(tail)
        yield window


def pack_documents(
    documents: Iterator[tuple[int | None, bytes]], window: int = WINDOW, open_windows: int = OPEN_WINDOWS
) -> Iterator[list[Piece]]:
    """Windows out of (document, ids), each a list of pieces in order."""
    levels = LevelArray(window)
    wide = 4 * window
    for doc, ids in documents:
        total = len(ids) // 4
        whole = len(ids) // wide * wide
        for at in range(0, whole, wide):
            yield [(doc, at // 4, ids[at : at + wide], total)]
        if whole < len(ids):
            filled = levels.place((doc, whole // 4, ids[whole:], total), (len(ids) - whole) // 4)
            if filled:
                yield filled
            if levels.windows > open_windows:
                full, left = levels.drain()
                yield from full
                if left:
                    levels.add(left, sum(len(p[2]) for p in left) // 4)
    full, left = levels.drain()
    yield from full
    yield from powers_of_two(left)


def pack(
    docs: DataFrame, window: int = WINDOW, tokenizer: tuple[str, str] | None = None, closing_id: int = CLOSING_ID
) -> DataFrame:
    """Pieces of the documents (doc_id, text), with their ids and places in sequences."""
    paths = tokenizer or vocabulary()
    small_batches(docs.sparkSession)
    closing = int(closing_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(*paths, True).encode
        sequence = TaskContext.get().partitionId() << 33
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
        ])

        def documents():
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    yield doc.as_py(), encode(text.as_py() or "") + closing

        rows: list[tuple] = []
        for pieces in pack_documents(documents(), window):
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1
            if len(rows) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, PIECES)
