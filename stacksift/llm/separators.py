"""Token counts of documents in flat token files that have no index.

A flat file is ids one after another, each document closed by an end-of-document id, cut
into blocks without regard to documents. Every block is searched on its own, by one
vectorised comparison. A prefix scan over one summary row per block (tokens, documents
ended, position of the last end) then tells every block where its first document began and
how many documents ended before it, so documents that run over blocks are stitched without
moving any ids. The scan works on chunks of blocks first and on chunk totals after, so a
file of any length is no single group.

Defined cases: an empty document counts 0; ids after the last end of a file are a last
document with ``ended`` false; a file without ids has no documents. Blocks are numbered
from 0 in a file; their sizes may differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .tokens import encoder, vocabulary

END_ID = 50256
BLOCK_TOKENS = 65_536
CHUNK_BLOCKS = 1024

FLAT = T.StructType([
    T.StructField("file", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("doc_id", T.LongType()),
])


def flat_tokens(
    docs: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS,
    tokenizer: tuple[str, str] | None = None,
) -> DataFrame:
    """Token blocks of documents, one flat file per partition, with ids of ``width`` bytes.

    Rows with ``block`` hold ids; rows with ``ordinal`` and no block tell which document
    came when, and are no index: they have no positions.
    """
    paths = tokenizer or vocabulary()
    small_batches(docs.sparkSession)
    size = block_tokens * width

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(*paths, False).encode
        file, block, ordinal = TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(width, "little")
        held = bytearray()
        schema = pa.schema([
            ("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64()),
        ])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "")
                held += np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end
                rows.append((file, None, None, ordinal, doc.as_py()))
                ordinal += 1
                if len(held) >= size:
                    whole = len(held) // size * size
                    for at in range(0, whole, size):
                        rows.append((file, block, bytes(held[at : at + size]), None, None))
                        block += 1
                    del held[:whole]
            if rows:
                yield out(rows)
        if held:
            yield out([(file, block, bytes(held), None, None)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, FLAT)


def block_rows(files: DataFrame, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, ids) of whole files read as (path, content), such as Spark's binaryFile rows."""
    size = block_tokens * width
    blocks = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1))
    return files.select(
        F.xxhash64("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")
    ).select("file", "block", F.col("content").substr((F.col("block") * size + 1).cast("int"), F.lit(size)).alias("ids"))


SCANNED = T.StructType([
    T.StructField("file", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("ends", T.ArrayType(T.LongType())),
])


def block_ends(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Per block its tokens and the places of the end-of-document id."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ends, tokens = [], []
            for ids in batch.column(2):
                found = np.frombuffer(ids.as_py() or b"", f"<u{width}")
                ends.append(np.flatnonzero(found == end_id).astype("int64"))
                tokens.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "tokens", "ends"],
            )

    small_batches(blocks.sparkSession)
    return blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), "ids").mapInArrow(run, SCANNED)


def prefix_scan(scanned: DataFrame) -> DataFrame:
    """Blocks with ``base`` tokens and ``before`` documents ahead, and where the open document began."""
    sums = scanned.select(
        "file", "block", F.floor(F.col("block") / CHUNK_BLOCKS).alias("chunk"), "tokens",
        F.size("ends").cast("long").alias("ended"), F.try_element_at("ends", F.lit(-1)).alias("last"),
    )
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(
        "file", "block", "chunk", "tokens", "ended", "last",
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("base"),
        F.coalesce(F.sum("ended").over(inside), F.lit(0)).alias("before"),
    ).withColumn("began", F.max(F.col("base") + F.col("last") + 1).over(inside))
    chunks = first.groupBy("file", "chunk").agg(
        F.sum("tokens").alias("tokens"), F.sum("ended").alias("ended"),
        F.max(F.col("base") + F.col("last") + 1).alias("last"),
    )
    across = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = chunks.select(
        "file", "chunk", "last",
        F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("chunk_base"),
        F.coalesce(F.sum("ended").over(across), F.lit(0)).alias("chunk_before"),
    ).withColumn("chunk_began", F.max(F.col("chunk_base") + F.col("last")).over(across)).drop("last")
    return first.join(ahead, ["file", "chunk"]).select(
        "file", "block", (F.col("base") + F.col("chunk_base")).alias("base"),
        (F.col("before") + F.col("chunk_before")).alias("before"),
        F.coalesce(F.col("began") + F.col("chunk_base"), F.col("chunk_began"), F.lit(0)).alias("began"),
    )


def count_tokens(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Documents of flat files: file, ordinal, start, n_tokens without the end, ended."""
    scanned = written(block_ends(blocks, end_id, width), "separators")
    placed = scanned.join(prefix_scan(scanned), ["file", "block"])
    ended = placed.filter(F.size("ends") > 0).select(
        "file", "before", "base", "began", "ends", F.posexplode("ends").alias("at", "end")
    ).select(
        "file", (F.col("before") + F.col("at")).alias("ordinal"),
        F.when(F.col("at") > 0, F.col("base") + F.get("ends", F.col("at") - 1) + 1).otherwise(F.col("began")).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"), F.lit(True).alias("ended"),
    )
    tails = placed.groupBy("file").agg(
        F.sum(F.size("ends").cast("long")).alias("ordinal"),
        F.coalesce(F.max(F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1), F.lit(0)).alias("start"),
        F.max(F.col("base") + F.col("tokens")).alias("stop"), F.lit(False).alias("ended"),
    ).filter(F.col("stop") > F.col("start"))
    return ended.unionByName(tails).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended"
    )


def document_tokens(docs: DataFrame) -> DataFrame:
    """Tokens of documents by way of flat files: doc_id, file, ordinal, start, n_tokens."""
    flat = written(flat_tokens(docs), "flat-tokens")
    named = flat.filter(F.col("block").isNull()).select("file", "ordinal", "doc_id")
    blocks = flat.filter(F.col("block").isNotNull()).select("file", "block", "ids")
    return count_tokens(blocks).join(named, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
