"""A stored inverted index that changes record by record.

The index is a log of segments. A segment has postings in key order, and marks: the records
it speaks for. A posting counts unless a later segment marks its record, so a changed record
is a mark and its new postings, and a removed one is a mark alone; older postings stay where
they are. Lookups read the postings of their keys out of every segment, by row groups, and
leave out what later marks void; marks of all changes since the last base are one small table.

Merging is by size, as for state tables: neighbouring segments of one size become one, and all
become a new base once the changes have half its bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import postings
from . import deltas
from .folders import folder_bytes

AT = "_commit"


@dataclass(frozen=True)
class SegmentedIndex:
    """Prefix and gram postings of records that are known by the column ``key`` of type ``kind``."""

    spark: SparkSession
    root: str
    key: str = "id"
    kind: str = "string"

    def _schema(self) -> str:
        return f"kind string, key string, `{self.key}` {self.kind}, {AT} long"

    def _marks(self, segments: list[deltas.Segment]) -> DataFrame:
        """The last change of every record that ``segments`` mark."""
        schema = f"`{self.key}` {self.kind}, {AT} long"
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.folder}/marks" for s in segments])
        return rows.groupBy(self.key).agg(F.max(AT).alias(AT))

    def _valid(self, segments: list[deltas.Segment]) -> DataFrame:
        """The postings of ``segments`` that none of them voids, with their commit."""
        if not segments:
            return self.spark.createDataFrame([], self._schema())
        rows = self.spark.read.schema(self._schema()).parquet(*[f"{self.root}/{s.folder}/postings" for s in segments])
        changes = [s for s in segments if not s.base]
        if not changes:
            return rows
        marks = self._marks(changes).withColumnRenamed(AT, "_last")
        return rows.join(marks, (rows[self.key] == marks[self.key]) & (rows[AT] < marks["_last"]), "left_anti")

    def _write(self, found: DataFrame, marks: DataFrame | None, base: bool, low: int, high: int, number: int, now: datetime) -> None:
        folder = f"{'base' if base else 'segment'}-{number}-{uuid.uuid4().hex}"
        sorted_ = found.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key", self.key)
        sorted_.write.parquet(f"{self.root}/{folder}/postings")
        if marks is not None:
            marks.write.parquet(f"{self.root}/{folder}/marks")
        rows = self.spark.read.schema(self._schema()).parquet(f"{self.root}/{folder}/postings").count()
        made = deltas.Segment(number, folder, base, low, high, rows, folder_bytes(self.spark, f"{self.root}/{folder}"))
        deltas.commit(self.spark, self.root, made, now, [self.key], ["kind", "key"])
        deltas.vacuum(self.spark, self.root)

    def _postings_of(self, records: DataFrame, words: Column | str, number: int) -> DataFrame:
        return postings(records, self.key, words).withColumn(AT, F.lit(number).cast("long"))

    def build(self, records: DataFrame, words: Column | str, now: datetime) -> None:
        """Index all of ``records``; their ids must differ. Earlier segments are void."""
        number = deltas.last_commit(self.spark, self.root) + 1
        self._write(self._postings_of(records, words, number), None, True, 1, number, number, now)

    def update(self, records: DataFrame, words: Column | str, now: datetime, removed: DataFrame | None = None) -> None:
        """Take new and changed ``records``, each once, and leave out the ids of ``removed``."""
        number = deltas.last_commit(self.spark, self.root) + 1
        touched = records.select(self.key)
        if removed is not None:
            touched = touched.unionByName(removed.select(self.key))
        marks = touched.distinct().withColumn(AT, F.lit(number).cast("long"))
        self._write(self._postings_of(records, words, number), marks, False, number, number, number, now)

    def postings(self) -> DataFrame:
        """All postings that count: ``kind, key`` and the record's id."""
        return self._valid(deltas.state(self.spark, self.root).live).drop(AT)

    def merge(self, now: datetime) -> str | None:
        """Merge segments where their sizes ask for it: ``base``, ``segment`` or None."""
        found = deltas.state(self.spark, self.root)
        changes = sorted((s for s in found.live if not s.base), key=lambda s: s.high)
        held = sum(s.bytes for s in found.live if s.base)
        number = found.last + 1
        if len(changes) > 1 and sum(s.bytes for s in changes) >= deltas.SHARE * held:
            self._write(self._valid(found.live), None, True, 1, number, number, now)
            return "base"
        run = deltas.run_of_one_size(changes)
        if not run:
            return None
        self._write(self._valid(run), self._marks(run), False, run[0].low, run[-1].high, number, now)
        return "segment"
