"""State tables as logs of deltas: a write costs what it changes.

A table is a folder of segments and a log of commits. A delta holds new versions of some
rows, or marks keys as gone; of a key the row with the largest commit number counts. A base
holds every key once. Each segment covers a range of commits and stands for all segments
whose ranges lie within its own.

Readers take the base without the keys that deltas have, and the newest row of each key in
the deltas: the base is not shuffled while the deltas are small enough to be sent to it.

Compaction is by size. Four neighbouring deltas of about one size become one; once all
deltas together have half the bytes of the base, everything becomes a new base. So a row
is rewritten a number of times that grows with the logarithm of the table. Bases are sorted by the
``cluster`` columns, so that filters on them skip what they don't need.

A segment is visible once its commit is in the log. Of two writers that take the same
number, the one with the larger folder name fails; what it wrote is not read. Segments that
others stand for stay for the readers of the last ``KEPT`` commits.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import delete_folder, folder_bytes, path_exists

COMMIT = (
    "number bigint, folder string, base boolean, low bigint, high bigint, written_at timestamp, rows bigint, bytes bigint,"
    " keys array<string>, cluster array<string>"
)
#: Neighbouring deltas of one size that become one; sizes are one up to this factor.
FAN = 4
#: Share of the base's bytes at which deltas are merged into it.
SHARE = 0.5
KEPT = 4
#: Columns that segments have beside those of the table.
AT, GONE = "_commit", "_gone"


class Segment(NamedTuple):
    number: int
    folder: str
    base: bool
    low: int
    high: int
    rows: int
    bytes: int


def _log(root: str) -> str:
    return f"{root}/log"


def is_log(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, _log(root))


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All commits that hold, oldest first; of two with one number the smaller folder's."""
    rows = spark.read.schema(COMMIT).parquet(f"{_log(root)}/*")
    held = rows.groupBy("number").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "number"]), "folder").alias("c"))
    return held.select("number", "c.*").orderBy("number")


class State(NamedTuple):
    """Live and superseded segments, the last commit's number, the key and the cluster columns."""

    live: list[Segment]
    old: list[Segment]
    last: int
    keys: list[str]
    cluster: list[str]


def state(spark: SparkSession, root: str) -> State:
    """What the log says. It has a row for each live segment and a few more, since compaction bounds their number."""
    if not is_log(spark, root):
        return State([], [], 0, [], [])
    rows = commits(spark, root).collect()
    found = [Segment(r["number"], r["folder"], r["base"], r["low"], r["high"], r["rows"], r["bytes"]) for r in rows]

    def superseded(s: Segment) -> bool:
        return any(o.number > s.number and o.low <= s.low and s.high <= o.high for o in found)

    old = [s for s in found if superseded(s)]
    return State([s for s in found if s not in old], old, rows[-1]["number"], rows[-1]["keys"], rows[-1]["cluster"])


def written_bytes(spark: SparkSession, root: str, after: int = 0) -> int:
    """Bytes that the commits later than number ``after`` wrote, as far as the log has them."""
    return commits(spark, root).filter(F.col("number") > after).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def last_commit(spark: SparkSession, root: str) -> int:
    return state(spark, root).last


def commit(spark: SparkSession, root: str, made: Segment, now: datetime, keys: list[str], cluster: list[str]) -> None:
    """Make a written segment visible; fails where another one has its number."""
    line = spark.createDataFrame([(*made[:5], now, *made[5:], list(keys), list(cluster))], COMMIT)
    line.coalesce(1).write.parquet(f"{_log(root)}/{made.number}-{made.folder}")
    if commits(spark, root).filter(F.col("number") == made.number).first()["folder"] != made.folder:
        raise RuntimeError(f"another writer made commit {made.number} of {root}")


def _folder(spark: SparkSession, rows: DataFrame, root: str, kind: str, number: int) -> tuple[str, DataFrame]:
    name = f"{kind}-{number}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    return name, spark.read.schema(rows.schema).parquet(f"{root}/{name}")


def _check_keys(written: DataFrame, keys: list[str], path: str) -> int:
    """The number of rows; fails where a key is null or repeats."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    facts = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(bad.cast("int")).alias("bad")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if((F.col("n") > 1) | (F.col("bad") == 1)).alias("wrong")
    ).first()
    if facts["wrong"]:
        raise ValueError(f"{facts['wrong']} keys of {path} are null or repeated")
    return facts["rows"]


def append(rows: DataFrame, root: str, keys: list[str], now: datetime, cluster: list[str] = (), gone: Column | None = None) -> int:
    """Commit new versions of ``rows``, one per key; where ``gone`` holds, the key leaves the table.

    Returns the number of rows; none is no commit.
    """
    spark = rows.sparkSession
    number = last_commit(spark, root) + 1
    marked = rows.withColumns({AT: F.lit(number).cast("long"), GONE: F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)})
    folder, written = _folder(spark, marked, root, "delta", number)
    try:
        count = _check_keys(written, keys, f"{root}/{folder}")
    except ValueError:
        delete_folder(spark, f"{root}/{folder}")
        raise
    if not count:
        delete_folder(spark, f"{root}/{folder}")
        return 0
    commit(spark, root, Segment(number, folder, False, number, number, count, folder_bytes(spark, f"{root}/{folder}")), now, keys, cluster)
    return count


def changed(rows: DataFrame, root: str, keys: list[str], ignore: list[str] = ()) -> DataFrame:
    """The rows whose stored version is missing or differs in a column that is not ignored."""
    columns = [c for c in rows.columns if c not in ignore]
    stored = read(rows.sparkSession, root, rows.schema)
    known = stored.select(*keys, F.struct(*columns).alias("_known"))
    return rows.join(known, keys, "left").filter(~F.col("_known").eqNullSafe(F.struct(*columns))).drop("_known")


def upsert(rows: DataFrame, root: str, keys: list[str], now: datetime, cluster: list[str] = (), ignore: list[str] = ()) -> int:
    """Commit the rows that differ from their stored version, and nothing where none does."""
    return append(changed(rows, root, keys, ignore).select(*rows.columns), root, keys, now, cluster)


def replace(rows: DataFrame, root: str, keys: list[str], now: datetime, cluster: list[str] = ()) -> int:
    """Commit ``rows`` as the whole table."""
    spark = rows.sparkSession
    number = last_commit(spark, root) + 1
    marked = _clustered(rows.withColumns({AT: F.lit(number).cast("long"), GONE: F.lit(False)}), cluster)
    folder, written = _folder(spark, marked, root, "base", number)
    count = _check_keys(written, keys, f"{root}/{folder}")
    commit(spark, root, Segment(number, folder, True, 1, number, count, folder_bytes(spark, f"{root}/{folder}")), now, keys, cluster)
    vacuum(spark, root)
    return count


def _clustered(rows: DataFrame, cluster: list[str]) -> DataFrame:
    return rows.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else rows


def _load(spark: SparkSession, root: str, segments: list[Segment], schema) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{s.folder}" for s in segments])


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), AT).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def _merged(spark: SparkSession, root: str, segments: list[Segment], keys: list[str], schema) -> DataFrame:
    """The newest row of every key of live segments, those that are gone included."""
    base = [s for s in segments if s.base]
    deltas = [s for s in segments if not s.base]
    old = _load(spark, root, base, schema)
    if not deltas:
        return old
    new = _load(spark, root, deltas, schema)
    if len(deltas) > 1:
        new = _newest(new, keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new) if base else new


def _with_marks(schema):
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [StructField(f.name, f.dataType, True) for f in parsed.fields if f.name not in (AT, GONE)]
    return StructType([*fields, StructField(AT, LongType()), StructField(GONE, BooleanType())])


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table: the newest row of every key that is not gone; empty before the first commit."""
    now = state(spark, root)
    rows = _merged(spark, root, now.live, now.keys, _with_marks(schema))
    return rows.filter(~F.col(GONE)).drop(AT, GONE)


def run_of_one_size(deltas: list[Segment]) -> list[Segment]:
    """Neighbouring deltas, newest first, of one size; at least ``FAN`` or none."""
    best: list[Segment] = []
    for at in range(len(deltas)):
        run: list[Segment] = []
        for s in reversed(deltas[: len(deltas) - at]):
            sizes = [x.bytes for x in [*run, s]]
            if max(sizes) > FAN * max(1, min(sizes)):
                break
            run.append(s)
        if len(run) >= FAN and len(run) > len(best):
            best = run[::-1]
    return best


def compact(spark: SparkSession, root: str, schema, now: datetime) -> str | None:
    """Merge segments where their sizes ask for it: ``base``, ``delta`` or None for nothing to do."""
    found = state(spark, root)
    deltas = sorted((s for s in found.live if not s.base), key=lambda s: s.high)
    shape, number = _with_marks(schema), found.last + 1
    held = sum(s.bytes for s in found.live if s.base)
    run = run_of_one_size(deltas)
    if len(deltas) > 1 and sum(s.bytes for s in deltas) >= SHARE * held:
        rows = _clustered(_merged(spark, root, found.live, found.keys, shape).filter(~F.col(GONE)), found.cluster)
        kind, low, high = "base", 1, number
    elif run:
        rows = _newest(_load(spark, root, run, shape), found.keys)
        kind, low, high = "delta", run[0].low, run[-1].high
    else:
        return None
    folder, written = _folder(spark, rows, root, kind, number)
    made = Segment(number, folder, kind == "base", low, high, written.count(), folder_bytes(spark, f"{root}/{folder}"))
    commit(spark, root, made, now, found.keys, found.cluster)
    vacuum(spark, root)
    return kind


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete superseded segments, and their commits, that are older than the last ``KEPT`` commits."""
    found = state(spark, root)
    for s in found.old:
        if s.number <= found.last - KEPT:
            delete_folder(spark, f"{root}/{s.folder}")
            delete_folder(spark, f"{_log(root)}/{s.number}-{s.folder}")
