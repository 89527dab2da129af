"""Queue of catalog records to resolve, kept as a state table.

A queue is a DataFrame with one row per id. Every function returns the next state of the
queue; storing it is the caller's step, as a new generation of the state table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordinals import head

# --- Fixed values -----------------------------------------------------------
ERROR_CHARS = 1200
STAGNANT_BATCHES = 3
MAX_ERROR_ATTEMPTS = 3
# -----------------------------------------------------------------------------


def _no_time() -> Column:
    return F.lit(None).cast("timestamp")


def sync_jobs(catalog: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Bring the queue in line with the catalog ``(id, title, fingerprint)``.

    Adds ``outcome``: ``created``, ``changed`` (new fingerprint), ``recovered`` (was being
    processed, or had been removed), ``unchanged`` or ``removed``. Results of changed and
    recovered ids are void, see ``void_results``. Of a repeated id the row with the
    smallest title and fingerprint counts.
    """
    new = catalog.groupBy("id").agg(F.min(F.struct("title", "fingerprint")).alias("_new"))
    both = new.join(jobs, "id", "full_outer")
    stamp = F.lit(now).cast("timestamp")
    outcome = (
        F.when(F.col("_new").isNull(), "removed")
        .when(F.col("status").isNull(), "created")
        .when(F.col("fingerprint") != F.col("_new.fingerprint"), "changed")
        .when(F.col("status").isin("processing", "removed"), "recovered")
        .otherwise("unchanged")
    )
    both = both.withColumn("outcome", outcome)
    kind = F.col("outcome")
    restart = kind.isin("created", "changed")
    requeue = restart | (kind == "recovered")
    gone = kind == "removed"
    return both.select(
        "id",
        F.when(gone, F.col("title")).otherwise(F.trim("_new.title")).alias("title"),
        F.when(gone, F.col("fingerprint")).otherwise(F.col("_new.fingerprint")).alias("fingerprint"),
        F.when(gone, "removed").when(requeue, "pending").otherwise(F.col("status")).alias("status"),
        (~gone).alias("active"),
        F.when(restart, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(requeue, None).otherwise(F.col("last_error")).alias("last_error"),
        F.when(requeue, stamp).otherwise(F.col("queued_at")).alias("queued_at"),
        F.when(requeue, _no_time()).otherwise(F.col("started_at")).alias("started_at"),
        F.when(requeue, _no_time()).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(gone & (F.col("status") == "removed"), F.col("updated_at")).otherwise(stamp).alias("updated_at"),
        "outcome",
    )


def void_results(results: DataFrame, synced: DataFrame) -> DataFrame:
    """Results without those of changed and recovered jobs."""
    stale = synced.filter(F.col("outcome").isin("changed", "recovered")).select("id")
    return results.join(stale, "id", "left_anti")


def sync_stats(synced: DataFrame) -> DataFrame:
    """Rows per outcome, and active rows, as one row."""
    names = ["created", "changed", "recovered", "unchanged", "removed"]
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    return synced.agg(*counts, F.count_if(F.col("active")).alias("total"))


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Active rows per status, and their ``total``."""
    counted = jobs.filter("active").rollup("status").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.coalesce("status", F.lit("total")).alias("status"), "rows")


def queue_order() -> list[Column]:
    return [F.col("queued_at"), F.col("id")]


def oldest_pending(jobs: DataFrame, n: int) -> DataFrame:
    return head(jobs.filter(F.col("active") & (F.col("status") == "pending")), queue_order(), n)


def in_work(rows: DataFrame, now: datetime) -> DataFrame:
    """Claimed ``rows`` as they stand in the queue from now on."""
    stamp = F.lit(now).cast("timestamp")
    return rows.withColumns(
        {
            "status": F.lit("processing"), "attempts": F.col("attempts") + 1, "started_at": stamp,
            "last_error": F.lit(None).cast("string"), "updated_at": stamp,
        }
    )


def claim(jobs: DataFrame, n: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Claim the ``n`` oldest pending jobs: the claimed rows, and the queue with them in work."""
    oldest = oldest_pending(jobs, n)
    marked = jobs.join(oldest.select("id", F.lit(True).alias("_mine")), "id", "left")
    mine = F.coalesce(F.col("_mine"), F.lit(False))
    stamp = F.lit(now).cast("timestamp")
    queue = marked.withColumns(
        {
            "status": F.when(mine, "processing").otherwise(F.col("status")),
            "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "started_at": F.when(mine, stamp).otherwise(F.col("started_at")),
            "last_error": F.when(mine, None).otherwise(F.col("last_error")),
            "updated_at": F.when(mine, stamp).otherwise(F.col("updated_at")),
        }
    ).drop("_mine")
    return oldest, queue


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: datetime, back_of_queue: bool = False) -> DataFrame:
    """Write ``outcomes`` (``id, outcome, error``) back into the queue.

    ``done``, ``review`` and ``failed`` finish a job. ``deferred`` makes it pending again;
    ``back_of_queue`` then stamps a new queue time, otherwise it keeps its place.
    """
    found = outcomes.select("id", F.col("outcome").alias("_to"), F.left("error", F.lit(ERROR_CHARS)).alias("_error"))
    both = jobs.join(found, "id", "left")
    hit = F.col("_to").isNotNull()
    deferred = hit & (F.col("_to") == "deferred")
    stamp = F.lit(now).cast("timestamp")
    queued = F.when(deferred, stamp).otherwise(F.col("queued_at")) if back_of_queue else F.col("queued_at")
    return both.withColumns(
        {
            "status": F.when(deferred, "pending").when(hit, F.col("_to")).otherwise(F.col("status")),
            "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
            "queued_at": queued,
            "started_at": F.when(deferred, _no_time()).otherwise(F.col("started_at")),
            "finished_at": F.when(deferred, _no_time()).when(hit, stamp).otherwise(F.col("finished_at")),
            "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
        }
    ).drop("_to", "_error")


def requeue(jobs: DataFrame, status: str, now: datetime) -> DataFrame:
    """Send every active job of a status back to the end of the queue."""
    hit = F.col("active") & (F.col("status") == status)
    stamp = F.lit(now).cast("timestamp")
    return jobs.withColumns(
        {
            "status": F.when(hit, "pending").otherwise(F.col("status")),
            "last_error": F.when(hit, None).otherwise(F.col("last_error")),
            "queued_at": F.when(hit, stamp).otherwise(F.col("queued_at")),
            "started_at": F.when(hit, _no_time()).otherwise(F.col("started_at")),
            "finished_at": F.when(hit, _no_time()).otherwise(F.col("finished_at")),
            "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
        }
    )


def recover_interrupted(jobs: DataFrame, now: datetime) -> DataFrame:
    """Work cut short by a stopped run becomes pending again."""
    hit = F.col("status") == "processing"
    return jobs.withColumns(
        {
            "status": F.when(hit, "pending").otherwise(F.col("status")),
            "last_error": F.when(hit, "interrupted activation").otherwise(F.col("last_error")),
            "updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    )


def may_run(status: Column, attempts: Column, max_attempts: int = MAX_ERROR_ATTEMPTS) -> Column:
    """Pending work, and errors with attempts left."""
    return (status == "pending") | ((status == "error") & (attempts < max_attempts))


def stage_counts(jobs: DataFrame) -> DataFrame:
    """First-stage load: ``pending``, ``processing`` and ``busy``, one row."""
    active = jobs.filter("active")
    pending, working = F.count_if(F.col("status") == "pending"), F.count_if(F.col("status") == "processing")
    return active.agg(pending.alias("pending"), working.alias("processing"), ((pending + working) > 0).alias("busy"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of ``fresh`` in place of rows of the same key."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def stagnation(log: DataFrame, run: str, batch: str, before: str, after: str, limit: int = STAGNANT_BATCHES) -> DataFrame:
    """Length of the no-progress streak after every batch of a run, and whether to stop.

    A streak grows while a batch leaves at least as many pending jobs as it found.
    """
    ordered = Window.partitionBy(run).orderBy(batch)
    moved = (F.col(before) - F.col(after)) > 0
    island = log.withColumn("progress", F.col(before) - F.col(after)).withColumn(
        "_island", F.sum(moved.cast("int")).over(ordered)
    )
    inside = Window.partitionBy(run, "_island").orderBy(batch)
    still = (F.col("progress") <= 0).cast("int")
    return (
        island.withColumn("streak", F.sum(still).over(inside))
        .withColumn("stop", (F.col("streak") >= limit) | (F.col(after) <= 0))
        .drop("_island")
    )


def run_stats(log: DataFrame, counters: list[str]) -> DataFrame:
    """Totals of a batch log, one row."""
    return log.agg(F.count(F.lit(1)).alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def outcome_stats(outcomes: DataFrame, names: list[str], column: str = "outcome") -> DataFrame:
    """Rows processed and rows per outcome, one row."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col(column) == n).alias(n) for n in names]
    )
