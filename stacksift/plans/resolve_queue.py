"""Resolution jobs: sync, drain in bounded batches, second-stage review, export."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import record_fingerprint
from ..operators import jobs as queue
from ..operators import publish as export
from ..operators import resolve, review
from ..operators.ordinals import head
from ..schemas import EVIDENCE_CACHE, JOBS, RESULTS, REVIEW_STATE
from ..session import cut_lineage
from ..sources import deltas
from ..sources.snapshots import publish, read_current

RESULT_VERSION = 1
#: Jobs are stored by status and queue time, so that claims skip what is not pending.
JOB_KEYS, JOB_CLUSTER = ["id"], ["status", "queued_at"]
REVIEW_KEYS = ["id", "fingerprint", "worker_version"]
Find = Callable[[DataFrame], DataFrame]


def fingerprinted(catalog: DataFrame) -> DataFrame:
    print_ = record_fingerprint(
        F.col("title"), F.col("source_url"), F.col("post_date"), F.col("genres"),
        F.col("details.description"), RESULT_VERSION,
    )
    return catalog.select("id", "title", print_.alias("fingerprint"))


def sync(spark: SparkSession, catalog: DataFrame, root: str, now: datetime) -> dict:
    """Sync the stored queue with the catalog and drop void results."""
    jobs = read_current(spark, f"{root}/jobs", JOBS)
    synced = queue.sync_jobs(fingerprinted(catalog), jobs, now)
    results = queue.void_results(read_current(spark, f"{root}/results", RESULTS), synced)
    synced = cut_lineage(synced)
    stats = queue.sync_stats(synced).first().asDict()
    deltas.replace(results, f"{root}/results", ["id"], now)
    deltas.replace(synced.drop("outcome"), f"{root}/jobs", JOB_KEYS, now, JOB_CLUSTER)
    return stats


def run_batch(spark: SparkSession, root: str, find: Find, n: int, now: datetime) -> dict:
    """Claim ``n`` jobs, look up evidence for titles not cached yet, decide, write back.

    The claim is written before the work starts, so an interrupted batch is visible as
    jobs in processing and is recovered by the next sync. All that is written are deltas
    with the rows of the batch; the tables are compacted when their sizes ask for it.
    """
    working = cut_lineage(queue.in_work(queue.oldest_pending(read_current(spark, f"{root}/jobs", JOBS), n), now))
    deltas.append(working, f"{root}/jobs", JOB_KEYS, now, JOB_CLUSTER)
    mine = working.select("id", "title")

    cache = read_current(spark, f"{root}/cache", EVIDENCE_CACHE)
    looked_up = resolve.cache_lookup(mine, cache)
    missing = looked_up.filter(F.col("evidence").isNull()).select("title").distinct()
    found = resolve.two_pass(missing, find)
    # A failed search is an outcome of its jobs and is not cached.
    errors = cut_lineage(resolve.search_errors(found))
    answered = missing.join(errors.select("title"), "title", "left_anti")
    fresh = resolve.evidence_cache(found, answered, F.lit(now).cast("timestamp"))
    hits = looked_up.filter(F.col("evidence").isNotNull()).count()
    deltas.append(fresh.select(*cache.columns), f"{root}/cache", ["search_title"], now)

    decided = cut_lineage(resolve.decide(mine, read_current(spark, f"{root}/cache", EVIDENCE_CACHE)))
    results = resolve.results_of(
        decided, "deterministic", "deterministic match", RESULT_VERSION, F.lit(now).cast("timestamp")
    )
    stored = read_current(spark, f"{root}/results", RESULTS)
    deltas.append(results.select(*stored.columns), f"{root}/results", ["id"], now)
    error = F.when(F.col("outcome") == "review", F.col("reason"))
    failed = mine.join(errors, "title").join(decided.select("id"), "id", "left_anti").select(
        "id", F.when(F.col("transient"), "deferred").otherwise("failed").alias("outcome"), "error"
    )
    outcomes = cut_lineage(decided.select("id", "outcome", error.alias("error")).unionByName(failed))
    stats = queue.outcome_stats(outcomes, ["done", "review", "failed", "deferred"]).first().asDict()
    deltas.append(queue.apply_outcomes(working, outcomes, now), f"{root}/jobs", JOB_KEYS, now, JOB_CLUSTER)
    for name, schema in (("jobs", JOBS), ("cache", EVIDENCE_CACHE), ("results", RESULTS)):
        if deltas.is_log(spark, f"{root}/{name}"):
            deltas.compact(spark, f"{root}/{name}", schema, now)
    return {**stats, "cache_hits": hits}


def pending_count(spark: SparkSession, root: str) -> int:
    return read_current(spark, f"{root}/jobs", JOBS).filter("active and status = 'pending'").count()


def drain(
    spark: SparkSession, root: str, find: Find, batch_size: int, clock: Callable[[], datetime],
    max_stagnant: int = queue.STAGNANT_BATCHES, max_batches: int = 0,
) -> list[dict]:
    """Run batches until nothing is pending, or several batches made no progress."""
    log: list[dict] = []
    stagnant = 0
    while not max_batches or len(log) < max_batches:
        before = pending_count(spark, root)
        if before == 0:
            break
        stats = run_batch(spark, root, find, min(batch_size, before), clock())
        after = pending_count(spark, root)
        log.append({"batch": len(log) + 1, "pending_before": before, "pending_after": after, **stats})
        stagnant = stagnant + 1 if after >= before else 0
        if after == 0 or stagnant >= max_stagnant:
            break
    return log


def review_round(
    spark: SparkSession, catalog: DataFrame, root: str, answer: Callable[[DataFrame], DataFrame],
    n: int, now: datetime, threshold: float = review.REVIEW_THRESHOLD,
) -> dict:
    """One second-stage round of at most ``n`` decisions, unless the first stage has work.

    ``answer`` maps request rows to ``id, response`` rows.
    """
    jobs = read_current(spark, f"{root}/jobs", JOBS)
    if queue.stage_counts(jobs).first()["busy"]:
        return {"yielded": True}
    state = read_current(spark, f"{root}/review", REVIEW_STATE)
    cache = read_current(spark, f"{root}/cache", EVIDENCE_CACHE)
    judged = review.eligibility(review.work(jobs, state), catalog, cache)
    # Only decisions count towards the limit; jobs that can't be decided are all recorded.
    asked = head(judged.filter(F.col("ineligible").isNull()), review.work_order(), n)
    eligible = asked.unionByName(judged.filter(F.col("ineligible").isNotNull()))
    stamp = F.lit(now).cast("timestamp")
    # Answers may be costly and need not be repeatable: they are stored before they are used.
    whole = review.whole_requests(*review.requests(eligible, cache))
    publish(answer(whole).select("id", "response"), f"{root}/responses", now)
    responses = read_current(spark, f"{root}/responses", "id string, response string")
    rows = review.outcomes(eligible, responses, cache, threshold)
    publish(rows.withColumn("attempted_at", stamp), f"{root}/round", now)
    rows = spark.read.parquet(_current_folder(spark, f"{root}/round"))

    new_state = rows.select(*state.columns)
    results = resolve.results_of(rows, "review", "candidate selected in review", RESULT_VERSION, stamp)
    stored = read_current(spark, f"{root}/results", RESULTS)
    deltas.append(results.select(*stored.columns), f"{root}/results", ["id"], now)
    resolved = rows.filter(F.col("status") == "resolved").select(
        "id", F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("error")
    )
    moved = jobs.join(resolved.select("id"), "id", "left_semi")
    deltas.append(queue.apply_outcomes(moved, resolved, now), f"{root}/jobs", JOB_KEYS, now, JOB_CLUSTER)
    deltas.append(new_state, f"{root}/review", REVIEW_KEYS, now)
    stats = queue.outcome_stats(rows, ["resolved", "unresolved", "ineligible", "error"], "status").first()
    return {"yielded": False, **stats.asDict()}


def _current_folder(spark: SparkSession, root: str) -> str:
    from ..sources.snapshots import current

    return current(spark, root)[1]


def export_public(
    spark: SparkSession, root: str, target: str, now: datetime, hosts: list[str], suffixes: list[str],
    min_confidence: float = export.MIN_CONFIDENCE,
) -> dict:
    """Publish the public snapshot when it differs from the current one."""
    jobs = read_current(spark, f"{root}/jobs", JOBS)
    rows = export.eligible(jobs, read_current(spark, f"{root}/results", RESULTS), min_confidence)
    built = export.entries(rows, hosts, suffixes)
    counts = export.export_counts(built).first().asDict()
    return {**counts, "changed": publish(export.snapshot(built), target, now)}
