"""Queue states, outcomes, batch logs and the streaming life cycle."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.decisions import retry_seconds
from ...operators import jobs
from ...schemas import CANDIDATE_FIELDS, JOBS, RESULTS
from ...session import checkpoint_dir
from ...sources.snapshots import read_current
from ...streaming import arrivals, queue_state
from .. import resolve_queue, tables
from .registry import query

NOW = datetime(2002, 1, 1)
_NOW = "TIMESTAMP '2002-01-01'"

# Orders are the records: those from 1996 on are in the catalog now, those up to 1999 were
# queued when they came in, with the status their priority stands for. Partly filled
# orders have changed since.
STATUS_OF = {"1-URGENT": "processing", "2-HIGH": "done", "3-MEDIUM": "review", "4-NOT SPECIFIED": "removed", "5-LOW": "pending"}
_STATUS = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"

_STATE = f"""
jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title,
         sha256(CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE o_orderstatus END) AS fingerprint,
         {_STATUS} AS status, {_STATUS} <> 'removed' AS active, CAST(o_custkey % 5 AS INTEGER) AS attempts,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'unclear' END AS last_error, o_orderdate AS queued_at
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
catalog AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, sha256(o_orderstatus) AS fingerprint
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
synced AS (
  SELECT COALESCE(c.id, j.id) AS id,
    CASE WHEN c.id IS NULL THEN 'removed' WHEN j.id IS NULL THEN 'created'
         WHEN c.fingerprint <> j.fingerprint THEN 'changed'
         WHEN j.status IN ('processing', 'removed') THEN 'recovered' ELSE 'unchanged' END AS outcome,
    j.status, j.attempts, j.last_error, j.queued_at
  FROM catalog c FULL OUTER JOIN jobs j ON c.id = j.id),
queue AS (
  SELECT id, outcome,
    CASE WHEN outcome = 'removed' THEN 'removed' WHEN outcome = 'unchanged' THEN status ELSE 'pending' END AS status,
    outcome <> 'removed' AS active,
    CASE WHEN outcome IN ('created', 'changed') THEN 0 ELSE attempts END AS attempts,
    CASE WHEN outcome IN ('created', 'changed', 'recovered') THEN NULL ELSE last_error END AS last_error,
    CASE WHEN outcome IN ('created', 'changed', 'recovered') THEN {_NOW} ELSE queued_at END AS queued_at
  FROM synced)"""


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    orders = tables.table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("2000-01-01")))
    none = F.lit(None).cast("timestamp")
    state = F.element_at(status, F.col("o_orderpriority"))
    known = F.when(F.col("o_orderstatus") == "P", "open").otherwise(F.col("o_orderstatus"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.sha2(known, 256).alias("fingerprint"),
        state.alias("status"),
        (state != "removed").alias("active"),
        F.pmod("o_custkey", F.lit(5)).cast("int").alias("attempts"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "unclear").alias("last_error"),
        F.col("o_orderdate").cast("timestamp").alias("queued_at"),
        none.alias("started_at"),
        none.alias("finished_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def order_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01")))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.sha2("o_orderstatus", 256).alias("fingerprint"),
    )


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sync_jobs(order_catalog(spark, sf_dir), order_jobs(spark, sf_dir), NOW)


@query(f"WITH {_STATE} SELECT id, outcome, status, active, attempts, last_error, queued_at FROM queue")
def queue_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synced(spark, sf_dir).withColumn("queued_at", F.col("queued_at").cast("timestamp_ntz"))
    return rows.select("id", "outcome", "status", "active", "attempts", "last_error", "queued_at")


@query(f"""
WITH {_STATE}
SELECT count_if(outcome = 'created')::BIGINT AS created, count_if(outcome = 'changed')::BIGINT AS changed,
       count_if(outcome = 'recovered')::BIGINT AS recovered, count_if(outcome = 'unchanged')::BIGINT AS unchanged,
       count_if(outcome = 'removed')::BIGINT AS removed, count_if(active)::BIGINT AS total FROM queue""")
def queue_sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sync_stats(synced(spark, sf_dir))


@query(f"WITH {_STATE} SELECT j.id, j.fingerprint FROM jobs j JOIN queue q USING (id) WHERE outcome NOT IN ('changed', 'recovered')")
def queue_kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that survive a sync."""
    results = order_jobs(spark, sf_dir).select("id", "fingerprint")
    return jobs.void_results(results, synced(spark, sf_dir))


@query(f"""
WITH {_STATE}
SELECT status, count(*) AS rows FROM queue WHERE active GROUP BY status
UNION ALL SELECT 'total', count(*) FROM queue WHERE active""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_counts(synced(spark, sf_dir))


@query(f"""
WITH {_STATE}, mine AS (SELECT id FROM queue WHERE active AND status = 'pending' ORDER BY queued_at, id LIMIT 500)
SELECT id, CASE WHEN id IN (SELECT id FROM mine) THEN 'processing' ELSE status END AS status,
       attempts + CASE WHEN id IN (SELECT id FROM mine) THEN 1 ELSE 0 END AS attempts FROM queue""")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after claiming the 500 oldest pending jobs."""
    _, queue = jobs.claim(synced(spark, sf_dir).drop("outcome"), 500, NOW)
    return queue.select("id", "status", "attempts")


_OUTCOME = "CASE attempts WHEN 0 THEN 'done' WHEN 1 THEN 'review' WHEN 2 THEN 'failed' ELSE 'deferred' END"


@query(f"""
WITH {_STATE}
SELECT id, CASE WHEN status <> 'processing' THEN status WHEN {_OUTCOME} = 'deferred' THEN 'pending' ELSE {_OUTCOME} END AS status,
       CASE WHEN status = 'processing' THEN 'by attempts' ELSE last_error END AS last_error,
       CASE WHEN status = 'processing' AND {_OUTCOME} = 'deferred' THEN {_NOW} ELSE queued_at END AS queued_at FROM jobs""")
def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes written back; deferred jobs go to the back of the queue."""
    queue = order_jobs(spark, sf_dir)
    outcome = (
        F.when(F.col("attempts") == 0, "done").when(F.col("attempts") == 1, "review").when(F.col("attempts") == 2, "failed")
    ).otherwise("deferred")
    done = queue.filter(F.col("status") == "processing").select("id", outcome.alias("outcome"), F.lit("by attempts").alias("error"))
    rows = jobs.apply_outcomes(queue, done, NOW, back_of_queue=True)
    return rows.select("id", "status", "last_error", F.col("queued_at").cast("timestamp_ntz").alias("queued_at"))


@query(f"""
WITH {_STATE}
SELECT id, CASE WHEN status = 'review' AND active THEN 'pending' WHEN status = 'processing' THEN 'pending' ELSE status END AS status,
       CASE WHEN status = 'review' AND active THEN NULL WHEN status = 'processing' THEN 'interrupted activation' ELSE last_error END AS last_error
FROM jobs""")
def queue_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted work recovered, and everything in review queued again."""
    recovered = jobs.recover_interrupted(order_jobs(spark, sf_dir), NOW)
    return jobs.requeue(recovered, "review", NOW).select("id", "status", "last_error")


@query("""
SELECT event_id FROM events
WHERE event_type = 'view' OR (event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 3)""")
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending work, and errors with attempts left."""
    rows = tables.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
    attempts = F.get_json_object("props", "$.k").cast("int")
    return rows.filter(jobs.may_run(status, attempts)).select("event_id")


@query(f"""
WITH {_STATE}
SELECT count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processing')::BIGINT AS processing,
       count_if(status IN ('pending', 'processing')) > 0 AS busy FROM jobs WHERE active""")
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_counts(order_jobs(spark, sf_dir))


_LOG = """
log AS (
  SELECT event_type AS run, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS batch, count(*) AS pending_before,
         count(*) - count_if(value > 30) + count_if(user_id < 20) AS pending_after,
         count_if(value > 30)::BIGINT AS done, count_if(user_id < 20)::BIGINT AS deferred
  FROM events GROUP BY 1, 2)"""


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day, read as a log of batches."""
    done, late = F.count_if(F.col("value") > 30), F.count_if(F.col("user_id") < 20)
    rows = tables.table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.date_format("ts", "yyyyMMdd").cast("int").alias("batch")
    )
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("pending_before"), (total - done + late).alias("pending_after"), done.alias("done"), late.alias("deferred")
    )


@query(f"""
WITH {_LOG},
i AS (SELECT *, sum(CASE WHEN pending_before > pending_after THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY batch) AS island FROM log)
SELECT run, batch, pending_before - pending_after AS progress,
       (sum(CASE WHEN pending_before <= pending_after THEN 1 ELSE 0 END) OVER w)::BIGINT AS streak,
       (sum(CASE WHEN pending_before <= pending_after THEN 1 ELSE 0 END) OVER w) >= 3 OR pending_after <= 0 AS stop
FROM i WINDOW w AS (PARTITION BY run, island ORDER BY batch)""")
def stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.stagnation(batch_log(spark, sf_dir), "run", "batch", "pending_before", "pending_after")
    return rows.select("run", "batch", "progress", "streak", "stop")


@query(f"WITH {_LOG} SELECT count(*) AS batches, sum(done)::BIGINT AS done, sum(deferred)::BIGINT AS deferred FROM log")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_stats(batch_log(spark, sf_dir), ["done", "deferred"])


@query("""
SELECT event_type, count(*) AS processed, count_if(value > 30)::BIGINT AS done, count_if(value <= 30)::BIGINT AS review
FROM events GROUP BY 1""")
def outcome_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("value") > 30, "done").otherwise("review"))
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in ("done", "review")]
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("processed"), *counts)


@query("""
SELECT event_id, CAST(CASE event_type
    WHEN 'error' THEN greatest(1.0, value)
    WHEN 'signup' THEN greatest(1.0, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)))
    ELSE least(60.0, 5.0 * pow(2, CAST(json_extract_string(props, '$.k') AS INTEGER))) END AS DOUBLE) AS seconds
FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times: a stated delay, a stated date, or backoff by attempt."""
    stated = (
        F.when(F.col("event_type") == "error", F.col("value").cast("string"))
        .when(F.col("event_type") == "signup", "Thu, 01 Feb 2024 00:00:00 GMT")
    )
    attempt = F.get_json_object("props", "$.k").cast("int")
    now = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return tables.table(spark, sf_dir, "events").select("event_id", retry_seconds(stated, attempt, now).alias("seconds"))


# --- streaming ---------------------------------------------------------------------

_KINDS = {"view": "queued", "click": "claimed", "purchase": "done", "signup": "review", "error": "deferred"}


@query()
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per user after streaming all events through the job life cycle."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    schema = tables.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events*.parquet").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(kinds, F.col("event_type")).alias("kind"),
    )
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    queue_state.run_available(queue_state.job_states(events), f"{folder}/states", f"{folder}/checkpoint")
    return queue_state.latest_states(spark, f"{folder}/states")


@query(r"""
WITH posts AS (
  SELECT starts_with(url, 'https://') AS known,
         regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://'), '[?#].*$', ''), '/*$', '') || '/' AS url
  FROM pages),
stored AS (SELECT regexp_replace(url, '/*$', '') || '/' AS url FROM pages WHERE starts_with(url, 'https://'))
SELECT DISTINCT url FROM posts WHERE url NOT IN (SELECT url FROM stored)""")
def stream_new_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages streamed as a feed against a catalog of the secure urls as written."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    pages = tables.pages(spark, sf_dir)
    schema = pages.schema
    # Four files, one batch each; every page comes twice, so later batches meet earlier ones.
    pages.unionByName(pages).repartition(4).write.parquet(f"{folder}/feed")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")

    def catalog(session: SparkSession) -> DataFrame:
        pages = session.read.schema(schema).parquet(f"{sf_dir}/pages.parquet")
        return pages.filter(F.col("url").startswith("https://")).select(F.col("url").alias("source_url"))

    arrivals.watch_feed(feed, catalog, f"{folder}/arrivals", f"{folder}/checkpoint", link="url")
    return spark.read.parquet(f"{folder}/arrivals").select("url")


# What the provider of the drain answers for a part: an entity of its title, one without a
# date, nothing, an error that stays, or one that passes.
_ANSWER = """CASE WHEN p_size % 25 = 7 THEN 'deferred' WHEN p_size % 25 = 11 THEN 'failed' WHEN p_size % 5 = 1 THEN 'none'
  WHEN p_size % 5 = 2 THEN 'undated' ELSE 'done' END"""


@query(f"""
WITH asked AS (SELECT *, {_ANSWER} AS answer, p_name || ' no ' || p_partkey AS title FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS id,
       CASE answer WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' WHEN 'deferred' THEN 'pending' ELSE 'review' END AS status,
       CASE WHEN answer = 'deferred' AND (SELECT count(*) FROM asked WHERE answer = 'deferred') > 0 THEN 2 ELSE 1 END AS attempts,
       CASE answer WHEN 'failed' THEN 'KeyError: gone' WHEN 'deferred' THEN 'TimeoutError: slow'
         WHEN 'none' THEN 'no metadata evidence found'
         WHEN 'undated' THEN 'ambiguous metadata match: best=0.920, second=0.000, game_like=1, complete=0' END AS last_error,
       CASE WHEN answer = 'done' THEN title END AS canonical_title,
       (SELECT CASE WHEN count_if(answer = 'deferred') > 0 THEN 2 ELSE 1 END FROM asked) AS batches
FROM asked""")
def drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts queued and drained: one batch with work, then one that only meets what fails for a while and is the last allowed.

    A job has its status, what was tried, the error or reason, and the title of its result.
    """
    root = f"{checkpoint_dir(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    parts = tables.table(spark, sf_dir, "part").withColumn("answer", F.expr(_ANSWER)).withColumn(
        "title", F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string")))
    catalog = parts.select(
        F.col("p_partkey").cast("string").alias("id"), "title", F.lit("https://parts.example.com/").alias("source_url"),
        F.lit("2001-01-01").alias("post_date"), F.array("p_brand").alias("genres"), F.struct(F.lit("").alias("description")).alias("details"),
    )
    none = F.array().cast("array<string>")
    entity = F.struct(
        F.lit("entities").alias("source"), F.concat(F.lit("https://e.example.com/Q"), "p_partkey").alias("url"),
        F.concat(F.lit("Q"), "p_partkey").alias("id"), F.col("title").alias("label"), F.lit("video game").alias("description"),
        none.alias("instance_of"), F.when(F.col("answer") == "done", F.array(F.lit("2000-01-01"))).otherwise(none).alias("release_dates"),
        F.array("p_type").alias("genres"), none.alias("developers"), none.alias("publishers"), none.alias("platforms"),
    ).cast(f"struct<{CANDIDATE_FIELDS}>")
    found = F.col("answer").isin("done", "undated")
    said = parts.filter("answer <> 'none'").select(
        F.lower("title").alias("key"), F.when(found, entity).alias("candidate"),
        F.when(F.col("answer") == "failed", "KeyError: gone").when(~found, "TimeoutError: slow").alias("error"),
        (F.col("answer") == "deferred").alias("transient"),
    )
    resolve_queue.sync(spark, catalog, root, NOW)
    log = resolve_queue.drain(
        spark, root, lambda q: q.join(said, F.lower("query") == F.col("key")).select("query", "candidate", "error", "transient"),
        parts.count(), lambda: NOW, max_stagnant=1)
    states = read_current(spark, f"{root}/jobs", JOBS).select("id", "status", "attempts", "last_error")
    results = read_current(spark, f"{root}/results", RESULTS).select("id", "canonical_title")
    return states.join(results, "id", "left").withColumn("batches", F.lit(len(log)))
