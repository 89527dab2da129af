"""Translation jobs: gated sync, one bounded round, snapshot."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import localize
from ..operators.jobs import outcome_stats, recover_interrupted
from ..operators.publish import input_gate, inputs_unchanged
from ..schemas import FIELD_JOBS
from ..sources.snapshots import publish, read_current

GATE = "input string, version int, rows bigint, content string"
TRANSLATIONS = "id string, field string, idx int, source_sha256 string, text string"


def sync(spark: SparkSession, catalog: DataFrame, verified: DataFrame, root: str, now: datetime) -> dict:
    """Recover interrupted fields, then sync the field queue unless the inputs are unchanged."""
    jobs = recover_interrupted(read_current(spark, f"{root}/fields", FIELD_JOBS), now)
    gate = input_gate({"catalog": catalog, "verified": verified}, localize.FIELD_VERSION)
    if inputs_unchanged(gate, read_current(spark, f"{root}/gate", GATE)):
        publish(jobs, f"{root}/fields", now)
        return {"skipped": True}
    synced = localize.sync_fields(localize.wanted_jobs(catalog, verified), jobs, now)
    stats = outcome_stats(synced, ["queued", "changed", "unchanged", "dropped"]).first().asDict()
    publish(synced.drop("outcome").select(*jobs.columns), f"{root}/fields", now)
    publish(gate, f"{root}/gate", now)
    return {"skipped": False, **stats}


def translate(
    spark: SparkSession, root: str, answer: Callable[[DataFrame], DataFrame], n: int, now: datetime
) -> dict:
    """Translate the next ``n`` fields. ``answer`` adds ``translated``, and maybe ``error``, to sentence rows."""
    jobs = read_current(spark, f"{root}/fields", FIELD_JOBS)
    prepared = localize.prepared_sentences(localize.field_work(jobs, n))
    publish(answer(prepared), f"{root}/answers", now)
    answers = read_current(
        spark, f"{root}/answers",
        "id string, field_key string, pos int, source string, masked string,"
        " marks array<struct<mark:string,term:string>>, translated string, error string",
    )
    wanted = ["id", "field_key", "pos", "translated", "error"]
    responses = answers.select(*[c for c in wanted if c in answers.columns])
    outcomes = localize.checked_translations(answers.drop("translated", "error"), responses)
    stats = outcome_stats(outcomes, ["done", "rejected", "error"]).first().asDict()
    publish(localize.apply_translations(jobs, outcomes, now), f"{root}/fields", now)
    return stats


def export(spark: SparkSession, root: str, target: str, now: datetime) -> bool:
    """Publish the translations that are done, when they changed."""
    rows = localize.translation_rows(read_current(spark, f"{root}/fields", FIELD_JOBS))
    return publish(rows, target, now)


def localized(spark: SparkSession, catalog: DataFrame, target: str) -> DataFrame:
    return localize.overlay(catalog, read_current(spark, target, TRANSLATIONS))


def totals(rows: DataFrame) -> DataFrame:
    """Records and fields of a translation snapshot."""
    return rows.agg(F.count_distinct("id").alias("records"), F.count(F.lit(1)).alias("fields"))
