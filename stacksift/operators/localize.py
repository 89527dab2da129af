"""Field-level translation: what to translate, checks on the output, the overlay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import collapsed_hash, field_fingerprint, text_hash
from ..functions.text import (
    LEFTOVER_MARK,
    array_or_empty,
    collapse,
    english_share,
    looks_english,
    sentences,
    strip_text,
)
from ..functions.titles import protected_terms
from .jobs import may_run
from .ordinals import head

# --- Fixed values -----------------------------------------------------------
FIELD_VERSION = 1
DESCRIPTION = "description"
FEATURE_PREFIX = "game_feature:"
MIN_DESCRIPTION, MIN_FEATURE = 40, 12
RATIO_LOW, RATIO_HIGH = 0.30, 2.20
RESIDUE_MIN_CHARS, RESIDUE_MAX_SHARE = 80, 0.20
ERROR_CHARS = 500
# -----------------------------------------------------------------------------


def source_fields(catalog: DataFrame) -> DataFrame:
    """Translatable fields of every record: ``id, field_key, source_text``.

    Descriptions of 40 characters and features of 12, when they look English.
    """
    description = collapse(F.col("details.description"))
    wanted = F.struct(F.lit(DESCRIPTION).alias("key"), description.alias("text"), F.lit(MIN_DESCRIPTION).alias("least"))
    features = F.transform(
        array_or_empty(F.col("details.features")),
        lambda text, i: F.struct(
            F.concat(F.lit(FEATURE_PREFIX), F.format_string("%04d", i)).alias("key"),
            collapse(text).alias("text"),
            F.lit(MIN_FEATURE).alias("least"),
        ),
    )
    fields = catalog.select(collapse("id").alias("id"), F.explode(F.concat(F.array(wanted), features)).alias("f"))
    text = F.col("f.text")
    return fields.filter(
        (F.col("id") != "") & (F.length(text) >= F.col("f.least")) & looks_english(text)
    ).select("id", F.col("f.key").alias("field_key"), text.alias("source_text"))


def catalog_terms(catalog: DataFrame, verified: DataFrame) -> DataFrame:
    """Protected terms of every record: names out of verified or raw title and companies."""
    meta = verified.select("id", "canonical_title", "developer", "publisher")
    joined = catalog.select("id", "title").join(meta, "id", "left")
    one = lambda c: F.array(F.coalesce(F.col(c), F.lit("")))
    terms = protected_terms("title", "canonical_title", one("developer"), one("publisher"))
    return joined.select("id", terms.alias("terms"))


def wanted_jobs(catalog: DataFrame, verified: DataFrame, version: int = FIELD_VERSION) -> DataFrame:
    """Fields with terms, source hash and fingerprint."""
    fields = source_fields(catalog).join(catalog_terms(catalog, verified), "id")
    return fields.select(
        "id",
        "field_key",
        field_fingerprint(F.col("source_text"), F.col("terms"), version).alias("fingerprint"),
        text_hash("source_text").alias("source_sha256"),
        "source_text",
        "terms",
        F.lit(version).alias("worker_version"),
    )


def sync_fields(wanted: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Next state of the field queue, with ``outcome``: queued, changed, unchanged or dropped.

    A field changes with its fingerprint or the worker version. Dropped fields turn
    inactive and keep everything else. Of a repeated field the row with the smallest
    values counts.
    """
    fields = ["fingerprint", "source_sha256", "source_text", "terms", "worker_version"]
    new = wanted.groupBy("id", "field_key").agg(F.min(F.struct(*fields)).alias("_new"))
    both = new.join(jobs, ["id", "field_key"], "full_outer")
    differs = (F.col("fingerprint") != F.col("_new.fingerprint")) | (
        F.col("worker_version") != F.col("_new.worker_version")
    )
    both = both.withColumn(
        "outcome",
        F.when(F.col("_new").isNull(), "dropped")
        .when(F.col("status").isNull(), "queued")
        .when(differs, "changed")
        .otherwise("unchanged"),
    )
    dropped, restart = F.col("outcome") == "dropped", F.col("outcome").isin("queued", "changed")
    stamp = F.lit(now).cast("timestamp")
    taken = [F.when(dropped, F.col(f)).otherwise(F.col(f"_new.{f}")).alias(f) for f in fields]
    return both.select(
        "id",
        "field_key",
        *taken,
        F.when(restart, "pending").otherwise(F.col("status")).alias("status"),
        F.when(restart, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(restart, None).otherwise(F.col("translated_text")).alias("translated_text"),
        F.when(restart, None).otherwise(F.col("last_error")).alias("last_error"),
        (~dropped).alias("active"),
        F.coalesce("created_at", stamp).alias("created_at"),
        F.when(dropped, F.col("updated_at")).otherwise(stamp).alias("updated_at"),
        "outcome",
    )


def field_work(jobs: DataFrame, n: int, max_attempts: int = 3) -> DataFrame:
    """Next fields to translate: descriptions first, then the oldest."""
    ready = jobs.filter(F.col("active") & may_run(F.col("status"), F.col("attempts"), max_attempts))
    first = F.when(F.col("field_key") == DESCRIPTION, 0).otherwise(1)
    return head(ready, [first, F.col("updated_at"), F.col("id"), F.col("field_key")], n)


# --- term protection ---------------------------------------------------------------


def protect(sentence: Column, terms: Column) -> Column:
    """``struct<text, marks>``: found terms replaced by numbered marks, in term order."""
    start = F.struct(
        sentence.alias("text"), F.array().cast("array<struct<mark:string,term:string>>").alias("marks")
    )

    def replace(acc: Column, term: Column) -> Column:
        mark = F.format_string("ZXQ%02dQXZ", F.size(acc["marks"]) + 1)
        pair = F.struct(mark.alias("mark"), term.alias("term"))
        replaced = F.struct(
            F.replace(acc["text"], term, mark).alias("text"), F.array_append(acc["marks"], pair).alias("marks")
        )
        return F.when(acc["text"].contains(term), replaced).otherwise(acc)

    return F.aggregate(terms, start, replace)


def restore(text: Column, marks: Column) -> Column:
    """``struct<text, missing, leftovers>`` after putting the terms back."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("missing"))

    def put_back(acc: Column, pair: Column) -> Column:
        lost = F.struct(acc["text"].alias("text"), F.array_append(acc["missing"], pair["mark"]).alias("missing"))
        found = F.struct(
            F.replace(acc["text"], pair["mark"], pair["term"]).alias("text"), acc["missing"].alias("missing")
        )
        return F.when(acc["text"].contains(pair["mark"]), found).otherwise(lost)

    done = F.aggregate(marks, start, put_back)
    left = F.regexp_extract_all(done["text"], F.lit(f"({LEFTOVER_MARK})"), F.lit(1))
    return F.struct(done["text"].alias("text"), done["missing"].alias("missing"), left.alias("leftovers"))


def prepared_sentences(jobs: DataFrame) -> DataFrame:
    """Sentences to translate: ``id, field_key, pos, source, masked, marks``."""
    split = jobs.select("id", "field_key", "terms", F.posexplode(sentences("source_text")).alias("pos", "source"))
    ready = split.withColumn("_p", protect(F.col("source"), F.col("terms")))
    return ready.select("id", "field_key", "pos", "source", F.col("_p.text").alias("masked"), F.col("_p.marks").alias("marks"))


def sentence_problem(source: Column, restored: Column, missing: Column, leftovers: Column) -> Column:
    """First reason to reject a translated sentence; null when it holds."""
    ratio = F.length(restored) / F.greatest(F.length(source), F.lit(1))
    residue = (F.length(restored) >= RESIDUE_MIN_CHARS) & (english_share(restored) >= RESIDUE_MAX_SHARE)
    return (
        F.when((F.size(missing) > 0) | (F.size(leftovers) > 0), "placeholder validation failed")
        .when(restored == "", "empty translated sentence")
        .when((ratio < RATIO_LOW) | (ratio > RATIO_HIGH), F.format_string("implausible length ratio %.3f", ratio))
        .when(residue, "excessive English residue")
    )


def checked_translations(prepared: DataFrame, responses: DataFrame) -> DataFrame:
    """Fields put together from translated sentences: ``id, field_key, outcome, text, error``.

    ``responses`` has ``id, field_key, pos, translated`` and may have ``error``. A field
    with a failed sentence is an error, to be tried again; one with a missing sentence or
    any broken check is rejected, with the reason of its first broken sentence.
    """
    if "error" not in responses.columns:
        responses = responses.withColumn("error", F.lit(None).cast("string"))
    both = prepared.join(responses.withColumnRenamed("error", "failure"), ["id", "field_key", "pos"], "left")
    back = both.withColumn("_r", restore(strip_text("translated"), F.col("marks")))
    problem = F.when(F.col("translated").isNull(), "translation output count mismatch").otherwise(
        sentence_problem(F.col("source"), F.col("_r.text"), F.col("_r.missing"), F.col("_r.leftovers"))
    )
    checked = back.withColumn("problem", problem).withColumn("text", F.col("_r.text"))
    grouped = checked.groupBy("id", "field_key").agg(
        F.min_by(F.col("problem"), F.when(F.col("problem").isNotNull(), F.col("pos"))).alias("error"),
        F.min_by(F.col("failure"), F.when(F.col("failure").isNotNull(), F.col("pos"))).alias("failure"),
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return grouped.select(
        "id",
        "field_key",
        F.when(F.col("failure").isNotNull(), "error").when(F.col("error").isNull(), "done").otherwise("rejected").alias("outcome"),
        F.when(F.col("error").isNull(), joined).alias("text"),
        F.left(F.coalesce("failure", "error"), F.lit(ERROR_CHARS)).alias("error"),
    )


def apply_translations(jobs: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Outcomes written back into the field queue; every try counts."""
    new = outcomes.select("id", "field_key", F.struct("outcome", "text", "error").alias("_o"))
    both = jobs.join(new, ["id", "field_key"], "left")
    hit = F.col("_o").isNotNull()
    return both.withColumns(
        {
            "status": F.when(hit, F.col("_o.outcome")).otherwise(F.col("status")),
            "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "translated_text": F.when(hit, F.col("_o.text")).otherwise(F.col("translated_text")),
            "last_error": F.when(hit, F.col("_o.error")).otherwise(F.col("last_error")),
            "updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    ).drop("_o")


# --- snapshot and overlay ------------------------------------------------------------


def translation_rows(jobs: DataFrame, version: int = FIELD_VERSION) -> DataFrame:
    """Published translations, one row per field: ``id, field, idx, source_sha256, text``."""
    sha, text = F.lower(strip_text("source_sha256")), collapse("translated_text")
    done = jobs.filter(F.col("active") & (F.col("status") == "done") & (F.col("worker_version") == version))
    idx = F.regexp_extract("field_key", rf"^{FEATURE_PREFIX}(\d{{4,}})$", 1)
    kind = F.when(F.col("field_key") == DESCRIPTION, DESCRIPTION).when(idx != "", "feature")
    rows = done.select(
        strip_text("id").alias("id"), kind.alias("field"), F.nullif(idx, F.lit("")).cast("int").alias("idx"),
        sha.alias("source_sha256"), text.alias("text"),
    )
    return rows.filter(
        (F.col("id") != "") & F.col("source_sha256").rlike("^[0-9a-f]{64}$") & (F.col("text") != "") & F.col("field").isNotNull()
    )


def nested_translations(rows: DataFrame) -> DataFrame:
    """One row per record: its description and a map of features by position."""
    payload = F.struct("source_sha256", "text")
    feature = F.when(F.col("field") == "feature", F.struct(F.col("idx").cast("string").alias("key"), payload.alias("value")))
    return rows.groupBy("id").agg(
        F.max(F.when(F.col("field") == DESCRIPTION, payload)).alias("description"),
        F.map_from_entries(F.array_sort(F.collect_list(feature))).alias("features"),
        F.count(F.lit(1)).alias("fields"),
    )


def overlay(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Catalog with verified translations in place of their sources.

    A field is replaced only if its stored hash is that of the present source text with
    white space collapsed; otherwise the source stays. Adds ``translated_fields``.
    """
    nested = nested_translations(rows).select("id", F.col("description").alias("_d"), F.col("features").alias("_f"))
    both = catalog.join(nested, "id", "left")

    def verified(source: Column, entry: Column) -> Column:
        holds = (collapse(source) != "") & (collapsed_hash(source) == entry["source_sha256"])
        return F.when(holds, entry["text"])

    description = verified(F.col("details.description"), F.col("_d"))
    features = F.transform(
        F.col("details.features"), lambda text, i: verified(text, F.element_at(F.col("_f"), i.cast("string")))
    )
    both = both.withColumn("_dv", description).withColumn("_fv", features)
    count = F.col("_dv").isNotNull().cast("int") + F.coalesce(
        F.size(F.filter("_fv", lambda x: x.isNotNull())), F.lit(0)
    )
    localized = (
        F.col("details")
        .withField("description", F.coalesce("_dv", F.col("details.description")))
        .withField("features", F.zip_with("_fv", F.col("details.features"), lambda a, b: F.coalesce(a, b)))
    )
    both = both.withColumn("translated_fields", count)
    return both.withColumn(
        "details", F.when(F.col("translated_fields") > 0, localized).otherwise(F.col("details"))
    ).drop("_d", "_f", "_dv", "_fv")


def field_counts(jobs: DataFrame) -> DataFrame:
    return jobs.filter("active").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
