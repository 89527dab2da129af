"""Rule-based classification of catalog records.

Rules are data: a tier, a priority, a pattern and a reason. Tiers are ``exact`` (whole
folded titles), ``hard`` and ``standalone`` (reject whatever the score) and ``soft``
(reject only records without enough signals). Pattern tiers are compiled into one CASE
expression, so classification is a projection; exact titles of any number are joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip_text

# --- Fixed values -----------------------------------------------------------
ACCEPT_SCORE = 3
UNKNOWN_SIZES = ["", "N/A", "NA", "UNKNOWN", "-", "NONE"]
SIGNAL_POINTS = {"genres": 3, "size": 3, "image": 1, "description": 2, "media": 1}
EXACT_REASON = "audited-editorial"
# -----------------------------------------------------------------------------

# Patterns of a tier that go into one generated expression.
PATTERNS_PER_CASE = 200


class Rule(NamedTuple):
    tier: str
    priority: int
    pattern: str
    reason: str


RULE_SCHEMA = "tier string, priority int, pattern string, reason string"


def signals() -> Column:
    """Names of the metadata signals a record shows, strongest kinds first."""
    known = ~F.upper(strip_text("size_text")).isin(UNKNOWN_SIZES)
    found = {
        "genres": F.exists(F.col("genres"), lambda g: strip_text(g) != ""),
        "size": known,
        "image": strip_text("image_url") != "",
        "description": strip_text(F.col("details.description")) != "",
        "media": F.size("media") > 0,
    }
    names = F.array(*[F.when(F.coalesce(flag, F.lit(False)), name) for name, flag in found.items()])
    return F.filter(names, lambda s: s.isNotNull())


def signal_score(names: Column) -> Column:
    total = F.lit(0)
    for name, points in SIGNAL_POINTS.items():
        total = total + F.when(F.array_contains(names, name), points).otherwise(0)
    return total


def pattern_reason(title: Column, rules: Iterable[Rule], tier: str) -> Column:
    """Reason of the first matching pattern of a tier, by priority; null when none matches."""
    chosen = sorted((r for r in rules if r.tier == tier), key=lambda r: r.priority)
    parts = [F.lit(None).cast("string")]
    for start in range(0, len(chosen), PATTERNS_PER_CASE):
        tests = [(title.rlike("(?i)" + r.pattern), r.reason) for r in chosen[start : start + PATTERNS_PER_CASE]]
        case = F.when(*tests[0])
        for test, reason in tests[1:]:
            case = case.when(test, reason)
        parts.append(case)
    return F.coalesce(*parts)


def collect_rules(table: DataFrame) -> list[Rule]:
    """Pattern rules of a rule table. Exact titles stay in the table."""
    patterns = table.filter(F.col("tier") != "exact").select("tier", "priority", "pattern", "reason")
    return [Rule(*row) for row in patterns.collect()]


def title_key(title: Column | str) -> Column:
    return F.lower(collapse(title))


def exact_titles(table: DataFrame) -> DataFrame:
    """Distinct folded exact titles with their reason."""
    return (
        table.filter(F.col("tier") == "exact")
        .groupBy(title_key("pattern").alias("_title_key"))
        .agg(F.min_by("reason", "priority").alias("_exact_reason"))
    )


def classify(records: DataFrame, rules: Iterable[Rule], exact: DataFrame | None = None) -> DataFrame:
    """Add ``kind``, ``reason``, ``score`` and ``signals``.

    ``exact`` is a table from ``exact_titles``; Spark broadcasts it while it is small
    and otherwise joins by hash, with hot titles split by the adaptive skew join.
    """
    rules = list(rules)
    title = collapse("title")
    keyed = records.withColumn("signals", signals()).withColumn("score", signal_score(F.col("signals")))
    if exact is not None:
        keyed = keyed.withColumn("_title_key", title_key("title")).join(exact, "_title_key", "left").drop("_title_key")
    else:
        keyed = keyed.withColumn("_exact_reason", F.lit(None).cast("string"))
    keyed = keyed.withColumn(
        "_hard",
        F.coalesce("_exact_reason", pattern_reason(title, rules, "hard"), pattern_reason(title, rules, "standalone")),
    ).withColumn("_soft", pattern_reason(title, rules, "soft"))
    missing, hard, soft, score = title == "", F.col("_hard"), F.col("_soft"), F.col("score")
    weak = score < ACCEPT_SCORE
    return (
        keyed.withColumn(
            "kind",
            F.when(missing, "review")
            .when(hard.isNotNull() | (soft.isNotNull() & weak), "non_game")
            .when(~weak, "game")
            .otherwise("review"),
        )
        .withColumn(
            "reason",
            F.when(missing, "missing-title")
            .when(hard.isNotNull(), hard)
            .when(soft.isNotNull() & weak, soft)
            .when(~weak, "game-signals")
            .otherwise("insufficient-game-signals"),
        )
        .drop("_hard", "_soft", "_exact_reason")
    )


def quarantine_entries(classified: DataFrame, action: Column) -> DataFrame:
    return classified.select(
        strip_text("id").alias("id"),
        strip_text("title").alias("title"),
        strip_text("source_url").alias("source_url"),
        F.col("kind").alias("classification"),
        "reason",
        "score",
        "signals",
        action.alias("action"),
    )


def classification_guard(classified: DataFrame) -> DataFrame:
    """Rejects that should not be in the catalog, and reviews retained; one row."""
    return classified.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("kind") == "non_game").alias("rejects"),
        F.count_if(F.col("kind") == "review").alias("reviews"),
        (F.count_if(F.col("kind") == "non_game") == 0).alias("ok"),
    )


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


