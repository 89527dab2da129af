"""Scores: fuzzy query relevance and title similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import fold_query

# --- Fixed values -----------------------------------------------------------
EMPTY_QUERY, EQUAL, PREFIX, CONTAINS, TEXT = 1.0, 500.0, 420.0, 360.0, 300.0
LENGTH_PENALTY = 0.01
WORD_EQUAL, WORD_PREFIX, WORD_CONTAINS, WORD_FUZZY, EDIT_PENALTY = 90, 75, 58, 48, 8
FUZZY_MIN_LENGTH, FUZZY_LENGTH_GAP, SHORT_WORD = 4, 2, 5
MATCH_EXACT, MATCH_SEQUENCE, MATCH_WORDS, MATCH_CONTAINS = 0.76, 0.50, 0.20, 0.08
MATCH_DOMAIN, MATCH_DATE, MATCH_GENRE, MATCH_COMPANY, MATCH_CAP = 0.12, 0.05, 0.04, 0.03, 0.99
#: Pairs of texts whose ratio a worker remembers; candidates that share a label come in rows.
RATIOS = 1 << 14
# -----------------------------------------------------------------------------


def single_word_score(query_word: str, word: Column) -> Column:
    """Score of one query word against one word; 0 when it does not fit."""
    allowed = 1 if len(query_word) <= SHORT_WORD else 2
    value = (
        F.when(word == query_word, WORD_EQUAL)
        .when(word.startswith(query_word), WORD_PREFIX)
        .when(word.contains(query_word), WORD_CONTAINS)
    )
    if len(query_word) >= FUZZY_MIN_LENGTH:
        near = F.length(word).between(len(query_word) - FUZZY_LENGTH_GAP, len(query_word) + FUZZY_LENGTH_GAP)
        distance = F.levenshtein(F.lit(query_word), word, allowed)
        value = value.when(near & (distance >= 0), WORD_FUZZY - EDIT_PENALTY * distance)
    return value.otherwise(0)


def word_score(query_word: str, words: Column) -> Column:
    """Best score of one query word against the words of a row; 0 when none fits."""
    return F.coalesce(F.array_max(F.transform(words, lambda w: single_word_score(query_word, w))), F.lit(0))


def row_score(query: str, title_fold: Column, text_fold: Column, by_words: Column | None) -> Column:
    """Relevance of a row whose words score ``by_words`` in all; that is null where a query word fits none of them."""
    folded = fold_query(query)
    if not folded:
        return F.lit(EMPTY_QUERY)
    penalty = len(folded) * LENGTH_PENALTY
    return (
        F.when(title_fold == folded, EQUAL)
        .when(title_fold.startswith(folded), PREFIX - penalty)
        .when(title_fold.contains(folded), CONTAINS - penalty)
        .when(text_fold.contains(folded), TEXT)
        .otherwise(F.coalesce(by_words.cast("double"), F.lit(0.0)))
    )


def query_score(query: str, title_fold: Column, text_fold: Column, words: Column) -> Column:
    """Relevance of a row for a query; 0 means no match. All columns are folded."""
    matched, total = F.lit(True), F.lit(0)
    for value in [word_score(word, words) for word in fold_query(query).split(" ")]:
        matched = matched & (value > 0)
        total = total + value
    return row_score(query, title_fold, text_fold, F.when(matched, total))


@lru_cache(maxsize=RATIOS)
def _ratio(left: str | None, right: str | None) -> float:
    if not left or not right:
        return 0.0
    return difflib.SequenceMatcher(None, left, right).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; null counts as no similarity."""
    for left, right in batches:
        yield pd.Series([_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def jaccard(left: Column, right: Column) -> Column:
    """Share of distinct words in common."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def match_bonus(domain: Column, has_date: Column, has_genre: Column, has_company: Column) -> Column:
    def points(flag: Column, value: float) -> Column:
        return F.when(flag, value).otherwise(0.0)

    return (
        points(domain, MATCH_DOMAIN)
        + points(has_date, MATCH_DATE)
        + points(has_genre, MATCH_GENRE)
        + points(has_company, MATCH_COMPANY)
    )


def match_score(source: Column, label: Column, ratio: Column, words: Column, bonus: Column) -> Column:
    """Similarity of a folded title and a folded label, capped below certainty."""
    contains = source.contains(label) | label.contains(source)
    inexact = ratio * MATCH_SEQUENCE + words * MATCH_WORDS + F.when(contains, MATCH_CONTAINS).otherwise(0.0)
    base = F.when(source == label, MATCH_EXACT).otherwise(inexact)
    return F.when((source == "") | (label == ""), 0.0).otherwise(F.least(base + bonus, F.lit(MATCH_CAP)))
