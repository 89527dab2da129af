"""Fuzzy word search by a table of distinct words.

How near a word is to a query word does not depend on the row it stands in. So every distinct
word is scored once per query word, and rows get the best scores of their words by postings.

Words within two edits are found by deletion keys: two words that one or two edits part have a
key in common when up to two letters of each are left out. The keys are stored with the words;
a query word reads the words of its own keys and settles the distance exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_query
from ..functions.scoring import FUZZY_LENGTH_GAP, FUZZY_MIN_LENGTH, SHORT_WORD, row_score, single_word_score

#: Words longer than this are compared without keys; there are few of them.
LONGEST = 24


def vocabulary(rows: DataFrame, words: str = "words") -> DataFrame:
    """Every word of the rows, once."""
    return rows.select(F.explode(words).alias("word")).distinct()


def _without(word: Column, size: int) -> Column:
    """All ways to leave out up to ``size`` letters of ``word``."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    found = F.concat(F.array(word), F.when(F.length(word) > 0, one).otherwise(F.array().cast("array<string>")))
    if size > 1:
        found = F.flatten(F.transform(found, lambda w: _without(w, size - 1)))
    return F.array_distinct(found)


def deletion_keys(words: DataFrame, size: int = 2) -> DataFrame:
    """``key, word`` for every word of at most ``LONGEST`` letters with up to ``size`` of them left out."""
    short = words.filter(F.length("word") <= LONGEST)
    return short.select(F.explode(_without(F.col("word"), size)).alias("key"), "word")


def deletions(word: str, size: int = 2) -> list[str]:
    """The keys of a query word."""
    out = {"".join(kept) for n in range(size + 1) if n <= len(word) for kept in combinations(word, len(word) - n)}
    return sorted(out)


def near_words(words: DataFrame, keys: DataFrame, query_word: str) -> DataFrame:
    """Words that may be within the allowed edits of ``query_word``: by keys, and the longest as they are."""
    allowed = 1 if len(query_word) <= SHORT_WORD else 2
    by_key = keys.filter(F.col("key").isin(deletions(query_word, allowed))).select("word").distinct()
    long = words.filter((F.length("word") > LONGEST) & F.length("word").between(len(query_word) - FUZZY_LENGTH_GAP, len(query_word) + FUZZY_LENGTH_GAP))
    return by_key.unionByName(long.select("word"))


def word_scores(words: DataFrame, keys: DataFrame, query: str) -> DataFrame:
    """``word, number, score`` of all words that fit one of the query's words."""
    out = None
    for number, query_word in enumerate(fold_query(query).split(" ")):
        fitting = words.filter(F.col("word").contains(query_word))
        if len(query_word) >= FUZZY_MIN_LENGTH:
            fitting = fitting.unionByName(near_words(words, keys, query_word)).distinct()
        scored = fitting.select("word", F.lit(number).alias("number"), single_word_score(query_word, F.col("word")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out.filter("score > 0")


def search_words(rows: DataFrame, key: str, query: str, words: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Prepared rows that match a query, with their ``score``, as ``search.search`` gives them without an index.

    ``words`` and ``keys`` are the stored vocabulary of the rows and its deletion keys.
    """
    folded = fold_query(query)
    if not folded:
        return rows.withColumn("score", row_score(query, F.col("title_fold"), F.col("text_fold"), None))
    words = vocabulary(rows) if words is None else words
    keys = deletion_keys(words) if keys is None else keys
    asked = folded.split(" ")
    scores = word_scores(words, keys, query)
    hits = rows.select(key, F.explode("words").alias("word")).join(scores, "word")
    best = hits.groupBy(key, "number").agg(F.max("score").alias("best"))
    total = best.groupBy(key).agg(F.sum("best").alias("_t"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(asked))
    joined = rows.join(total.select(key, "_t"), key, "left")
    score = row_score(query, F.col("title_fold"), F.col("text_fold"), F.col("_t"))
    return joined.withColumn("score", score).filter(F.col("score") > 0).drop("_t")
