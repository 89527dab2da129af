"""Inverted index and fuzzy search.

Index text and scoring text differ on purpose: the index covers titles, companies,
release year and tags; scoring also sees size and platforms. The index only narrows the
rows to score, and an empty narrowing falls back to all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import (
    GRAM_SIZE,
    PREFIX_MAX,
    PREFIX_MIN,
    distinct_words,
    fold_query,
    grams_of,
    let,
    prefixes_of,
    search_fold,
)
from ..functions.scoring import query_score
from ..functions.text import array_or_empty, clean_tags, display_genre, effective_tags, keys_of, strip_text, text_or_empty, values_of, year_of
from ..session import cut_lineage

# --- Fixed values -----------------------------------------------------------
GRAM_SHARE = 0.4
GRAM_MIN_WORD = 4
SUGGESTIONS = 8
# -----------------------------------------------------------------------------


def _joined(parts: list[Column], lists: list[Column]) -> Column:
    texts = [text_or_empty(p) for p in parts] + [F.array_join(a, " ") for a in lists]
    return F.concat_ws(" ", *texts)


def prepare(light: DataFrame) -> DataFrame:
    """Add folded titles, scoring words, index words and tag keys to a light catalog."""
    tags = effective_tags("metadata_genres", "genres")
    raw_tags = F.concat(clean_tags("genres"), clean_tags("metadata_genres"))
    release_year = F.coalesce(year_of("game_release_date").cast("string"), F.lit(""))
    base = light.withColumn("_tags", tags).withColumn("release_year", release_year)
    labels = values_of(F.col("_tags"))
    scoring_text = _joined(
        [
            F.col("title"), strip_text("canonical_title"), F.col("size_text"), F.col("release_year"),
            F.col("metadata_developer"), F.col("metadata_publisher"),
        ],
        [array_or_empty("metadata_platforms"), labels],
    )
    index_text = _joined(
        [
            F.col("title"), F.col("canonical_title"), F.col("metadata_developer"),
            F.col("metadata_publisher"), F.col("release_year"),
        ],
        [raw_tags, F.transform(raw_tags, display_genre)],
    )
    canonical = strip_text("canonical_title")
    return (
        base.withColumn("tag_labels", labels)
        .withColumn("tag_keys", keys_of(F.col("_tags")))
        .withColumn("title_fold", search_fold(F.when(canonical != "", canonical).otherwise(F.col("title"))))
        .withColumn("text_fold", search_fold(scoring_text))
        .withColumn("words", distinct_words(F.col("text_fold")))
        .withColumn("index_words", distinct_words(search_fold(index_text)))
        .drop("_tags")
    )


def index_keys(words: Column) -> Column:
    """Distinct ``struct<kind, key>`` of a row: prefixes (``p``) and grams (``g``)."""

    def tagged(kind: str, keys: Column) -> Column:
        return F.transform(
            F.array_distinct(F.flatten(keys)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
        )

    return F.concat(tagged("p", F.transform(words, lambda w: prefixes_of(w))), tagged("g", F.transform(words, lambda w: grams_of(w))))


def postings(df: DataFrame, key: str, words: Column | str) -> DataFrame:
    """Postings ``(kind, key, <row key>)``.

    A row's keys are made distinct inside the row, so building the index needs no shuffle
    as long as ``key`` is unique. Store it bucketed or partitioned by ``key``.
    """
    words = F.col(words) if isinstance(words, str) else words
    return df.select(F.col(key), F.explode(index_keys(words)).alias("_k")).select(
        F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"), F.col(key).alias(key if key != "key" else "row")
    )


def stored_index(rows: DataFrame, key: str, words: str, path: str) -> DataFrame:
    """Postings ``(kind, key, <row key>)`` of rows, stored in two levels and read back.

    Keys belong to words, not to rows: the index stores the rows of every word, and the keys
    of every distinct word once. What a query asks of ``kind`` and ``key`` is asked of the
    second table; its words then give the rows. Every task writes the words of its rows in
    order, as a segment, so the postings are not shuffled. A row whose words share a key has
    it once for each of them.
    """
    spark = rows.sparkSession
    held = rows.select(F.explode(words).alias("_word"), F.col(key).alias("_row"))
    held.sortWithinPartitions("_word").write.parquet(f"{path}/words")
    held = spark.read.schema(held.schema).parquet(f"{path}/words")
    found = held.select("_word").distinct().select("_word", F.explode(index_keys(F.array("_word"))).alias("_k"))
    keys = found.select("_k.kind", "_k.key", "_word")
    keys.repartitionByRange("kind", "key", "_word").sortWithinPartitions("kind", "key").write.parquet(f"{path}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{path}/keys")
    return keys.join(held, "_word").select("kind", "key", F.col("_row").alias(key if key != "key" else "row"))


def posting_blocks(index: DataFrame, ordinal: str = "ordinal", block: int = 65536) -> DataFrame:
    """Ascending posting lists for export, split into blocks of ordinals.

    A block holds at most ``block`` entries, so a key that occurs in a third of the
    catalog becomes many bounded lists instead of one unbounded list.
    """
    number = F.floor(F.col(ordinal) / block).cast("long")
    return index.groupBy("kind", "key", number.alias("block")).agg(
        F.sort_array(F.collect_set(ordinal)).alias("ordinals")
    )


def _word_grams(word: str) -> list[str]:
    return list(dict.fromkeys(word[i : i + GRAM_SIZE] for i in range(len(word) - GRAM_SIZE + 1)))


def _needed_grams(grams: list[str]) -> int:
    return max(1, math.ceil(len(grams) * GRAM_SHARE))


def query_words(query: str) -> list[str]:
    return [w for w in fold_query(query).split(" ") if len(w) >= PREFIX_MIN]


def candidates(index: DataFrame, key: str, query: str) -> DataFrame | None:
    """Row keys that the index offers for a query; null when the query has no usable word.

    Only the postings of the query's own keys are read. One aggregate per row collects, for
    every query word, its prefix hit and its gram hits, as bits: a posting may repeat.
    """
    words = query_words(query)
    if not words:
        return None
    wanted, conditions = F.lit(False), []
    for number, word in enumerate(words):
        prefix = (F.col("kind") == "p") & (F.col("key") == word[:PREFIX_MAX])
        wanted = wanted | prefix
        hit = F.max(prefix)
        if len(word) >= GRAM_MIN_WORD:
            grams = _word_grams(word)
            gram = (F.col("kind") == "g") & F.col("key").isin(grams)
            wanted = wanted | gram
            found = F.lit(0)
            for at in range(0, len(grams), 63):
                bit = F.lit(0).cast("long")
                for i, g in enumerate(grams[at : at + 63]):
                    bit = F.when(gram & (F.col("key") == g), F.lit(1 << i).cast("long")).otherwise(bit)
                found = found + F.bit_count(F.bit_or(bit))
            hit = hit | (found >= _needed_grams(grams))
        conditions.append(hit.alias(f"_w{number}"))
    grouped = index.filter(wanted).groupBy(key).agg(*conditions)
    every = F.lit(True)
    for number in range(len(words)):
        every = every & F.col(f"_w{number}")
    return grouped.filter(every).select(key)


def search_pool(rows: DataFrame, key: str, query: str, index: DataFrame | None = None) -> DataFrame:
    """Rows to score: the index candidates, or all rows when there are none.

    Whether there are any is looked up first, in the postings of the query's own keys, so
    the rows are either joined with a few candidates or scanned, never both.
    """
    offered = candidates(index, key, query) if index is not None else None
    if offered is None:
        return rows
    offered = cut_lineage(offered)  # read twice below
    if offered.isEmpty():
        return rows
    return rows.join(offered, key, "left_semi")


def search(rows: DataFrame, key: str, query: str, index: DataFrame | None = None) -> DataFrame:
    """Prepared rows that match a query, with their ``score``."""
    # Bound once: the score names each folded text several times.
    folded = F.struct("title_fold", "text_fold", "words")
    score = let(folded, lambda r: query_score(query, r["title_fold"], r["text_fold"], r["words"]))
    return search_pool(rows, key, query, index).withColumn("score", score).filter(F.col("score") > 0)


def suggestions(
    rows: DataFrame, key: str, query: str, date: Column, index: DataFrame | None = None, k: int = SUGGESTIONS
) -> DataFrame:
    """Best matches by score, then date; nothing for queries under two characters."""
    found = search(rows, key, query, index)
    if len(query.strip()) < 2:
        found = found.filter(F.lit(False))
    return found.orderBy(F.desc("score"), date.desc(), F.col(key)).limit(k)


def missing_postings(rows: DataFrame, key: str, title: str, index: DataFrame) -> DataFrame:
    """Published-output check: the first title word's prefix and gram must be in the index."""
    word = F.get(F.split(search_fold(title), " "), F.lit(0))
    expected = rows.select(
        F.col(key),
        F.explode(
            F.array(
                F.when(
                    F.length(word) >= PREFIX_MIN,
                    F.struct(F.lit("p").alias("kind"), F.left(word, F.lit(PREFIX_MAX)).alias("key")),
                ),
                F.when(
                    F.length(word) >= GRAM_SIZE,
                    F.struct(F.lit("g").alias("kind"), F.left(word, F.lit(GRAM_SIZE)).alias("key")),
                ),
            )
        ).alias("_k"),
    ).filter(F.col("_k").isNotNull())
    flat = expected.select(F.col(key), F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
    return flat.join(index, ["kind", "key", key], "left_anti")
