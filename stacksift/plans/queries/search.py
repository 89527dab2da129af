"""Folds, the inverted index and fuzzy search."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.fold import distinct_words, match_fold, search_fold
from ...operators import browse, fuzzy, light, search
from ...session import checkpoint_dir, cut_lineage
from ...sources.index_store import SegmentedIndex
from .. import tables
from .registry import PREPARED, candidate_test, fold, query, query_score

TEXT_QUERY = "thand heren"
PART_QUERY = "blu gizmos econ"
TITLE_QUERY = "economy blue"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, verified = tables.catalog(spark, sf_dir), tables.verified(spark, sf_dir)
    return search.prepare(light.light_catalog(records, verified))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = tables.documents(spark, sf_dir).select("doc_id", search_fold("text").alias("text_fold"))
    return folded.withColumn("words", distinct_words("text_fold"))


@query(f"SELECT doc_id, md5({fold('text')}) AS folded, length({fold('text')}) AS chars FROM documents")
def fold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = tables.documents(spark, sf_dir).select("doc_id", search_fold("text").alias("f"))
    return folded.select("doc_id", F.md5("f").alias("folded"), F.length("f").cast("long").alias("chars"))


_MATCH = fold("replace(replace(replace(text, 'ß', 'ss'), '&', ' and '), '…', ' ')")


@query(f"SELECT doc_id, md5({_MATCH}) AS folded FROM documents")
def fold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", F.md5(match_fold("text")).alias("folded"))


@query(f"""
WITH words AS (SELECT DISTINCT doc_id, unnest(string_split({fold('text')}, ' ')) AS w FROM documents),
keys AS (
  SELECT DISTINCT doc_id, 'p' AS kind, left(w, n) AS key
  FROM words, (SELECT unnest(range(2, 7)) AS n) WHERE length(w) >= n
  UNION ALL
  SELECT DISTINCT doc_id, 'g', unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))
  FROM words WHERE length(w) >= 3)
SELECT kind, key, count(*) AS postings, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       CAST(sum(doc_id) AS BIGINT) AS doc_sum
FROM keys GROUP BY kind, key""")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists of the whole texts, described by count, ends and sum."""
    index = search.postings(document_words(spark, sf_dir), "doc_id", "words")
    return index.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("postings"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.sum("doc_id").alias("doc_sum"),
    )


@query(f"""
SELECT doc_id FROM documents
WHERE {candidate_test(TEXT_QUERY, f"string_split({fold('text')}, ' ')")}""")
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.postings(document_words(spark, sf_dir), "doc_id", "words")
    return search.candidates(index, "doc_id", TEXT_QUERY)


@query(f"""
WITH folded AS (SELECT doc_id, {fold('text')} AS t FROM documents),
scored AS (SELECT doc_id, CAST({query_score(TEXT_QUERY, 't', 't')} AS DOUBLE) AS score FROM folded)
SELECT * FROM scored WHERE score > 0""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that matches, by exact, prefix, contained or similar words; each word is scored once."""
    rows = cut_lineage(document_words(spark, sf_dir).withColumn("title_fold", F.col("text_fold")))
    return fuzzy.search_words(rows, "doc_id", TEXT_QUERY, cut_lineage(fuzzy.vocabulary(rows))).select("doc_id", "score")


@query(f"""
WITH folded AS (SELECT doc_id, {fold('text')} AS t FROM documents),
marked AS (SELECT *, {candidate_test(TEXT_QUERY, "list_distinct(string_split(t, ' '))")} AS offered FROM folded),
scored AS (SELECT doc_id, CAST({query_score(TEXT_QUERY, 't', 't')} AS DOUBLE) AS score FROM marked
  WHERE offered OR NOT (SELECT bool_or(offered) FROM marked))
SELECT * FROM scored WHERE score > 0""")
def search_indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the stored index offers for the same text, scored."""
    folder = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    document_words(spark, sf_dir).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows").withColumn("title_fold", F.col("text_fold"))
    index = search.stored_index(rows, "doc_id", "words", f"{folder}/index")
    return search.search(rows, "doc_id", TEXT_QUERY, index).select("doc_id", "score")


def _suggestion_sql(text: str) -> str:
    words = "string_split(index_fold, ' ')"
    return f"""
WITH {PREPARED},
marked AS (SELECT *, {candidate_test(text, words)} AS offered FROM prepared),
scored AS (
  SELECT id, title, CAST({query_score(text, 'title_fold', 'text_fold')} AS DOUBLE) AS score, post_date FROM marked
  WHERE offered OR NOT (SELECT bool_or(offered) FROM marked))
SELECT id, title, score FROM scored WHERE score > 0
ORDER BY score DESC, COALESCE(post_date, '1970-01-01') DESC, id LIMIT 8"""


def _suggestions(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    # Prepared rows and their index are stored tables in use; here they are written first.
    folder = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    prepared(spark, sf_dir).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    index = search.stored_index(rows, "id", "index_words", f"{folder}/index")
    date = browse.or_epoch(browse.when_of("post_date"))
    return search.suggestions(rows, "id", text, date, index).select("id", "title", "score")


@query(_suggestion_sql(PART_QUERY))
def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top eight matches; the index narrows the rows that are scored."""
    return _suggestions(spark, sf_dir, PART_QUERY)


@query(_suggestion_sql("zz99 gizmo"))
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query the index knows nothing about falls back to scoring every row."""
    return _suggestions(spark, sf_dir, "zz99 gizmo")


@query(_suggestion_sql(TITLE_QUERY))
def search_title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir, TITLE_QUERY)


@query(f"""
WITH {PREPARED},
first_word AS (SELECT id, string_split({fold('title')}, ' ')[1] AS w FROM prepared),
have AS (SELECT id, string_split({fold("COALESCE(canonical_title, '')")}, ' ') AS ws FROM prepared),
expected AS (
  SELECT id, 'p' AS kind, left(w, 6) AS key FROM first_word WHERE length(w) >= 2
  UNION ALL SELECT id, 'g', left(w, 3) FROM first_word WHERE length(w) >= 3)
SELECT e.id, e.kind, e.key FROM expected e JOIN have h USING (id)
WHERE NOT (CASE WHEN kind = 'p' THEN len(list_filter(ws, lambda t: starts_with(t, key))) > 0
           ELSE len(list_filter(ws, lambda t: contains(t, key))) > 0 END)""")
def index_missing_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose first word is missing from an index built over canonical titles only."""
    rows = prepared(spark, sf_dir)
    partial = search.postings(rows, "id", distinct_words(search_fold("canonical_title")))
    return search.missing_postings(rows, "id", "title", partial)


# Parts after three changes: a tenth of them renamed twice, every fiftieth removed, and one
# new record for every supplier.
_RENAMED = """
renamed AS (
  SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN 'Lantern ' || p_type || ' ' || p_size ELSE p_name END AS title
  FROM part WHERE p_partkey % 50 <> 7 UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""


def _indexed_parts(spark: SparkSession, sf_dir: str, merged: bool) -> SegmentedIndex:
    """The index of all part names, brought through the changes; merged after each where its sizes ask for it."""
    part = tables.table(spark, sf_dir, "part")
    day = datetime(2024, 1, 1)
    index = SegmentedIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")

    def named(rows: DataFrame, id_, title) -> DataFrame:
        return rows.select(id_.alias("id"), distinct_words(search_fold(title)).alias("words"))

    id_ = F.concat(F.lit("p"), F.col("p_partkey"))
    tenth = part.filter("p_partkey % 10 = 3 AND p_partkey % 50 <> 7")
    steps = [
        (named(tenth, id_, F.concat_ws(" ", F.lit("Interim"), "p_name")), None),
        (named(tables.table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey")), F.col("s_name")), part.filter("p_partkey % 50 = 7").select(id_.alias("id"))),
        (named(tenth, id_, F.concat_ws(" ", F.lit("Lantern"), "p_type", "p_size")), None),
    ]
    index.build(named(part, id_, F.col("p_name")), "words", day)
    for changed, removed in steps:
        index.update(changed, "words", day, removed)
        if merged:
            index.merge(day)
    return index


@query(f"""
WITH {_RENAMED},
words AS (SELECT DISTINCT id, unnest(string_split({fold('title')}, ' ')) AS w FROM renamed),
keys AS (
  SELECT DISTINCT id, 'p' AS kind, left(w, n) AS key FROM words, (SELECT unnest(range(2, 7)) AS n) WHERE length(w) >= n
  UNION ALL
  SELECT DISTINCT id, 'g', unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) FROM words WHERE length(w) >= 3)
SELECT kind, key, count(*) AS postings, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM keys GROUP BY kind, key""")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posting lists of an index that took three changes, by segments and merges."""
    found = _indexed_parts(spark, sf_dir, True).postings().groupBy("kind", "key")
    ids = F.array_join(F.sort_array(F.collect_list("id")), ",")
    return found.agg(F.count(F.lit(1)).alias("postings"), F.md5(ids).alias("ids"))


_ASKED = ["lantern promo", "blue gizmo", "supplier", "interim"]


@query(f"WITH {_RENAMED}, folded AS (SELECT id, string_split({fold('title')}, ' ') AS words FROM renamed) " + " UNION ALL ".join(
    f"SELECT '{q}' AS asked, id FROM folded WHERE {candidate_test(q, 'words')}" for q in _ASKED))
def index_changed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed segments offer for old and new words, before any merge."""
    index = _indexed_parts(spark, sf_dir, False).postings()
    out = None
    for asked in _ASKED:
        found = search.candidates(index, "id", asked).select(F.lit(asked).alias("asked"), "id")
        out = found if out is None else out.unionByName(found)
    return out
