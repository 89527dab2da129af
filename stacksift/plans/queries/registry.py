"""Registry of queries, and the SQL form of the entities in ``plans.tables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def fold(text: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g'))"


def collapse(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


CATALOG = f"""
shipments AS (
  SELECT l_partkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
         min(l_suppkey) AS s_suppkey, sum(l_quantity) AS quantity, count(*) AS lines
  FROM lineitem GROUP BY l_partkey),
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand, p_type, p_size,
         'https://parts.example.com/' || p_partkey || '/' AS source_url,
         CASE WHEN p_retailprice > 1000 THEN 'https://img.example.com/' || p_partkey END AS image_url,
         {day('last_ship')} AS post_date, p_size || ' GB' AS size_text,
         CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE '' END AS description,
         p_size % 2 = 0 AS details_ready,
         CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS media_count,
         p_size > 25 AND p_size % 2 = 0 AS has_gif,
         p_size > 10 AS media_ready
  FROM part LEFT JOIN shipments ON l_partkey = p_partkey),
verified AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_type || ' ' || p_name) AS canonical_title,
         {day('first_ship')} AS release_date, lower(p_type) || ' video game' AS genre,
         quantity / (50 * lines) AS confidence, 'https://www.example.org/wiki/Q' || p_partkey AS evidence_url,
         {day('last_ship')} AS checked_at, s_name AS developer, n_name AS publisher
  FROM shipments JOIN part ON p_partkey = l_partkey
       JOIN supplier USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey
  WHERE quantity >= 25 * lines)
"""

LIGHT = (
    CATALOG
    + """,
light AS (
  SELECT c.*, v.canonical_title, v.release_date, v.developer, v.publisher, v.id IS NOT NULL AS metadata_ready,
         NOT (c.details_ready AND c.media_ready) AS enrichment_pending
  FROM catalog c LEFT JOIN verified v USING (id))"""
)

_LABEL = "upper(left(lower(p_type), 1)) || substr(lower(p_type), 2)"

PREPARED = (
    LIGHT
    + f""",
prepared AS (
  SELECT *, COALESCE(left(release_date, 4), '') AS release_year,
         {fold("CASE WHEN canonical_title IS NULL THEN title ELSE canonical_title END")} AS title_fold,
         {fold(f'''concat_ws(' ', title, COALESCE(canonical_title, ''), size_text, COALESCE(left(release_date, 4), ''),
                   COALESCE(developer, ''), COALESCE(publisher, ''),
                   CASE WHEN metadata_ready THEN 'Microsoft Windows ' || {_LABEL} || ' ' || p_brand
                        ELSE p_brand || ' ' || p_type END)''')} AS text_fold,
         {fold('''concat_ws(' ', title, COALESCE(canonical_title, ''), COALESCE(developer, ''), COALESCE(publisher, ''),
                   COALESCE(left(release_date, 4), ''), p_brand, p_type,
                   CASE WHEN metadata_ready THEN p_type || ' video game' ELSE '' END)''')} AS index_fold,
         {fold('p_brand')} AS brand_key, {fold('p_type')} AS type_key,
         CASE WHEN metadata_ready THEN {_LABEL} ELSE p_type END AS type_label
  FROM light)"""
)

TAGS = (
    PREPARED
    + """,
tags AS (
  SELECT id, CASE WHEN metadata_ready THEN 0 ELSE 1 END AS pos, type_key AS key, type_label AS label FROM prepared
  UNION ALL
  SELECT id, CASE WHEN metadata_ready THEN 1 ELSE 0 END, brand_key, p_brand FROM prepared)"""
)


def word_score(word: str, token: str = "t") -> str:
    near = 1 if len(word) <= 5 else 2
    fuzzy = ""
    if len(word) >= 4:
        fuzzy = (
            f"WHEN abs(length({token}) - {len(word)}) <= 2 AND levenshtein({token}, '{word}') <= {near}"
            f" THEN 48 - 8 * levenshtein({token}, '{word}') "
        )
    return (
        f"CASE WHEN {token} = '{word}' THEN 90 WHEN starts_with({token}, '{word}') THEN 75"
        f" WHEN contains({token}, '{word}') THEN 58 {fuzzy}ELSE 0 END"
    )


def query_score(query_text: str, title: str, text: str) -> str:
    """SQL of the relevance of a row whose folded title and text are columns."""
    words = query_text.split(" ")
    tokens = f"string_split({text}, ' ')"
    best = [f"list_max(list_transform({tokens}, lambda t: {word_score(w)}))" for w in words]
    penalty = len(query_text) * 0.01
    return f"""CASE WHEN {title} = '{query_text}' THEN 500
      WHEN starts_with({title}, '{query_text}') THEN {420 - penalty}
      WHEN contains({title}, '{query_text}') THEN {360 - penalty}
      WHEN contains({text}, '{query_text}') THEN 300
      WHEN {' AND '.join(f'{b} > 0' for b in best)} THEN {' + '.join(best)}
      ELSE 0 END"""


def candidate_test(query_text: str, words: str) -> str:
    """SQL of the index narrowing on a list of index words."""
    tests = []
    for word in (w for w in query_text.split(" ") if len(w) >= 2):
        test = f"len(list_filter({words}, lambda t: starts_with(t, '{word[:6]}'))) > 0"
        if len(word) >= 4:
            grams = list(dict.fromkeys(word[i : i + 3] for i in range(len(word) - 2)))
            hits = " + ".join(
                f"CASE WHEN len(list_filter({words}, lambda t: contains(t, '{g}'))) > 0 THEN 1 ELSE 0 END" for g in grams
            )
            needed = max(1, -(-len(grams) * 4 // 10))
            test = f"({test} OR {hits} >= {needed})"
        tests.append(test)
    return " AND ".join(tests)
