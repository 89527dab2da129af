"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, chat, covertree, impacts, jaccard, mixing, neighbours, packing, pagetext, phrases, pii, separators, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


_ESC = r"regexp_replace({0}, '([<\[])(~*)(/?s>|\||/?INST\])', '\1~\2\3', 'g')"
CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(chat.TURN + chat.BODY + chat.END)} AS chars,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


@query(CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


MIX_SQL = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM slim GROUP BY source),
ordered AS (
  SELECT *, sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0) AS weight_left,
         (sum(source_size) OVER () - 3 * COALESCE(sum(source_size) OVER before, 0)) AS words_left
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(words_left AS DOUBLE) / weight_left AS level FROM ordered
  WHERE 3.0 * source_size / weight > CAST(words_left AS DOUBLE) / weight_left
  ORDER BY 3.0 * source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT level FROM level)) AS target FROM sources),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets),
units AS (
  SELECT source, key, sum(size) AS unit, COALESCE(sum(sum(size)) OVER (
           PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim GROUP BY source, key)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       CAST(CASE WHEN b.source_size = 0 THEN 0 ELSE b.budget // b.source_size * s.size
            + greatest(0, least(u.unit, b.budget % b.source_size - u.before)) * s.size // greatest(u.unit, 1) END AS BIGINT) AS taken
FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
     JOIN units u ON s.source IS NOT DISTINCT FROM u.source AND s.key = u.key"""


@query(MIX_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, counted between the separators of flat token files."""
    return separators.document_tokens(table(spark, sf_dir, "documents"))


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and digest of the base spans, and all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["base"]))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return base.select(
        "doc_id", *[number(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, ["doc_id"]).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return pagetext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, COALESCE(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
         END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id FROM sets s JOIN least l ON l.x = s.doc_id"""


@query(JACCARD_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of similar documents."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query()
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every embedding whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


TOP_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM good q JOIN good d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""


@query(TOP_SQL)
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every embedding whose id is divisible by 50, by integer scores."""
    return blocks.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


MINED_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = d.label AS same, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * d.v[i])) AS BIGINT) AS score
  FROM good a JOIN good d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""


@query(MINED_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100, for its 5 best rows of the same label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return covertree.hard_negatives(rows, F.col("vec_id") % 100 == 0)


LEXICAL_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM tokens WHERE len(w) > 0),
facts AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM docs),
counts AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM docs) GROUP BY doc_id, n, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * N_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, facts GROUP BY t, N_docs),
wanted AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (
  SELECT q.item_id, c.doc_id,
         CAST(sum(q.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * c.n * N_docs) // L)))) AS BIGINT) AS score
  FROM wanted q JOIN counts c USING (t) JOIN weights w USING (t), facts GROUP BY q.item_id, c.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 AND item_id IS NOT NULL AND doc_id IS NOT NULL QUALIFY rank <= 10"""


@query(LEXICAL_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return impacts.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REPEATS_SQL = r"""
WITH words AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)),
firsts AS (SELECT t, min(doc_id) AS least FROM windows GROUP BY t),
gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(s, s + 13))))) AS g
  FROM windows JOIN firsts USING (t) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(g), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i))), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)"""


@query(REPEATS_SQL)
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that start in a document with a smaller id."""
    kept = phrases.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
