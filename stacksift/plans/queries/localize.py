"""Language hints, term protection, translation checks, field queues and the overlay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.hashing import collapsed_hash
from ...functions.text import ENGLISH_WORDS, FRENCH_WORDS, compact_lines, compact_text, english_share, looks_english, sentences
from ...operators import localize
from .. import tables
from .registry import collapse, query

NOW = datetime(2002, 1, 1)
TERMS = ["The", "Than", "on"]


def _hits(words: str, common: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in common)
    return f"len(list_filter({words}, lambda w: w IN ({listed})))"


_WORDS = "regexp_extract_all(lower({}), '[a-z'']+')"
_ENGLISH = """(len({w}) < 6 OR ({e} >= 3 AND {e} > {f}))"""


def _english(text: str) -> str:
    words = _WORDS.format(text)
    return _ENGLISH.format(w=words, e=_hits(words, ENGLISH_WORDS), f=_hits(words, FRENCH_WORDS))


def _share(text: str) -> str:
    words = _WORDS.format(text)
    return f"CASE WHEN len({words}) > 0 THEN {_hits(words, ENGLISH_WORDS)} / CAST(len({words}) AS DOUBLE) ELSE 0.0 END"


@query(f"SELECT doc_id, lang, {_english('text')} AS english, round({_share('text')}, 6) AS share FROM documents")
def language_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select(
        "doc_id", "lang", looks_english("text").alias("english"), F.round(english_share("text"), 6).alias("share")
    )


# The break is a lookaround in Spark; here a mark is put into the break and split at.
_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace({collapse('text')}, '([.!?])\s+([A-Z0-9"“‘(\[])',
  '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents)
SELECT doc_id, md5(s) AS sentence, count(*) AS times FROM s GROUP BY 1, 2""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).select("doc_id", F.explode(sentences("text")).alias("s"))
    return rows.groupBy("doc_id", F.md5("s").alias("sentence")).agg(F.count(F.lit(1)).alias("times"))


def _masked() -> str:
    """Terms replaced in order; a number is only used up by a term that occurs."""
    levels = "SELECT doc_id, text AS m, 0 AS n FROM documents"
    for term in TERMS:
        levels = f"""SELECT doc_id, CASE WHEN contains(m, '{term}') THEN replace(m, '{term}', 'ZXQ0' || (n + 1) || 'QXZ') ELSE m END AS m,
          n + CASE WHEN contains(m, '{term}') THEN 1 ELSE 0 END AS n FROM ({levels})"""
    return levels


@query(f"""
SELECT doc_id, md5(m) AS masked, n::INTEGER AS marks, true AS restored, 0::INTEGER AS missing FROM ({_masked()})""")
def term_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms protected in whole texts and put back."""
    terms = F.array(*[F.lit(t) for t in TERMS])
    rows = tables.documents(spark, sf_dir).withColumn("p", localize.protect(F.col("text"), terms))
    rows = rows.withColumn("r", localize.restore(F.col("p.text"), F.col("p.marks")))
    return rows.select(
        "doc_id", F.md5("p.text").alias("masked"), F.size("p.marks").alias("marks"),
        (F.col("r.text") == F.col("text")).alias("restored"), F.size("r.missing").alias("missing"),
    )


_TURNS = """
t AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations),
pairs AS (SELECT conv_id, turn, source, trim(said) AS said, length(trim(said)) / CAST(greatest(length(source), 1) AS DOUBLE) AS ratio
  FROM t WHERE said IS NOT NULL)"""


@query(f"""
WITH {_TURNS}
SELECT conv_id, turn, CASE WHEN said = '' THEN 'empty translated sentence'
  WHEN ratio < 0.30 OR ratio > 2.20 THEN 'implausible length ratio'
  WHEN length(said) >= 80 AND {_share('said')} >= 0.20 THEN 'excessive English residue' END AS problem FROM pairs""")
def translation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every next turn of a conversation checked as if it translated the one before."""
    rows = tables.table(spark, sf_dir, "conversations")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.btrim("text").alias("said"))
    none = F.array().cast("array<string>")
    problem = localize.sentence_problem(F.col("text"), F.col("said"), none, none)
    kind = F.regexp_replace(problem, r" ratio [0-9.]+$", " ratio")
    return rows.join(following, ["conv_id", "turn"]).select("conv_id", "turn", kind.alias("problem"))


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the text as description, its lines as features."""
    rows = tables.documents(spark, sf_dir)
    details = F.struct(F.col("text").alias("description"), F.split("text", "\n").alias("features"))
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Document: "), "source").alias("title"), "lang", details.alias("details")
    )


def document_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir)
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("").alias("canonical_title"),
        F.concat(F.lit("Studio "), "source").alias("developer"), F.lit("Q12").alias("publisher"),
    )


_FIELDS = f"""
f AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, 'description' AS field_key, {collapse('text')} AS s, 40 AS least FROM documents
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), source, lang, 'game_feature:' || printf('%04d', i - 1), {collapse('line')}, 12
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
fields AS (SELECT *, sha256(s) AS sha FROM f WHERE length(s) >= least AND {_english('s')})"""


@query(f"WITH {_FIELDS} SELECT id, field_key, sha AS source_sha256, 'Document: ' || source || '|Document ' || source || '|Studio ' || source || '|Document' AS terms FROM fields")
def translatable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all documents that are worth translating, with the terms to keep."""
    rows = localize.wanted_jobs(document_catalog(spark, sf_dir), document_verified(spark, sf_dir))
    return rows.select("id", "field_key", "source_sha256", F.array_join("terms", "|").alias("terms"))


@query(f"""
WITH {_FIELDS}
SELECT id, field_key, CASE WHEN lang = 'fr' THEN 'queued' WHEN source = 'src1' THEN 'changed' ELSE 'unchanged' END AS outcome,
  CASE WHEN lang = 'fr' OR source = 'src1' THEN 'pending' ELSE 'done' END AS status FROM fields
UNION ALL SELECT 'gone-' || CAST(n_nationkey AS VARCHAR), 'description', 'dropped', 'done' FROM nation""")
def field_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field queue against one that lacks French documents and has old texts of one source."""
    wanted = localize.wanted_jobs(document_catalog(spark, sf_dir), document_verified(spark, sf_dir))
    facts = tables.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "lang", "source")
    stored = wanted.join(facts.filter("lang <> 'fr'"), "id").withColumn(
        "fingerprint", F.when(F.col("source") == "src1", "old").otherwise(F.col("fingerprint"))
    )
    stored = _as_done(stored).drop("lang", "source")
    gone = tables.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("gone-"), "n_nationkey").alias("id"), F.lit("description").alias("field_key"), F.lit("x").alias("fingerprint"),
        F.lit("x").alias("source_sha256"), F.lit("x").alias("source_text"), F.array(F.lit("x")).alias("terms"), F.lit(1).alias("worker_version"),
    )
    rows = localize.sync_fields(wanted, stored.unionByName(_as_done(gone)), NOW)
    return rows.select("id", "field_key", "outcome", "status")


def _as_done(rows: DataFrame) -> DataFrame:
    stamp = F.lit(NOW).cast("timestamp")
    return rows.select(
        "*", F.lit("done").alias("status"), F.lit(1).alias("attempts"), F.lit("texte traduit").alias("translated_text"),
        F.lit(None).cast("string").alias("last_error"), F.lit(True).alias("active"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


@query(f"""
WITH {_FIELDS}
SELECT id, field_key FROM fields WHERE lang = 'fr' OR source = 'src1'
ORDER BY CASE field_key WHEN 'description' THEN 0 ELSE 1 END, id, field_key LIMIT 24""")
def field_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fields to translate of a queue of all; those of French documents and one source are pending."""
    catalog = document_catalog(spark, sf_dir)
    facts = tables.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), (F.coalesce(F.col("lang") == "fr", F.lit(False)) | F.coalesce(F.col("source") == "src1", F.lit(False))).alias("open"))
    queue = _as_done(localize.wanted_jobs(catalog, document_verified(spark, sf_dir))).join(facts, "id")
    queue = queue.withColumn("status", F.when(F.col("open"), "pending").otherwise(F.col("status"))).drop("open")
    return localize.field_work(queue, 24).select("id", "field_key")


def translated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published translations: marked copies of every field, outdated for one source."""
    wanted = localize.wanted_jobs(document_catalog(spark, sf_dir), document_verified(spark, sf_dir))
    facts = tables.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "source")
    done = _as_done(wanted).withColumn("translated_text", F.concat(F.lit("fr: "), "source_text")).join(facts, "id")
    stale = F.sha2(F.lit("stale"), 256)
    done = done.withColumn("source_sha256", F.when(F.col("source") == "src2", stale).otherwise(F.col("source_sha256")))
    return localize.translation_rows(done.drop("source"))


@query(f"""
WITH {_FIELDS}
SELECT id, count_if(field_key = 'description') > 0 AS described, count_if(field_key <> 'description')::INTEGER AS features,
       count(*) AS fields FROM fields GROUP BY id""")
def translation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated fields nested into one row per record."""
    nested = localize.nested_translations(translated_rows(spark, sf_dir))
    return nested.select("id", F.col("description").isNotNull().alias("described"), F.size("features").alias("features"), "fields")


@query(f"""
WITH {_FIELDS},
good AS (SELECT * FROM fields WHERE source <> 'src2')
SELECT CAST(d.doc_id AS VARCHAR) AS id, (SELECT count(*) FROM good g WHERE g.id = CAST(d.doc_id AS VARCHAR))::INTEGER AS translated_fields,
  md5(COALESCE((SELECT 'fr: ' || s FROM good g WHERE g.id = CAST(d.doc_id AS VARCHAR) AND field_key = 'description'), d.text)) AS description
FROM documents d""")
def overlay_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations laid over their sources where the stored hash still holds."""
    rows = localize.overlay(document_catalog(spark, sf_dir), translated_rows(spark, sf_dir))
    return rows.select("id", "translated_fields", F.md5("details.description").alias("description"))


@query(rf"""
SELECT doc_id, sha256({collapse('text')}) AS collapsed,
  md5(left(trim(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)), 6000)) AS compact
FROM documents""")
def text_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select(
        "doc_id", collapsed_hash("text").alias("collapsed"), F.md5(compact_text("text")).alias("compact")
    )


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, {collapse("regexp_replace(line, '^[ \t•*\\-–—]+', '')")} AS line FROM l),
d AS (SELECT * FROM c WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, md5(left(line, 500)) AS line
FROM d QUALIFY pos < 40""")
def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of every document without bullets."""
    lines = tables.documents(spark, sf_dir).select("doc_id", F.posexplode(compact_lines("text")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.md5("line").alias("line"))
