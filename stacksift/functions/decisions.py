"""Decision requests and responses: building the payload, reading the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import let
from .text import capped_list, collapse, strip_text, text_or_empty

# --- Fixed values -----------------------------------------------------------
FORBIDDEN_KEYS = [
    "magnet", "magnets", "torrent", "torrents", "torrent_links",
    "download", "downloads", "download_url", "download_mirrors",
]
NULL_WORDS = ["null", "none", "unknown", "n/a"]
REQUEST_CAPS = {"release_dates": 6, "genres": 12, "developers": 8, "publishers": 8, "platforms": 16}
REASON_CHARS = 600
ID_KEYS = ["candidate_id", "candidate", "id"]
ENTITY_ID = r"(?i)\b(Q\d+)\b"
STATED_CONFIDENCE = r"(?i)\bconfidence(?:_score)?\s*[:=]?\s*(\d+(?:[.,]\d+)?\s*%?)"
DECLINED = r"(?i)\b(?:candidate(?:_id)?\s*[:=]?\s*)?(?:null|none|unknown|n/a)\b"
# -----------------------------------------------------------------------------


def candidate_payload(candidate: Column) -> Column:
    """The part of a candidate that a decision maker sees, lists capped."""
    fields = [candidate[name].alias(name) for name in ("id", "label", "description")]
    fields += [F.slice(candidate[name], 1, cap).alias(name) for name, cap in REQUEST_CAPS.items()]
    return F.struct(*fields, candidate["url"].alias("url"))


def source_entry(title: Column, tags: Column) -> Column:
    """JSON of the entry that a decision is about."""
    return F.to_json(F.struct(title.alias("title"), F.slice(tags, 1, 12).alias("genres")))


def candidate_list(candidates: Column) -> Column:
    """JSON of what a decision maker sees of the candidates."""
    return F.to_json(F.transform(candidates, candidate_payload))


def request_text(source: Column, candidates: Column) -> Column:
    """Compact JSON request out of the JSON of its entry and of its candidates, with the answer format."""
    form = F.to_json(
        F.struct(
            F.lit("string|null; must be one supplied candidate id").alias("candidate_id"),
            F.lit("number 0..1").alias("confidence"),
            F.lit("short string").alias("reason"),
        )
    )
    return F.concat(
        F.lit('{"source_entry":'), source, F.lit(',"candidates":'), candidates, F.lit(',"required_schema":'), form, F.lit("}")
    )


def decision_request(title: Column, tags: Column, candidates: Column) -> Column:
    """Compact JSON request: one entry, its candidates, the answer format."""
    return request_text(source_entry(title, tags), candidate_list(candidates))


def unfenced(text: Column | str) -> Column:
    """Response text without a surrounding code fence."""
    value = F.regexp_replace(strip_text(text), r"(?i)^```(?:json)?\s*", "")
    return F.regexp_replace(value, r"\s*```$", "")


def json_object(text: Column | str) -> Column:
    """The JSON object of a response as ``map<string,string>``; null when there is none."""
    value = unfenced(text)
    inner = F.regexp_extract(value, r"(?s)(\{.*\})", 1)

    def read(part: Column) -> Column:
        return F.when(F.try_parse_json(part).isNotNull(), F.from_json(part, "map<string,string>"))

    # An object inside prose counts; one inside other JSON, such as a list, does not.
    prose = F.try_parse_json(value).isNull()
    return F.coalesce(F.when(value.startswith("{"), read(value)), F.when(prose & (inner != ""), read(inner)))


def confidence_number(text: Column) -> Column:
    """Number, percent or decimal comma; null when unreadable."""
    value = F.replace(F.btrim(text), F.lit(","), F.lit("."))
    percent = F.btrim(F.regexp_replace(value, "%$", "")).try_cast("double") / 100.0
    return F.when(value.endswith("%"), percent).otherwise(value.try_cast("double"))


def _mentioned(text: Column, allowed: Column) -> Column:
    """Allowed ids named in a text, without regard to case, distinct."""
    named = F.transform(F.regexp_extract_all(text, F.lit(ENTITY_ID), F.lit(1)), F.upper)
    return F.filter(allowed, lambda a: F.array_contains(named, F.upper(a)))


def stated_ids(text: Column | str) -> Column:
    """Upper-case ids that a response may name, distinct; ``parse_decision`` finds an allowed id by no other."""

    def ids(seen: Column) -> Column:
        raw = seen["raw"]
        wanted = strip_text(F.coalesce(*[F.element_at(raw, F.lit(name)) for name in ID_KEYS]))
        source = F.when(raw.isNotNull(), wanted).otherwise(seen["compact"])
        named = F.transform(F.regexp_extract_all(source, F.lit(ENTITY_ID), F.lit(1)), F.upper)
        return F.array_distinct(F.concat(named, F.array(F.upper(wanted))))

    return let(F.struct(json_object(text).alias("raw"), collapse(unfenced(text)).alias("compact")), ids)


def parse_decision(text: Column | str, allowed: Column) -> Column:
    """``struct<candidate_id, confidence, reason, error>`` of a response.

    Reads strict, fenced or embedded JSON with synonym keys, else plain text that names
    exactly one allowed id or a null word and states a confidence.
    """
    seen = F.struct(
        json_object(text).alias("raw"), collapse(unfenced(text)).alias("compact"), allowed.alias("allowed")
    )
    return let(let(seen, _read_answer), _checked_answer)


def _read_answer(seen: Column) -> Column:
    """What a response says, before any check."""
    raw, compact, allowed = seen["raw"], seen["compact"], seen["allowed"]

    def field(*names: str) -> Column:
        return F.coalesce(*[F.element_at(raw, F.lit(name)) for name in names])

    structured = raw.isNotNull()
    wanted = strip_text(field(*ID_KEYS))
    stated = F.regexp_extract(compact, STATED_CONFIDENCE, 1)
    said = F.when(structured, field("confidence", "confidence_score")).otherwise(F.nullif(stated, F.lit("")))
    return F.struct(
        structured.alias("structured"),
        (compact == "").alias("empty"),
        F.when(structured, (wanted == "") | F.lower(wanted).isin(NULL_WORDS)).otherwise(
            compact.rlike(DECLINED)
        ).alias("declined"),
        F.when(structured & F.array_contains(allowed, wanted), wanted).alias("exact"),
        _mentioned(F.when(structured, wanted).otherwise(compact), allowed).alias("named"),
        said.isNotNull().alias("stated"),
        confidence_number(said).alias("confidence"),
        F.when(structured, collapse(field("reason", "rationale"))).otherwise(compact).alias("reason"),
    )


def _checked_answer(said: Column) -> Column:
    structured, named, confidence = said["structured"], F.size(said["named"]), said["confidence"]
    prose_choice = F.when(named == 1, F.get(said["named"], F.lit(0)))
    chosen = F.when(structured & said["declined"], None).otherwise(F.coalesce(said["exact"], prose_choice))
    error = (
        F.when(said["empty"], "response is empty")
        .when(
            structured & ~said["declined"] & said["exact"].isNull() & (named != 1),
            "selected a candidate outside the supplied evidence",
        )
        .when(~structured & (named > 1), "mentions multiple supplied candidates")
        .when(~structured & (named == 0) & ~said["declined"], "contains no usable supplied candidate")
        .when(~structured & ~said["stated"], "missing explicit confidence")
        .when(confidence.isNull() | F.isnan(confidence), "confidence is missing or invalid")
        .when(~confidence.between(0.0, 1.0), "confidence must be between 0 and 1")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, chosen).alias("candidate_id"),
        F.when(ok, confidence).alias("confidence"),
        F.when(ok, F.left(said["reason"], F.lit(REASON_CHARS))).alias("reason"),
        error.alias("error"),
    )


def _capped_text(value: Column, limit: int) -> Column:
    return F.nullif(F.left(strip_text(value), F.lit(limit)), F.lit(""))


RESULT_JSON = (
    "canonical_title string, release_date string, genres array<string>, developer string, publisher string,"
    " platforms array<string>, description string, confidence string, evidence_urls array<string>, notes string"
)


def validate_result(text: Column | str, allowed_urls: Column) -> Column:
    """A proposed result record, checked field by field.

    ``error`` is set for forbidden keys and for an unusable confidence; other fields
    that do not hold are blanked.
    """
    def read(body: Column) -> Column:
        keys = F.transform(F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body)), F.lower)
        return F.struct(F.from_json(body, RESULT_JSON).alias("parsed"), keys.alias("keys"))

    def body_of(value: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, r"(?s)(\{.*\})", 1), F.lit("")), value)

    # Every step is evaluated once a row; written out, the response would be parsed for each field.
    return let(let(let(unfenced(text), body_of), read), lambda r: _checked_result(r["parsed"], r["keys"], allowed_urls))


def _checked_result(parsed: Column, keys: Column, allowed_urls: Column) -> Column:
    confidence = parsed["confidence"].try_cast("double")
    release = strip_text(parsed["release_date"])
    urls = capped_list(parsed["evidence_urls"], 160, 10)
    error = (
        F.when(keys.isNull(), "response does not contain a JSON object")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])), "forbidden field")
        .when(confidence.isNull() | F.isnan(confidence), "confidence is missing or invalid")
        .when(~confidence.between(0.0, 1.0), "confidence must be between 0 and 1")
    )
    return F.struct(
        _capped_text(parsed["canonical_title"], 300).alias("canonical_title"),
        F.when(release.rlike(r"^\d{4}-\d{2}-\d{2}$"), release).alias("release_date"),
        capped_list(parsed["genres"], 160, 12).alias("genres"),
        _capped_text(parsed["developer"], 300).alias("developer"),
        _capped_text(parsed["publisher"], 300).alias("publisher"),
        capped_list(parsed["platforms"], 160, 24).alias("platforms"),
        _capped_text(parsed["description"], 12000).alias("description"),
        confidence.alias("confidence"),
        F.filter(urls, lambda u: F.array_contains(allowed_urls, u)).alias("evidence_urls"),
        _capped_text(parsed["notes"], 1200).alias("notes"),
        error.alias("error"),
    )


def acceptance(result: Column, threshold: float) -> Column:
    """``done`` when the core fields are present and the confidence suffices, else ``review``."""
    complete = (
        result["canonical_title"].isNotNull()
        & result["release_date"].isNotNull()
        & (F.size(result["genres"]) > 0)
        & (F.size(result["evidence_urls"]) > 0)
    )
    return F.when(complete & (result["confidence"] >= threshold), "done").otherwise("review")


def retry_seconds(retry_after: Column, attempt: Column, now: Column) -> Column:
    """Seconds to wait: a stated delay or date of at least one second, else backoff."""
    stated = text_or_empty(retry_after).try_cast("double")
    when = F.try_to_timestamp(
        F.regexp_replace(text_or_empty(retry_after), r"^[A-Za-z]{3},\s*|\s*(?:GMT|UTC)$", ""),
        F.lit("d MMM yyyy HH:mm:ss"),
    )
    until = (F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double")
    backoff = F.least(F.lit(60.0), 5.0 * F.pow(F.lit(2.0), attempt.cast("double")))
    return F.coalesce(F.greatest(stated, F.lit(1.0)) + 0 * stated, F.greatest(until, F.lit(1.0)) + 0 * until, backoff)
