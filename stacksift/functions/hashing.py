"""Row, field and text hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import _col
from .text import collapse

DETAIL_NAME_LENGTH = 24


def text_hash(value: Column | str) -> Column:
    return F.sha2(_col(value).cast("string"), 256)


def collapsed_hash(value: Column | str) -> Column:
    """Hash of the text with white space collapsed."""
    return F.sha2(collapse(value), 256)


def fingerprint(*columns: Column | str) -> Column:
    """Hash of the compact JSON of the given columns, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def record_fingerprint(
    title: Column, source_url: Column, post_date: Column, tags: Column, description: Column, version: int
) -> Column:
    """Fingerprint of a catalog record; any change sends it through resolution again."""
    return fingerprint(
        title.alias("title"),
        source_url.alias("source_url"),
        post_date.alias("post_date"),
        tags.alias("genres"),
        description.alias("description"),
        F.lit(version).alias("ai_version"),
    )


def field_fingerprint(source: Column, terms: Column, version: int) -> Column:
    """Fingerprint of a translatable field and the terms it must keep."""
    return fingerprint(
        source.alias("source"), terms.alias("terms"), F.lit(version).alias("worker_version")
    )


def detail_name(entity_id: Column | str) -> Column:
    """File name of an entity's detail payload."""
    return F.left(text_hash(entity_id), F.lit(DETAIL_NAME_LENGTH))
