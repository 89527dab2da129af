"""Fields of an external entity: labels, linked ids and dates out of nested claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

LANGUAGES = ("en", "fr")

VALUE_MAP = "map<string,struct<value:string>>"
CLAIM_MAP = (
    "map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string,time:string>>>>>>"
)
ENTITY_SCHEMA = f"id string, labels {VALUE_MAP}, descriptions {VALUE_MAP}, claims {CLAIM_MAP}"


def preferred(values: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """First non-empty text in language order; null when there is none."""
    return F.coalesce(*[blank_to_null(F.element_at(values, F.lit(lang))["value"]) for lang in languages])


def _snaks(claims: Column, prop: str) -> Column:
    found = F.transform(F.element_at(claims, F.lit(prop)), lambda c: c["mainsnak"]["datavalue"]["value"])
    return F.coalesce(found, F.array().cast("array<struct<id:string,time:string>>"))


def linked_ids(claims: Column, prop: str) -> Column:
    """Entity ids of a property, in claim order."""
    return F.filter(F.transform(_snaks(claims, prop), lambda v: v["id"]), lambda x: x.isNotNull())


def claim_dates(claims: Column, prop: str) -> Column:
    """Dates of a property as YYYY-MM-DD, sorted and distinct."""
    pattern = r"^[+-](\d{4}-\d{2}-\d{2})T"
    dates = F.transform(_snaks(claims, prop), lambda v: F.regexp_extract(v["time"], pattern, 1))
    return F.sort_array(F.array_distinct(F.filter(dates, lambda d: d.isNotNull() & (d != ""))))
