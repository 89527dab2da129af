"""Title functions: cleaning for lookup, parts for display, protected terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import _col, let, match_fold
from .text import clean_scalar, clean_tags, collapse, strip_text, unescape_entities

# --- Fixed values -----------------------------------------------------------
PACKAGE_WORDS = r"edition|bundle|collection|pack|content|soundtrack|ost|game\s+of\s+the\s+year|goty"
MARKETING_WORDS = (
    r"deluxe|ultimate|gold|complete|special|definitive|anniversary|"
    r"supporter|collector(?:'s)?|digital\s+deluxe|all[- ]inclusive"
)
PATCH_NOTES = "repack|portable|crack|fix"
EXTRAS = r"\s+\+\s+.*$"
DASHED_VERSION = r"(?:\s*[,–—-]\s*|\s+)v(?:ersion)?\s*\d[\w.\-]*(?:\s.*)?$"
DASHED_BUILD = r"(?:\s*[,–—-]\s*|\s+)build\s+\d+(?:\s.*)?$"
BRACKET_NOTE = r"\s*\((?:denuvoless|cracked?|portable)\)\s*$"
SHORT_DASH_VERSION = r"\s+[–—-]\s+(?:v(?:ersion)?\s*)?\d[\w.\-]*(?:\s.*)?$"
SHORT_VERSION = r"\s+v\d+(?:\.\d+)+(?:\s.*)?$"
SHORT_BUILD = r"\s+build\s+\d+(?:\s.*)?$"
TRAILING_RELEASE = (
    r"\s*[,–—-]\s*(?:v(?:ersion)?\s*[0-9][^,–—]*|ver\.?\s*[0-9][^,–—]*|"
    r"build\s+[0-9][^,–—]*|update\s+[0-9][^,–—]*)$"
)
TRAILING_NOTE = rf"\s*(?:\([^)]*(?:{PATCH_NOTES})[^)]*\)|\[[^\]]*(?:{PATCH_NOTES})[^\]]*\])\s*$"
TRAILING_PACKAGE = rf"\s*[:–—-]\s*[^:–—]{{0,90}}\b(?:{PACKAGE_WORDS})\b\s*$"
TRAILING_MARKETING = rf"\s*[:–—-]\s*(?:{MARKETING_WORDS})[^:–—]{{0,80}}$"
VARIANT_BREAK = (
    r"\s+[–—-]\s+(?=(?:v?\d|build\b|complete\b|deluxe\b|definitive\b|\d+\s+DLC))"
)
TITLE_STOP_WORDS = [
    "the", "of", "and", "a", "an", "to", "in", "on", "for", "with", "from",
    "edition", "complete", "deluxe", "definitive", "game", "bundle", "pack",
    "bonus", "soundtrack", "dlc", "dlcs",
]
# -----------------------------------------------------------------------------

_FLAGS = "(?iuU)"


def _cut(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, _FLAGS + pattern, "")


def _tidy(value: Column, edge: str, fallback: Column) -> Column:
    tidy = F.btrim(F.regexp_replace(value, r"(?U)\s{2,}", " "), F.lit(edge))
    return let(tidy, lambda t: F.when(t != "", t).otherwise(strip_text(fallback)))


def _start(title: Column) -> Column:
    return F.regexp_replace(strip_text(unescape_entities(title)), r"(?U)" + EXTRAS, "")


def lookup_title(title: Column | str) -> Column:
    """First-generation cleaning: extras, dashed versions and build numbers cut."""
    title = _col(title)
    value = _start(title)
    for pattern in (SHORT_DASH_VERSION, SHORT_VERSION, SHORT_BUILD):
        value = _cut(value, pattern)
    return _tidy(value, " -–—", title)


def conservative_title(title: Column | str) -> Column:
    """Cleaning used for the first search and for the evidence cache key."""
    title = _col(title)
    value = _start(title)
    for pattern in (DASHED_VERSION, DASHED_BUILD, BRACKET_NOTE):
        value = _cut(value, pattern)
    return _tidy(value, " ,;-–—", title)


def aggressive_title(title: Column | str) -> Column:
    """Base title: package, edition and marketing suffixes cut as well."""
    def base_title(base: Column) -> Column:
        value = base
        for pattern in (TRAILING_RELEASE, TRAILING_NOTE, TRAILING_PACKAGE, TRAILING_MARKETING):
            value = _cut(value, pattern)
        return _tidy(value, " ,;:-–—", base)

    return let(conservative_title(title), base_title)


def evidence_key(title: Column | str) -> Column:
    """Cache key of a title. It stays on the conservative form."""
    return match_fold(conservative_title(title))


def title_parts(title: Column | str) -> Column:
    """``struct<name, version>`` around the first spaced long dash."""
    source = clean_scalar(title)
    pieces = F.split(source, r"(?U)\s+[–—]\s+", -1)
    name = F.btrim(F.get(pieces, F.lit(0)))
    return F.struct(
        F.when(name == "", source).otherwise(name).alias("name"),
        F.btrim(F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))).alias("version"),
    )


def display_title(title: Column | str, canonical: Column | str) -> Column:
    verified = clean_scalar(canonical)
    return F.when(verified != "", verified).otherwise(title_parts(title)["name"])


def edition_title(title: Column | str, canonical: Column | str) -> Column:
    """What the listing title says beyond the canonical one."""
    source, verified = clean_scalar(title), clean_scalar(canonical)
    same = F.collate(source, "UNICODE_CI") == F.collate(verified, "UNICODE_CI")
    rest = F.btrim(
        F.regexp_replace(F.substring(source, F.length(verified) + 1, F.length(source)), r"(?U)^[\s:–—-]+", "")
    )
    return (
        F.when(source == "", "")
        .when(verified == "", title_parts(title)["version"])
        .when(same, "")
        .when(F.startswith(F.lower(source), F.lower(verified)), rest)
        .otherwise(source)
    )


def longest_first(terms: Column) -> Column:
    """Longest first, then case-insensitive, then as written."""
    ranked = F.transform(
        terms, lambda t: F.struct((-F.length(t)).alias("n"), F.lower(t).alias("l"), t.alias("t"))
    )
    return F.transform(F.array_sort(ranked), lambda r: r["t"])


def title_variants(title: Column | str) -> Column:
    """Names by which a running text may refer to a title."""
    def base_of(text: Column) -> Column:
        first = F.btrim(F.get(F.split(text, _FLAGS + VARIANT_BREAK, 2), F.lit(0)))
        return let(first, lambda name: F.when(name == "", text).otherwise(name))

    def parts(base: Column) -> Column:
        left = F.when(base.contains(":"), collapse(F.substring_index(base, ":", 1)))
        words = F.filter(
            F.regexp_extract_all(base, F.lit(r"([A-Za-z0-9][A-Za-z0-9'’.-]*)"), F.lit(1)),
            lambda w: ~F.lower(w).isin(TITLE_STOP_WORDS),
        )
        return F.struct(base.alias("base"), left.alias("left"), words.alias("words"))

    def names(p: Column) -> Column:
        words = p["words"]
        following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
        pairs = F.zip_with(
            words,
            following,
            lambda a, b: F.when((F.length(a) >= 3) & (F.length(b) >= 3), F.concat(a, F.lit(" "), b)),
        )
        long_words = F.filter(words, lambda w: (F.length(w) >= 8) & w.rlike(r"^[A-Za-z][A-Za-z'’-]*$"))
        found = F.concat(F.array(p["base"], F.when(F.length(p["left"]) >= 4, p["left"])), pairs, long_words)
        return longest_first(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))

    # Every step is evaluated once a row; written out, the base would be split anew for each use.
    return let(let(let(collapse(title), base_of), parts), names)


def protected_terms(
    title: Column | str, canonical: Column | str, developers: Column, publishers: Column
) -> Column:
    """Names a translation must keep, longest first."""
    verified, raw = collapse(canonical), collapse(title)
    names = title_variants(F.when(verified != "", verified).otherwise(raw))
    terms = F.concat(names, clean_tags(developers), clean_tags(publishers))
    terms = F.filter(
        F.transform(terms, collapse), lambda t: (F.length(t) >= 3) & ~t.rlike(r"(?i)^Q\d+$")
    )
    return longest_first(F.array_distinct(terms))
