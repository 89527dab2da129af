"""Scalar text functions: cleaning, tags, sizes, dates, sentences and language hints."""

from __future__ import annotations

import html.entities
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import _col, let, lookup_table, search_fold

# --- Fixed values -----------------------------------------------------------
SIZE_PATTERN = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(TB|TiB|GB|GiB|MB|MiB)"
ENTITY_ID_PATTERN = r"(?i)^Q\d+$"
GENRE_ALIASES = {
    "grand strategy wargame": "Grand Strategy",
    "role-playing": "RPG",
    "role-playing video": "RPG",
    "real-time strategy": "Real-Time Strategy",
    "turn-based strategy": "Turn-Based Strategy",
    "first-person shooter": "First-Person Shooter",
    "third-person shooter": "Third-Person Shooter",
}
PLATFORM_ALIASES = {
    "microsoft windows": "Windows",
    "windows": "Windows",
    "mac os": "macOS",
    "macos": "macOS",
    "mac": "macOS",
    "xbox series x and series s": "Xbox Series X/S",
    "xbox series x/s": "Xbox Series X/S",
    "playstation 5": "PlayStation 5",
    "playstation 4": "PlayStation 4",
    "nintendo switch": "Nintendo Switch",
}
ENGLISH_WORDS = [
    "the", "and", "with", "from", "into", "this", "that", "your", "you",
    "are", "for", "where", "have", "has", "will", "can", "their", "while",
    "through", "against", "of", "to", "in", "on",
]
FRENCH_WORDS = [
    "le", "la", "les", "un", "une", "des", "avec", "dans", "sur", "pour",
    "vous", "votre", "est", "sont", "qui", "que", "aux", "par", "et", "du",
]
AFFINITY_STOP_WORDS = [
    "the", "a", "an", "of", "and", "edition", "deluxe", "complete", "ultimate",
    "remastered", "remake", "goty", "version", "v", "build", "update", "dlc",
]
LINE_BULLETS = r"(?U)^[\s•·▪►→⇢–—-]+"
SENTENCE_BREAK = r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"“‘(\[])"""
LEFTOVER_MARK = r"ZXQ[A-Z0-9]*QXZ"
# -----------------------------------------------------------------------------

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85\u2028\u2029]"


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def collapse(value: Column | str) -> Column:
    """Every run of white space becomes one space; ends are trimmed; null reads as empty."""
    return F.btrim(F.regexp_replace(text_or_empty(value), r"(?U)\s+", " "))


def strip_text(value: Column | str) -> Column:
    """White space removed from both ends only."""
    return F.regexp_replace(text_or_empty(value), r"(?U)^\s+|\s+$", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is not empty; an empty text when there is none."""
    filled = F.filter(F.array(*values), lambda v: v != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


@lru_cache(maxsize=None)
def _entity_names() -> tuple[dict[str, str], str]:
    names = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
    legacy = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    return names, "|".join(legacy)


def unescape_entities(value: Column | str) -> Column:
    """Decode named and numeric character references. Rows without ``&`` are untouched."""
    text = text_or_empty(value)
    names, legacy = _entity_names()
    piece = (
        r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + legacy + r"))|[^&]+|&"
    )
    named = lookup_table(names)
    c1 = {}
    for code in range(0x80, 0xA0):
        c1[str(code)] = bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    c1_map = lookup_table(c1)

    def decode(token: Column) -> Column:
        body = F.regexp_replace(token, r"^&|;$", "")
        code = F.when(body.rlike(r"^#[xX]"), F.conv(F.regexp_replace(body, r"^#[xX]", ""), 16, 10)).otherwise(
            F.regexp_replace(body, "^#0*(?=[0-9])", "")
        )
        number = F.expr("0") + code.cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        numeric = F.when(valid, F.coalesce(F.element_at(c1_map, number.cast("string")), char)).otherwise("�")
        return (
            F.when(~token.startswith("&") | (token == "&"), token)
            .when(body.startswith("#"), numeric)
            .otherwise(F.coalesce(F.element_at(named, body), token))
        )

    decoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), decode), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


# --- lists -------------------------------------------------------------------

#: More items than an array holds.
MANY = 1 << 30


def distinct_by(items: Column, key, count: int = MANY) -> Column:
    """First item of every distinct non-empty ``key(item)``, order kept, ``count`` at most.

    Returns ``array<struct<key, value>>``. Items after the ``count``-th are not compared.
    """
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("key"), x.alias("value")))
    empty = F.slice(keyed, 1, 0)
    return F.aggregate(
        keyed,
        empty,
        lambda acc, x: F.when(
            (F.size(acc) >= count) | (x["key"] == "") | F.exists(acc, lambda seen: seen["key"] == x["key"]), acc
        ).otherwise(F.array_append(acc, x)),
    )


def values_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["value"])


def keys_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["key"])


def array_or_empty(items: Column | str) -> Column:
    return F.coalesce(_col(items), F.array().cast("array<string>"))


def clean_tags(items: Column | str) -> Column:
    """Trimmed, non-empty entries of an array of tags."""
    stripped = F.transform(array_or_empty(items), strip_text)
    return F.filter(stripped, lambda x: x != "")


def split_tags(text: Column | str) -> Column:
    """Tags from a comma separated string."""
    return clean_tags(F.split(text_or_empty(text), ","))


def capped_list(items: Column, item_chars: int, count: int) -> Column:
    """Trim, drop empties and repeats, cap each item and the list.

    A repeat is looked for among the already capped items, so an item longer than the
    cap is not recognised when it returns.
    """
    stripped = F.transform(array_or_empty(items), strip_text)
    kept = F.aggregate(
        stripped,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) >= count) | (x == "") | F.array_contains(acc, x), acc).otherwise(
            F.array_append(acc, F.left(x, F.lit(item_chars)))
        ),
    )
    return kept


def json_list(value: Column | str, item_chars: int = 180, count: int = 12) -> Column:
    """A JSON array of scalars as a cleaned list; anything else is an empty list."""
    return capped_list(F.from_json(_col(value), "array<string>"), item_chars, count)


def clean_scalar(value: Column | str) -> Column:
    """Collapsed text; a bare entity id counts as blank."""
    return F.regexp_replace(collapse(value), ENTITY_ID_PATTERN, "")


def display_genre(value: Column | str) -> Column:
    """Genre label for the index: trailing "game" words dropped, aliases applied."""
    text = collapse(value)
    short = F.btrim(F.regexp_replace(text, r"(?i)\s+(?:video|computer)?\s*game$", ""))
    aliases = lookup_table(GENRE_ALIASES)
    return let(short, lambda g: F.coalesce(F.element_at(aliases, F.lower(g)), g))


def genre_label(value: Column | str) -> Column:
    """Genre label for display: as ``display_genre`` and every word capitalised."""
    text = clean_scalar(value)
    for suffix in ("video game", "computer game", "game"):
        text = F.regexp_replace(text, rf"(?i)\s+{suffix}$", "")
    aliases = lookup_table(GENRE_ALIASES)

    def label(genre: Column) -> Column:
        words = F.split(genre, r"(?<=[-\s])")
        capital = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)))
        return F.coalesce(F.element_at(aliases, F.lower(genre)), F.array_join(capital, ""))

    return let(F.btrim(text), label)


def effective_tags(*lists: Column | str) -> Column:
    """Display labels of several tag lists, distinct by folded key, first seen wins.

    Returns ``array<struct<key, value>>``: folded key and label.
    """
    merged = F.flatten(F.array(*[array_or_empty(x) for x in lists]))
    return distinct_by(F.transform(merged, genre_label), search_fold)


def platform_label(value: Column | str) -> Column:
    aliases = lookup_table(PLATFORM_ALIASES)
    return let(clean_scalar(value), lambda p: F.coalesce(F.element_at(aliases, F.lower(p)), p))


def platform_list(items: Column | str, count: int = 5) -> Column:
    labels = F.transform(array_or_empty(items), platform_label)
    return values_of(distinct_by(labels, F.lower, count))


def merged_ids(first: Column, second: Column, count: int) -> Column:
    """Ids of two searches, first-seen order, capped."""
    return F.slice(F.array_distinct(F.concat(array_or_empty(first), array_or_empty(second))), 1, count)


# --- sizes and dates -----------------------------------------------------------


def size_mb(value: Column | str) -> Column:
    """Smallest size named in a text, in MB; null when none is found.

    Rounded half up to two places.
    """
    text = text_or_empty(value)
    numbers = F.regexp_extract_all(text, F.lit(SIZE_PATTERN), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(SIZE_PATTERN), F.lit(2))

    def in_mb(number: Column, unit: Column) -> Column:
        amount = F.replace(number, F.lit(","), F.lit(".")).cast("double")
        first = F.lower(F.left(unit, F.lit(1)))
        return amount * F.when(first == "t", 1048576.0).when(first == "g", 1024.0).otherwise(1.0)

    return F.round(F.array_min(F.zip_with(numbers, units, in_mb)), 2)


def year_of(value: Column | str) -> Column:
    """Year of a string that starts with 20xx, else null."""
    return blank_to_null(F.regexp_extract(text_or_empty(value), r"^(20\d{2})", 1)).cast("int")


def newest_text(*values: Column | str) -> Column:
    """Largest non-empty ISO string."""
    cleaned = [blank_to_null(text_or_empty(v)) for v in values]
    return F.greatest(*cleaned) if len(cleaned) > 1 else cleaned[0]


# --- long text -----------------------------------------------------------------


def compact_text(value: Column | str, limit: int = 6000) -> Column:
    text = F.regexp_replace(text_or_empty(value), r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r"(?U)\n\s*\n+", "\n\n")
    return F.left(strip_text(text), F.lit(limit))


def compact_lines(value: Column | str, headings: list[str] | None = None, limit: int = 40) -> Column:
    """Lines without bullets, distinct without regard to case, headings dropped."""
    lines = F.transform(
        F.split(text_or_empty(value), LINE_BREAK),
        lambda line: collapse(F.regexp_replace(line, LINE_BULLETS, "")),
    )
    if headings:
        lines = F.filter(lines, lambda line: ~F.lower(line).isin(headings))
    kept = values_of(distinct_by(lines, F.lower, limit))
    return F.transform(kept, lambda line: F.left(line, F.lit(500)))


def latin_words(value: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(value)), F.lit(r"([a-z']+)"), F.lit(1))


def _share_count(words: Column, common: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(common)))


def looks_english(value: Column | str) -> Column:
    """Fewer than six words pass; otherwise three English words and more than French."""
    words = latin_words(value)
    english = _share_count(words, ENGLISH_WORDS)
    return (F.size(words) < 6) | ((english >= 3) & (english > _share_count(words, FRENCH_WORDS)))


def english_share(value: Column | str) -> Column:
    words = latin_words(value)
    return F.when(
        F.size(words) > 0, _share_count(words, ENGLISH_WORDS).cast("double") / F.size(words)
    ).otherwise(F.lit(0.0))


def sentences(value: Column | str) -> Column:
    parts = F.transform(F.split(collapse(value), SENTENCE_BREAK), F.btrim)
    return F.filter(parts, lambda s: s != "")


def affinity_tokens(title: Column | str) -> Column:
    """Informative title words: longer than two letters, no stop words, no numbers."""
    words = F.split(search_fold(title), " ")
    return F.filter(
        words, lambda w: (F.length(w) > 2) & ~w.isin(AFFINITY_STOP_WORDS) & ~w.rlike("^[0-9]+$")
    )
