"""Text folds and tokens.

Two folds are in use. ``search_fold`` keys the search index; ``match_fold`` compares
titles during resolution and also expands compatibility forms and ``&``. Both stay in
the JVM: the character tables are derived from ``unicodedata`` once per process and
handed to ``translate`` as literals.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_MIN = 2
PREFIX_MAX = 6
GRAM_SIZE = 3

# No character beyond the first two planes is a mark or decomposes to ASCII.
LAST_FOLDED = 0x1FFFF

_ASCII_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once and written once into the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup_table(table: dict[str, str]) -> Column:
    """A constant map. Given as JSON, it is one literal in the plan whatever its size."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _strip_marks(text: str) -> str:
    return "".join(ch for ch in text if not unicodedata.combining(ch))


@lru_cache(maxsize=None)
def _search_table() -> tuple[str, str]:
    """(from, to) for ``translate``: mapped characters first, deleted marks after."""
    source, target, dropped = [], [], []
    for code in range(0x80, LAST_FOLDED + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            dropped.append(ch)
            continue
        folded = _strip_marks(unicodedata.normalize("NFD", ch)).lower()
        if folded == "":
            dropped.append(ch)
        elif len(folded) == 1 and folded in _ASCII_ALNUM:
            source.append(ch)
            target.append(folded)
    return "".join(source + dropped), "".join(target)


@lru_cache(maxsize=None)
def _match_tables() -> tuple[str, str, dict[str, str]]:
    """One-to-one table as in ``_search_table`` plus the one-to-many expansions."""
    source, target, dropped, expand = [], [], [], {}
    for code in range(0x80, LAST_FOLDED + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = _strip_marks(unicodedata.normalize("NFKD", ch)).casefold()
        if folded == "":
            dropped.append(ch)
            continue
        folded = re.sub(r"[^a-z0-9&]", " ", folded)
        if not folded.strip():
            continue
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            expand[ch] = folded
    return "".join(source + dropped), "".join(target), expand


def _char_class(chars) -> str:
    """Characters as the inside of a regular expression class, neighbours joined to ranges."""
    codes = sorted(ord(ch) for ch in chars)
    starts = [c for c in codes if c - 1 not in set(codes)]
    ends = [c for c in codes if c + 1 not in set(codes)]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def _words(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def search_fold(value: Column | str) -> Column:
    """Accents removed, lower case, every run of other characters one space."""
    source, target = _search_table()
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    plain = F.translate(text, source, target)
    return _words(F.lower(plain))


def match_fold(value: Column | str) -> Column:
    """Compatibility decomposition, case folding and ``&`` read as ``and``.

    The few characters that expand to several letters are handled by a lookup that
    only runs on rows containing one of them.
    """
    source, target, expand = _match_tables()
    several, table = _char_class(expand), lookup_table(expand)
    text = F.coalesce(_col(value).cast("string"), F.lit(""))

    def spell(piece: Column) -> Column:
        known = F.when(F.length(piece) == 1, F.element_at(table, piece))
        return F.coalesce(known, piece)

    def widen(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit(f"([{several}]|[^{several}]+)"), F.lit(1))
        spelled = F.array_join(F.transform(pieces, spell), "")
        return F.when(F.rlike(plain, F.lit(f"[{several}]")), spelled).otherwise(plain)

    wide = let(F.lower(F.translate(text, source, target)), widen)
    return _words(F.replace(wide, F.lit("&"), F.lit(" and ")))


def words_of(folded: Column | str) -> Column:
    """Words of an already folded text, first-seen order, duplicates kept."""
    return F.filter(F.split(_col(folded), " "), lambda t: t != "")


def distinct_words(folded: Column | str) -> Column:
    return F.array_distinct(words_of(folded))


def prefixes_of(token: Column, shortest: int = PREFIX_MIN, longest: int = PREFIX_MAX) -> Column:
    """Prefixes of ``token`` from ``shortest`` to ``longest`` characters."""
    top = F.least(F.lit(longest), F.length(token))
    lengths = F.when(top >= shortest, F.sequence(F.lit(shortest), top)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(lengths, lambda n: F.substring(token, F.lit(1), n))


def grams_of(token: Column, size: int = GRAM_SIZE) -> Column:
    """Distinct character grams of ``token`` in first-seen order."""
    last = F.length(token) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(token, i, F.lit(size))))


def fold_query(text: str) -> str:
    """``search_fold`` of a query literal, for building plans on the driver."""
    plain = _strip_marks(unicodedata.normalize("NFD", text or "")).lower()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def fold_match_literal(text: str) -> str:
    """``match_fold`` of a literal."""
    plain = _strip_marks(unicodedata.normalize("NFKD", text or "")).casefold()
    return re.sub(r"[^a-z0-9]+", " ", plain.replace("&", " and ")).strip()
