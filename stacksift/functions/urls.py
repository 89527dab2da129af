"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import _col, let
from .text import text_or_empty

# --- Fixed values -----------------------------------------------------------
RESIZE_KEYS = ["w", "width", "h", "height", "resize", "fit", "crop"]
ANIMATION_EXT = r"(?i)\.gif(?:$|[?#])"
IMAGE_EXT = r"(?i)\.(?:jpe?g|png|webp)(?:$|[?#])"
THUMBNAIL_EXT = r"(?i)\.jpg\.240p\.jpg(?:$|[?#])"
LISTING_PATHS = ["feed", "page/", "category/", "tag/", "author/"]
MEDIA_SKIP_HINTS = [
    "logo", "avatar", "emoji", "smiley", "counter", "rating", "button", "icon",
    "badge", "banner", "donat", "patreon", "discord", "telegram", "rss", "feed",
    "registered-users", "torrent-stats",
]
DISPLAY_SKIP_HINTS = ["logo", "avatar", "counter", "rating", "button", "icon", "badge", "banner", "donat"]
# -----------------------------------------------------------------------------


def url_part(url: Column | str, part: str) -> Column:
    return F.try_parse_url(_col(url), F.lit(part))


def host_of(url: Column | str) -> Column:
    return F.lower(F.coalesce(url_part(url, "HOST"), F.lit("")))


def is_https(url: Column | str) -> Column:
    return F.coalesce(url_part(url, "PROTOCOL") == "https", F.lit(False)) & (host_of(url) != "")


def host_allowed(url: Column | str, hosts: list[str] = (), suffixes: list[str] = ()) -> Column:
    """Exact host, or a host ending in one of ``suffixes``."""
    host = host_of(url)
    allowed = host.isin(list(hosts)) if hosts else F.lit(False)
    for suffix in suffixes:
        allowed = allowed | host.endswith(suffix)
    return allowed


def without_fragment(url: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(url), r"#.*$", "")


def identity(url: Column | str) -> Column:
    """URL without query and fragment."""
    return F.regexp_replace(text_or_empty(url), r"[?#].*$", "")


def without_trailing_slash(url: Column | str) -> Column:
    return F.regexp_replace(without_fragment(url), "/$", "")


def with_slash(url: Column | str) -> Column:
    """Exactly one trailing slash."""
    return F.concat(F.regexp_replace(text_or_empty(url), "/+$", ""), F.lit("/"))


def to_https(url: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(url), "^http://", "https://")


def last_segment(url: Column | str) -> Column:
    """Last path segment: the record id of a source URL."""
    path = F.regexp_replace(F.coalesce(url_part(url, "PATH"), F.lit("")), "/+$", "")
    return F.substring_index(path, "/", -1)


def post_url(url: Column | str, host: str | None = None) -> Column:
    """Canonical https URL of a post, or null for listing pages and other hosts."""
    fixed = to_https(F.btrim(text_or_empty(url)))
    path = F.btrim(F.coalesce(url_part(fixed, "PATH"), F.lit("")), F.lit("/"))
    site = F.coalesce(url_part(fixed, "AUTHORITY"), F.lit(""))
    listing = F.lit(False)
    for start in LISTING_PATHS:
        listing = listing | path.startswith(start)
    ok = F.coalesce(url_part(fixed, "PROTOCOL") == "https", F.lit(False)) & (path != "") & ~listing
    ok = ok & ((site == host) if host else (site != ""))
    return F.when(ok, F.concat(F.lit("https://"), site, F.lit("/"), path, F.lit("/")))


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments carried out."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    done = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def absolute(base: Column | str, link: Column | str) -> Column:
    """Resolve ``link`` against ``base`` and force https; empty for other schemes.

    Covers absolute, protocol-relative, root-relative, query-only and path-relative
    links. Each ``..`` goes up one level, any number of them to the root at most.
    """
    pair = F.struct(text_or_empty(base).alias("base"), F.btrim(text_or_empty(link)).alias("link"))

    def resolve(x: Column) -> Column:
        base, link = x["base"], x["link"]
        origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        folder = F.regexp_extract(identity(base), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*/|/)?", 1)
        joined = F.concat(F.when(folder == "", "/").otherwise(folder), link)
        tail = F.regexp_extract(joined, r"(?s)^[^?#]*(.*)$", 1)
        joined = F.concat(_without_dots(F.regexp_extract(joined, r"^([^?#]*)", 1)), tail)
        return (
            F.when((link == "") | link.rlike(r"^(?:data|javascript):"), "")
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.startswith("?"), F.concat(identity(base), link))
            .when(link.startswith("#"), F.concat(without_fragment(base), link))
            .otherwise(F.concat(origin, joined))
        )

    secure = F.regexp_replace(let(pair, resolve), "^http://", "https://")
    return F.regexp_extract(secure, r"^(https://[^/?#]+.*)$", 1)


def source_label(url: Column | str, labels: dict[str, str] = {}, suffix_labels: dict[str, str] = {}) -> Column:
    """Readable name of an evidence host; the host itself when no label is known."""
    host = host_of(url)
    label = F.lit(None).cast("string")
    for suffix, name in suffix_labels.items():
        label = F.coalesce(label, F.when(host.endswith(suffix), name))
    for exact, name in labels.items():
        label = F.when(host == exact, name).otherwise(label)
    return F.coalesce(label, host)


def full_size_of_thumbnail(url: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(url), r"(?i)\.jpg\.240p\.jpg(?=$|[?#])", ".jpg")


def without_size_suffix(url: Column | str) -> Column:
    """``name-320x180.gif`` becomes ``name.gif``."""
    return F.regexp_replace(text_or_empty(url), r"(?i)-\d{2,5}x\d{2,5}(?=\.gif(?:$|[?#]))", "")


def without_resize_query(url: Column | str) -> Column:
    """Resizing keys dropped from the query of an animation URL."""

    def strip(text: Column) -> Column:
        query = F.regexp_extract(text, r"\?([^#]*)", 1)
        kept = F.filter(F.split(query, "&"), lambda kv: ~F.lower(F.substring_index(kv, "=", 1)).isin(RESIZE_KEYS))
        joined = F.array_join(kept, "&")
        rebuilt = F.concat(
            identity(text), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), F.regexp_extract(text, r"(#.*)$", 1)
        )
        return F.when(identity(text).rlike(r"(?i)\.gif$") & (query != "") & (joined != query), rebuilt).otherwise(text)

    return let(text_or_empty(url), strip)


def srcset(value: Column | str) -> Column:
    """``array<struct<url, score>>``: widths as written, densities times 1000, best first."""

    def entry(part: Column) -> Column:
        bits = F.split(F.btrim(part), r"\s+")
        descriptor = F.lower(F.coalesce(F.get(bits, F.lit(1)), F.lit("")))
        amount = F.regexp_extract(descriptor, r"^([0-9]*\.?[0-9]+)[wx]$", 1).try_cast("double")
        score = F.when(descriptor.endswith("x"), amount * 1000).otherwise(amount)
        return F.struct(F.get(bits, F.lit(0)).alias("url"), F.coalesce(score, F.lit(0.0)).alias("score"))

    entries = F.transform(F.split(text_or_empty(value), ","), entry)
    ranked = F.transform(
        F.filter(entries, lambda e: e["url"] != ""),
        lambda e, i: F.struct((-e["score"]).alias("s"), i.alias("i"), e.alias("e")),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["e"])


def has_hint(text: Column, hints: list[str] = MEDIA_SKIP_HINTS) -> Column:
    pattern = "|".join(hint.replace("-", r"\-") for hint in hints)
    return F.lower(text).rlike(pattern)
