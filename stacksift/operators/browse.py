"""Filters, orders, facets and rails over a prepared catalog."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_query, search_fold
from ..functions.text import strip_text, text_or_empty
from .search import search

# --- Fixed values -----------------------------------------------------------
PAGE_SIZE, RAIL_SIZE = 30, 10
NEW_BADGE_DAYS, NEW_FILTER_DAYS = 14, 30
SIZE_BUCKETS = {"lt1": (0, 1024), "1-10": (1024, 10240), "10-50": (10240, 51200), "gte50": (51200, None)}
# -----------------------------------------------------------------------------

DAY = timedelta(days=1)
EPOCH = datetime(1970, 1, 1)


def when_of(text: Column | str) -> Column:
    """Timestamp of an ISO text; unreadable or missing dates read as null."""
    return F.try_to_timestamp(text_or_empty(text))


def or_epoch(when: Column) -> Column:
    """Missing dates compare as the epoch, so they come first in ascending order."""
    return F.coalesce(when, F.lit(EPOCH))


def size_in(size_mb: Column, bucket: str) -> Column:
    """Rows of a size bucket; unknown and zero sizes belong to none."""
    low, high = SIZE_BUCKETS[bucket]
    inside = (size_mb > 0) & (size_mb >= low)
    return inside & (size_mb < high) if high else inside


def released_in(when: Column, period: str, now: datetime) -> Column:
    """Release period relative to ``now``. Future dates only count for this year."""
    start = {"7d": 7, "30d": 30, "90d": 90}
    if period in start:
        return (when >= F.lit(now - start[period] * DAY)) & (when <= F.lit(now))
    if period == "this-year":
        return F.year(when) == now.year
    monday = datetime(now.year, now.month, now.day) - now.weekday() * DAY
    if period == "this-week":
        return (when >= F.lit(monday)) & (when <= F.lit(now))
    if period == "last-week":
        return (when >= F.lit(monday - 7 * DAY)) & (when < F.lit(monday))
    raise ValueError(f"unknown period {period!r}")


def is_new(when: Column, now: datetime, days: int = NEW_BADGE_DAYS) -> Column:
    return F.coalesce(when > F.lit(now - days * DAY), F.lit(False))


def has_all_tags(keys: Column, selected: list[str]) -> Column:
    wanted = F.array(*[F.lit(s) for s in selected]) if selected else F.array().cast("array<string>")
    return F.size(F.array_except(wanted, keys)) == 0


def filtered(
    rows: DataFrame,
    now: datetime,
    query: str = "",
    tags: list[str] = (),
    year: int | None = None,
    period: str | None = None,
    size: str | None = None,
    new_only: bool = False,
    described_only: bool = False,
    with_media_only: bool = False,
    library: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """All catalog filters together. ``score`` is 1 without a query."""
    if query.strip():
        rows = search(rows, "id", query, index)
    else:
        rows = rows.withColumn("score", F.lit(1.0))
    if library is not None:
        rows = rows.join(library.select("id"), "id", "left_semi")
    if year is not None:
        rows = rows.filter(F.col("release_year") == str(year))
    if period:
        rows = rows.filter(released_in(when_of("game_release_date"), period, now))
    if size:
        rows = rows.filter(size_in(F.col("size_mb"), size))
    if new_only:
        rows = rows.filter(is_new(when_of("post_date"), now, NEW_FILTER_DAYS))
    if described_only:
        rows = rows.filter(F.col("has_description"))
    if with_media_only:
        rows = rows.filter(F.col("media_count") > 0)
    if tags:
        rows = rows.filter(has_all_tags(F.col("tag_keys"), list(tags)))
    return rows


def result_order(sort: str, has_query: bool = False) -> list[Column]:
    """Sort expressions of a result list; the id makes every order total."""
    posted, released = or_epoch(when_of("post_date")), or_epoch(when_of("game_release_date"))
    name = F.collate(display_name(), "UNICODE_CI_AI")
    orders = {
        "date_desc": [posted.desc()],
        "date_asc": [posted.asc()],
        "release_desc": [released.desc(), posted.desc()],
        "release_asc": [released.asc(), posted.asc()],
        "name_asc": [name.asc()],
        "name_desc": [name.desc()],
        "relevance": [F.desc("score"), posted.desc()] if has_query else [posted.desc()],
    }
    return [*orders[sort], F.col("id")]


def display_name() -> Column:
    canonical = strip_text("canonical_title")
    return F.when(canonical != "", canonical).otherwise(strip_text("title"))


def tag_dictionary(rows: DataFrame, first: Column) -> DataFrame:
    """Every tag: folded key, first-seen label, row count. ``first`` orders the rows."""
    tags = rows.select(first.alias("_first"), F.posexplode(F.arrays_zip("tag_keys", "tag_labels")))
    return tags.groupBy(F.col("col.tag_keys").alias("key")).agg(
        F.min_by(F.col("col.tag_labels"), F.struct("_first", "pos")).alias("label"),
        F.count(F.lit(1)).alias("rows"),
    )


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tag_keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def facets(dictionary: DataFrame, pool: DataFrame, selected: list[str], tag_query: str = "") -> DataFrame:
    """Drill-down counts of every tag over ``pool``, the rows under all filters and tags.

    A selected tag shows the size of the pool. ``visible`` tags match the tag search and
    are selected or not empty.
    """
    total = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    active = F.col("key").isin(list(selected)) if selected else F.lit(False)
    counts = tag_counts(pool).withColumnRenamed("rows", "_hits")
    joined = dictionary.select("key", "label").join(counts, "key", "left").withColumn("active", active)
    hits = F.when(F.col("active"), total).otherwise(F.coalesce("_hits", F.lit(0)))
    wanted = fold_query(tag_query)
    matches = search_fold("label").contains(wanted) if wanted else F.lit(True)
    return joined.withColumn("hits", hits).withColumn("visible", matches & (F.col("active") | (F.col("hits") > 0))).drop("_hits")


def tag_order(tag_query: str = "") -> list[Column]:
    """Exact, prefix, word-prefix and other matches of a tag search, then count and label."""
    usual = [F.desc("rows"), F.collate(F.col("label"), "UNICODE_CI_AI"), F.col("key")]
    wanted = fold_query(tag_query)
    return [tag_rank(search_fold("label"), wanted), *usual] if wanted else usual


def tag_rank(label_fold: Column, wanted: str) -> Column:
    word = F.exists(F.split(label_fold, " "), lambda w: w.startswith(wanted))
    return F.when(label_fold == wanted, 0).when(label_fold.startswith(wanted), 1).when(word, 2).otherwise(3)


def rows_with_any_tag(pool: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows carrying at least one of ``keys``, each row once."""
    tagged = pool.select("id", F.explode("tag_keys").alias("key")).join(keys.select("key"), "key", "left_semi")
    return pool.join(tagged.select("id"), "id", "left_semi")


def release_years(rows: DataFrame) -> DataFrame:
    years = rows.filter(F.col("release_year") != "").select("release_year").distinct()
    return years.orderBy(F.desc("release_year"))


def newest_rail(rows: DataFrame, now: datetime, k: int = RAIL_SIZE) -> DataFrame:
    posted = when_of("post_date")
    return rows.filter(is_new(posted, now, NEW_FILTER_DAYS)).orderBy(posted.desc(), "id").limit(k)


def updated_rail(rows: DataFrame, k: int = RAIL_SIZE) -> DataFrame:
    stamped = rows.filter(text_or_empty("detail_updated_at") != "")
    return stamped.orderBy(when_of("detail_updated_at").desc_nulls_last(), "id").limit(k)


def enrichment_batch(rows: DataFrame, n: int) -> DataFrame:
    """Newest stale rows first."""
    return rows.orderBy(F.coalesce(F.col("post_date"), F.lit("")).desc(), F.col("id")).limit(max(1, n))
