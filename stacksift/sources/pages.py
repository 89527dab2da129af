"""Extraction from HTML tables.

One Python helper turns a page into a flat list of nodes in document order; everything
else is Spark expressions over that list. A node covers the positions ``pos`` to
``last``, so "inside" is a range test.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, compact_lines, compact_text, strip_text
from ..functions.urls import (
    ANIMATION_EXT,
    IMAGE_EXT,
    THUMBNAIL_EXT,
    absolute,
    full_size_of_thumbnail,
    has_hint,
    identity,
    last_segment,
    srcset,
    to_https,
    without_resize_query,
    without_size_suffix,
)
from ..operators.dedupe import first_per_key, top_per_key
from ..session import cut_lineage

# --- Fixed values -----------------------------------------------------------
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TITLE_CLASS, BODY_CLASSES, PAGER_CLASS = "entry-title", ["entry-content", "post-content"], "page-numbers"
SPOILER_CLASS = "su-spoiler-title"
TAGS_MARKER = "genres/tags:"
TAGS_END = r"(?i)\b(?:Company|Companies|Languages|Original Size|Repack Size):"
SIZE_FIELD = r"(?i)Repack Size:\s*(?:from\s*)?([\d.,]+\s*(?:KB|MB|GB|TB))"
DESCRIPTION_HEADING, FEATURES_HEADING, PACKAGE_HEADING = "game description", "game features", "repack features"
IMAGE_ATTRS = ["data-lazy-src", "data-src", "src"]
ANIMATION_ATTRS = ["data-original", "data-full", "data-orig-file", "data-large-file", *IMAGE_ATTRS]
ANIMATION_ATTR_HINT = r"(?i)(?:src|href|url|file|orig|full|large|gif)"
LINK_TIER, LINK_ATTR_TIER, DATA_TIER, ANY_ATTR_TIER = 100000.0, 94000.0, 92000.0, 88000.0
PICTURE_TIER, PICTURE_ATTR_TIER, SRCSET_TIER = 80000.0, 79000.0, 76000.0
PROMOTED_TIER, STRIPPED_TIER, STRIPPED_RAW_TIER, RAW_TIER = 70000.0, 69000.0, 68000.0, 60000.0
MEDIA_CAP, PROBES = 8, 6
#: Bytes of html whose nodes are held in Python at once; one larger page is a batch of its own.
PARSED_BYTES = 1 << 18
# -----------------------------------------------------------------------------

NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        # Of an image: the closest enclosing link and picture. Of a short element: its text.
        T.StructField("link", T.IntegerType()),
        T.StructField("picture", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)
#: Elements that may be headings, and the letters from which on they are none.
HEADING_TAGS = ("h2", "h3", "h4", "strong", "div", "span")
HEADING_CHARS = 100


class _Nodes(HTMLParser):
    """Collects elements and texts; script and style contents are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.links: list[int] = []
        self.pictures: list[int] = []
        # Open heading elements with their texts so far; the outer ones are full first.
        self.labels: list[tuple[int, list[str]]] = []
        self.full = 0

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        pos = len(self.rows)
        parent = self.open[-1] if self.open else -1
        link = self.links[-1] if tag == "img" and self.links else None
        picture = self.pictures[-1] if tag == "img" and self.pictures else None
        self.rows.append({
            "pos": pos, "last": pos, "parent": parent, "tag": tag, "attrs": attrs, "text": text, "link": link, "picture": picture, "label": None,
        })
        return pos

    def _opened(self, pos: int) -> None:
        row = self.rows[pos]
        self.open.append(pos)
        if row["tag"] == "a" and "href" in row["attrs"]:
            self.links.append(pos)
        elif row["tag"] == "picture":
            self.pictures.append(pos)
        elif row["tag"] in HEADING_TAGS:
            self.labels.append((pos, []))

    def _label(self, text: str) -> None:
        """Add a text to the open heading elements that are not full."""
        for place in range(len(self.labels) - 1, self.full - 1, -1):
            parts = self.labels[place][1]
            parts.append(text)
            if sum(map(len, parts)) + len(parts) > HEADING_CHARS:
                self.full = max(self.full, place + 1)

    def _close(self, depth: int) -> None:
        for pos in reversed(self.open[depth:]):
            self.rows[pos]["last"] = len(self.rows) - 1
            for stack in (self.links, self.pictures):
                if stack and stack[-1] == pos:
                    stack.pop()
            if self.labels and self.labels[-1][0] == pos:
                parts = self.labels.pop()[1]
                if self.full <= len(self.labels):
                    self.rows[pos]["label"] = " ".join(parts)
                self.full = min(self.full, len(self.labels))
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        ends = SELF_CLOSING.get(tag)
        if ends and self.open and self.rows[self.open[-1]]["tag"] in ends:
            self._close(len(self.open) - 1)
        pos = self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID_TAGS:
            self._opened(pos)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        inside = self.rows[self.open[-1]]["tag"] if self.open else ""
        if inside not in ("script", "style") and data.strip():
            self._add("#text", {}, data)
            self._label(data.strip())

    def finish(self) -> list[dict]:
        self.close()
        self._close(0)
        return self.rows


def _nodes(html: str | None) -> list[dict]:
    parser = _Nodes()
    parser.feed(html or "")
    return parser.finish()


def _arrow_nodes(html: str | None) -> list[dict]:
    return [{**row, "attrs": list(row["attrs"].items())} for row in _nodes(html)]


def _parsed_batches(batches, html: str, kept: list[str], name: str):
    """Arrow batches of pages as batches of ``kept`` columns and nodes, ``PARSED_BYTES`` of html each."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(NODE))
    for batch in batches:
        texts, *rest = (batch.column(batch.schema.get_field_index(c)) for c in (html, *kept))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for end, size in enumerate(sizes, 1):
            held += size
            if held >= PARSED_BYTES or end == len(sizes):
                part = slice(start, end)
                parsed = pa.array([_arrow_nodes(t) for t in texts[part].to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(c[part] for c in rest), parsed], names=[*kept, name])
                start, held = end, 0


def with_nodes(pages: DataFrame, html: str = "html", name: str = "nodes") -> DataFrame:
    """``pages`` with a page's nodes in document order in place of its ``html``.

    A node list is many times larger than its page, so lists leave Python in small batches;
    an Arrow batch of pages is never held as nodes at once.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(NODE))])
    names = [f.name for f in kept]
    return pages.mapInArrow(lambda batches: _parsed_batches(batches, html, names, name), schema)


# --- node expressions -------------------------------------------------------------


def inside(nodes: Column, node: Column) -> Column:
    """Descendants of a node. Positions equal array places, so this is a slice."""
    length = F.coalesce(node["last"] - node["pos"], F.lit(0))
    return F.slice(nodes, F.coalesce(node["pos"], F.lit(0)) + 2 - nodes[0]["pos"], length)


def elements(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def has_class(node: Column, *names: str) -> Column:
    classes = F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"\s+")
    return F.arrays_overlap(classes, F.array(*[F.lit(n) for n in names]))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def texts(nodes: Column, separator: str = " ") -> Column:
    """Stripped texts of nodes, joined."""
    found = F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: strip_text(n["text"]))
    return F.array_join(F.filter(found, lambda t: t != ""), separator)


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def next_element(nodes: Column, node: Column) -> Column:
    """Next sibling element."""
    return first(
        F.filter(
            nodes,
            lambda n: (n["pos"] > node["last"]) & (n["parent"] == node["parent"]) & (n["tag"] != "#text"),
        )
    )


# --- listing pages ----------------------------------------------------------------


def listing_records(pages: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """Records of listing pages with the page number and their position on it."""
    parsed = with_nodes(pages.select(page, html), html)
    articles = parsed.select(page, "nodes", F.posexplode(elements(F.col("nodes"), "article")).alias("position", "a"))
    # From here ``nodes`` are those of one article, the article itself first.
    own = F.concat(F.array("a"), inside(F.col("nodes"), F.col("a")))
    articles = articles.select(page, "position", own.alias("nodes"))
    nodes = F.col("nodes")
    heading = first(F.filter(elements(nodes, "h1", "h2"), lambda n: has_class(n, TITLE_CLASS)))
    body = F.coalesce(first(F.filter(nodes, lambda n: has_class(n, *BODY_CLASSES))), first(nodes))
    articles = articles.withColumn("link", first(elements(inside(nodes, heading), "a"))).withColumn(
        "content", inside(nodes, body)
    )
    content = F.col("content")
    picture = first(elements(content, "img"))
    sources = [attr(picture, name) for name in IMAGE_ATTRS]
    cover = F.coalesce(*[F.when((s != "") & ~s.startswith("data:"), F.replace(s, F.lit("http://"), F.lit("https://"))) for s in sources], F.lit(""))
    size = F.regexp_extract(texts(content), SIZE_FIELD, 1)
    source = to_https(attr(F.col("link"), "href"))
    records = articles.select(
        page,
        "position",
        last_segment(source).alias("id"),
        texts(inside(nodes, F.col("link"))).alias("title"),
        source.alias("source_url"),
        cover.alias("image_url"),
        attr(first(elements(nodes, "time")), "datetime").alias("post_date"),
        _listed_tags(content).alias("genres"),
        F.when(size == "", "N/A").otherwise(F.replace(size, F.lit(","), F.lit("."))).alias("size_text"),
    )
    return records.filter((F.col("source_url") != "") & (F.col("title") != ""))


def _listed_tags(content: Column) -> Column:
    """The tag field of a post body: from its marker to the next line break."""
    # Every text is paired with its paragraph's end and the next break after it.
    breaks = F.transform(elements(content, "br"), lambda n: n["pos"])
    paragraphs = elements(content, "p")
    marker = first(
        F.filter(
            F.filter(content, lambda n: n["tag"] == "#text"),
            lambda n: F.lower(n["text"]).contains(TAGS_MARKER)
            & F.exists(paragraphs, lambda p: (p["pos"] < n["pos"]) & (n["pos"] <= p["last"])),
        )
    )
    paragraph_end = F.array_max(
        F.transform(F.filter(paragraphs, lambda p: p["pos"] < marker["pos"]), lambda p: p["last"])
    )
    next_break = F.array_min(F.filter(breaks, lambda b: b > marker["pos"]))
    end = F.least(paragraph_end, F.coalesce(next_break - 1, paragraph_end))
    rest = F.filter(content, lambda n: (n["pos"] > marker["pos"]) & (n["pos"] <= end))
    tail = F.substring(
        marker["text"], F.locate(TAGS_MARKER, F.lower(marker["text"])) + len(TAGS_MARKER), F.length(marker["text"])
    )
    line = F.get(F.split(F.concat_ws(" ", tail, texts(rest)), TAGS_END, 2), F.lit(0))
    items = F.filter(F.transform(F.split(line, ","), strip_text), lambda t: t != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def page_count(pages: DataFrame, html: str = "html") -> DataFrame:
    """Highest page number of the pager, 1 without one; one row per page."""
    parsed = with_nodes(pages.withColumn("_html", F.col(html)), "_html")
    links = F.filter(elements(F.col("nodes"), "a"), lambda n: has_class(n, PAGER_CLASS))
    numbers = F.transform(links, lambda n: F.nullif(F.regexp_extract(texts(inside(F.col("nodes"), n)), r"^(\d+)$", 1), F.lit("")).cast("int"))
    return parsed.withColumn("pages", F.coalesce(F.array_max(numbers), F.lit(1))).drop("nodes")


def page_plan(total_pages: Column, wanted: int, full_scan: bool) -> Column:
    """Page numbers to scan, newest first."""
    last = total_pages if full_scan else F.least(total_pages, F.lit(max(1, wanted)))
    return F.sequence(F.lit(1), last)


# --- detail pages -----------------------------------------------------------------


def _body(nodes: Column) -> Column:
    return first(F.filter(elements(nodes, "div"), lambda n: has_class(n, BODY_CLASSES[0])))


def _heading(content: Column, words: str) -> Column:
    def named(node: Column) -> Column:
        return F.coalesce(F.lower(node["label"]).contains(words) & (F.length(node["label"]) < HEADING_CHARS), F.lit(False))

    return first(F.filter(elements(content, *HEADING_TAGS), named))


def _following_text(content: Column, node: Column) -> Column:
    return texts(inside(content, next_element(content, node)), "\n")


def detail_text(pages: DataFrame, key: str = "id", html: str = "html") -> DataFrame:
    """Description and feature lists of detail pages: ``key, details``."""
    parsed = with_nodes(pages.select(key, html), html)
    parsed = parsed.select(key, inside(F.col("nodes"), _body(F.col("nodes"))).alias("content"))
    content = F.col("content")
    spoiler = first(
        F.filter(
            content,
            lambda n: has_class(n, SPOILER_CLASS)
            & F.lower(texts(inside(content, n))).contains(DESCRIPTION_HEADING),
        )
    )
    found = parsed.select(
        key,
        "content",
        spoiler.alias("spoiler"),
        _heading(content, DESCRIPTION_HEADING).alias("heading"),
        _heading(content, PACKAGE_HEADING).alias("package"),
    )
    body = _following_text(content, F.col("spoiler"))
    parts = F.split(F.when(F.col("spoiler").isNotNull(), body), r"(?i)\bGame Features\b", 2)
    fallback = F.when(F.col("heading").isNotNull(), _following_text(content, F.col("heading")))
    package = F.when(F.col("package").isNotNull(), _following_text(content, F.col("package")))
    headings = [FEATURES_HEADING, PACKAGE_HEADING]
    description = compact_text(F.get(parts, F.lit(0)))
    details = F.struct(
        F.when(description == "", compact_text(fallback)).otherwise(description).alias("description"),
        compact_lines(F.get(parts, F.lit(1)), headings).alias("features"),
        compact_lines(package, headings).alias("package_features"),
    )
    return found.select(key, details.alias("details"))


# --- detail page media -------------------------------------------------------------


def page_images(pages: DataFrame, key: str = "id", html: str = "html", base: str = "source_url", cover: str = "cover_url") -> DataFrame:
    """Images of a post body, one row each, with link, rendered source and picture sources."""
    parsed = with_nodes(pages.select(key, F.col(base).alias("base"), identity(cover).alias("cover"), F.col(html).alias("_html")), "_html")
    parsed = parsed.select(key, "base", "cover", inside(F.col("nodes"), _body(F.col("nodes"))).alias("nodes"))
    nodes = F.col("nodes")

    def at(pos: Column) -> Column:
        """The node of a position, if it is in the body."""
        place = pos - nodes[0]["pos"]
        return F.when(place >= 0, F.get(nodes, place))

    def described(img: Column) -> Column:
        sources = elements(inside(nodes, at(img["picture"])), "source")
        return F.struct(
            img["pos"].alias("pos"),
            img["attrs"].alias("attrs"),
            at(img["link"])["attrs"].alias("link_attrs"),
            F.transform(sources, lambda s: s["attrs"]).alias("sources"),
        )

    rows = parsed.select(key, "base", "cover", F.explode(F.transform(elements(nodes, "img"), described)).alias("i"))
    rows = rows.select(
        key, "base", "cover", F.col("i.pos").alias("pos"), F.col("i.attrs").alias("attrs"),
        F.col("i.sources").alias("sources"), F.col("i.link_attrs").alias("link_attrs"),
    )
    base_url = F.col("base")
    shown = [F.nullif(absolute(base_url, F.col("attrs")[name]), F.lit("")) for name in IMAGE_ATTRS]
    rows = rows.withColumn("preview", F.coalesce(*shown, F.lit(""))).withColumn(
        "linked", absolute(base_url, F.col("link_attrs")["href"])
    )
    around = F.concat_ws(" ", "preview", "linked", F.col("attrs")["alt"], F.col("attrs")["class"])
    return rows.filter(~has_hint(around))


def _scored(urls: Column, score: float) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(score).alias("score")))


def _hinted_urls(base: Column, attrs: Column) -> Column:
    """Urls in every attribute whose name hints at a file."""
    entries = F.filter(F.map_entries(attrs), lambda e: e["key"].rlike(ANIMATION_ATTR_HINT))
    parts = F.flatten(F.transform(entries, lambda e: F.split(e["value"], ",")))
    tokens = F.transform(parts, lambda p: F.get(F.split(F.btrim(p), r"\s+"), F.lit(0)))
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: absolute(base, t))


def _srcset_urls(base: Column, attrs: Column, tier: float) -> Column:
    both = F.concat(srcset(attrs["data-srcset"]), srcset(attrs["srcset"]))
    return F.transform(both, lambda e: F.struct(absolute(base, e["url"]).alias("url"), (e["score"] + tier).alias("score")))


def animation_candidates(images: DataFrame, key: str = "id") -> DataFrame:
    """Animation urls of every image with their preference: ``key, pos, url, tier``.

    A url found in several places keeps its best tier.
    """
    base, attrs, link = F.col("base"), F.col("attrs"), F.col("link_attrs")
    empty = F.array().cast("array<struct<url:string,score:double>>")
    data = F.array(
        *[
            F.struct(absolute(base, attrs[name]).alias("url"), F.lit(DATA_TIER - i).alias("score"))
            for i, name in enumerate(ANIMATION_ATTRS)
        ]
    )
    pictures = F.flatten(
        F.transform(
            "sources",
            lambda s: F.concat(_srcset_urls(base, s, PICTURE_TIER), _scored(_hinted_urls(base, s), PICTURE_ATTR_TIER)),
        )
    )
    promoted = without_size_suffix("preview")
    shown = F.array(
        F.struct(promoted.alias("url"), F.lit(PROMOTED_TIER).alias("score")),
        F.struct(without_resize_query(promoted).alias("url"), F.lit(STRIPPED_TIER).alias("score")),
        F.struct(without_resize_query("preview").alias("url"), F.lit(STRIPPED_RAW_TIER).alias("score")),
        F.struct(F.col("preview").alias("url"), F.lit(RAW_TIER).alias("score")),
    )
    every = F.concat(
        _scored(F.array("linked"), LINK_TIER),
        F.coalesce(_scored(_hinted_urls(base, link), LINK_ATTR_TIER), empty),
        data,
        _srcset_urls(base, attrs, SRCSET_TIER),
        F.coalesce(pictures, empty),
        _scored(_hinted_urls(base, attrs), ANY_ATTR_TIER),
        F.when(F.col("preview").rlike(ANIMATION_EXT), shown).otherwise(empty),
    )
    rows = images.select(key, "cover", "pos", "preview", F.explode(every).alias("c"))
    found = rows.filter(F.col("c.url").rlike(ANIMATION_EXT))
    return found.groupBy(key, "cover", "pos", "preview", F.col("c.url").alias("url")).agg(F.max("c.score").alias("tier"))


def best_animations(candidates: DataFrame, probes: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The best animation per image: by measured area, bytes and tier, else by tier.

    ``probes`` (``url, width, height, bytes``) is consulted for the six best candidates.
    """
    image = [key, "pos"]
    by_tier = [F.desc("tier"), F.desc("url")]
    if probes is None:
        return first_per_key(candidates, image, by_tier)
    few = top_per_key(candidates, image, by_tier, PROBES, "_place")
    measured = few.join(probes.select("url", "width", "height", "bytes"), "url", "left")
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    weight = F.when(area > 0, F.coalesce("bytes", F.lit(0))).otherwise(0)
    ranked = measured.withColumn("_area", area).withColumn("_bytes", weight)
    best = first_per_key(ranked, image, [F.desc("_area"), F.desc("_bytes"), *by_tier])
    return best.select(*candidates.columns)


def page_media(pages: DataFrame, probes: DataFrame | None = None, key: str = "id", **columns: str) -> DataFrame:
    """Media list of every detail page: one animation first, then screenshots, at most eight.

    The cover and repeats are left out. A preview is kept where it differs from the full
    size.
    """
    # Read by both kinds of media; written once, so that pages are parsed once.
    images = cut_lineage(page_images(pages, key, **columns))
    named = first_per_key(
        best_animations(animation_candidates(images, key), probes, key).filter(identity("url") != F.col("cover")),
        [key],
        [F.col("pos")],
    )
    shown = F.when(F.col("preview").rlike(ANIMATION_EXT) | F.col("preview").rlike(IMAGE_EXT), F.col("preview"))
    animations = named.select(key, F.lit(-1).alias("pos"), F.lit("gif").alias("type"), "url", shown.alias("preview"))

    thumbs = images.filter(F.col("preview").rlike(THUMBNAIL_EXT))
    linked = F.when(F.col("linked").rlike(IMAGE_EXT) & ~F.col("linked").rlike(THUMBNAIL_EXT), F.col("linked"))
    larger = F.array_sort(
        F.transform(
            F.concat(srcset(F.col("attrs")["data-srcset"]), srcset(F.col("attrs")["srcset"])),
            lambda e, i: F.struct((-e["score"]).alias("s"), i.alias("i"), absolute(F.col("base"), e["url"]).alias("u")),
        )
    )
    larger = F.get(F.filter(larger, lambda e: e["u"].rlike(IMAGE_EXT) & ~e["u"].rlike(THUMBNAIL_EXT)), F.lit(0))["u"]
    full = F.coalesce(linked, larger, full_size_of_thumbnail("preview"))
    stills = thumbs.select(key, "cover", "pos", F.lit("image").alias("type"), full.alias("url"), "preview")
    stills = stills.filter(~has_hint(F.col("url")) & (identity("url") != "") & (identity("url") != F.col("cover")))

    every = animations.unionByName(stills.drop("cover")).withColumn("_same", identity("url"))
    distinct = first_per_key(every, [key, "_same"], [F.col("pos")])
    differs = F.when(identity("preview") != identity("url"), F.col("preview"))
    item = F.struct("pos", F.struct("type", "url", differs.alias("preview_url")).alias("m"))
    lists = distinct.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    media = F.slice(F.transform("items", lambda x: x["m"]), 1, MEDIA_CAP)
    empty = F.array().cast("array<struct<type:string,url:string,preview_url:string>>")
    return pages.select(key).join(lists, key, "left").select(key, F.coalesce(media, empty).alias("media"))


def page_links(pages: DataFrame, key: str, base: str, html: str = "html") -> DataFrame:
    """Links of every page in document order: ``key, pos, href, url``."""
    nodes = with_nodes(pages.select(key, F.col(base).alias("base"), F.col(html).alias("_html")), "_html")
    links = F.transform(elements(F.col("nodes"), "a"), lambda n: n["attrs"]["href"])
    flat = nodes.select(key, "base", F.posexplode(F.filter(links, lambda h: h.isNotNull())).alias("pos", "href"))
    return flat.select(key, "pos", "href", absolute(F.col("base"), F.col("href")).alias("url"))


def page_titles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Heading and body text of every page's first article."""
    nodes = with_nodes(pages.select(key, html), html)
    article = nodes.select(key, inside(F.col("nodes"), first(elements(F.col("nodes"), "article"))).alias("nodes"))
    heading = first(elements(F.col("nodes"), "h1"))
    return article.select(
        key,
        collapse(texts(inside(F.col("nodes"), heading))).alias("title"),
        collapse(texts(F.col("nodes"))).alias("text"),
        F.size(elements(F.col("nodes"), "p")).alias("paragraphs"),
    )
