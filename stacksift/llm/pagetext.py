"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element. Lines inside menus, forms, scripts,
readers' comments and other parts that are never article text count no characters but keep their
place. Where a page has an article element, its ends are the surge and the dive, unless the text
next to it outweighs it by far. Containers are such parts by names made of known words alone; headings,
list items and cells never are, and paragraphs only as adverts. A part that is only named as
one of these, by class, id, role or as a form, does not count as such for the main element
inside of it, nor for an article if no other has text. Text lengths without link
text are summed over sliding windows of ``WINDOW`` lines. A region starts where the sum
surges to ``SURGE`` and reaches from there to where the windows around it fall to nothing;
the text between is kept whole. Single lines of link text between others, or headings above them,
count as such, and do not part a region. All lines of an article element are kept. Link text
is what stands in ``a`` with ``href``, to its end tag, but at most to the end of the element
around it; without end tag, to the end of its block. Where no window surges, as on pages with one short line,
the region with the largest sum is kept.

Inside a block, a run of white space is one space; blocks are joined by newlines in page
order. Character references are decoded. A null page is empty; a page without text has an
empty text; unclosed tags, quotes and comments end with the page or as the next part of the same list or
table begins. An end tag ends the innermost open element of its name. The scan is linear.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

WINDOW = 3
SURGE = 60
#: Lines without text between two regions that belong to one page part.
GAP = 2
#: So many times the text of all articles makes another part of a page its main text.
OUTWEIGHS = 10

# Elements by what they do to the text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead title tr ul caption".split()
)
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title svg annotation canvas audio video".split())
#: Elements that an opening tag ends without a tag of their own, and those beyond which it ends none.
_PARTS_OF_PAGE = frozenset("article main section nav aside header footer form fieldset blockquote table td th".split())
_LISTS = _PARTS_OF_PAGE | {"ul", "ol", "menu", "dir"}
_TERMS = _PARTS_OF_PAGE | {"dl"}
_ROWS = frozenset(("td", "th", "tr", "caption"))
_TABLE = frozenset(("table",))
_GROUPS = frozenset(("table", "tbody", "thead", "tfoot"))
IMPLIED_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), _TERMS),
    "dd": (frozenset(("dt", "dd")), _TERMS),
    "td": (frozenset(("td", "th", "caption")), _GROUPS | {"tr"}),
    "th": (frozenset(("td", "th", "caption")), _GROUPS | {"tr"}),
    "tr": (_ROWS, _GROUPS),
    "tbody": (_ROWS | _GROUPS - _TABLE, _TABLE),
    "thead": (_ROWS | _GROUPS - _TABLE, _TABLE),
    "tfoot": (_ROWS | _GROUPS - _TABLE, _TABLE),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
SKIPPED = frozenset("nav footer aside form menu dialog button select fieldset head header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class, id and role names that mark parts outside the article.
OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments"
    " commentlist consent contentinfo cookie cookies copyright disqus dropdown footer form gdpr header hidden legal login masthead"
    " menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo"
    " promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip"
    " social sponsor sponsored subscribe subscription tags toc toolbar widget widgets complementary alert disclaimer".split()
)

#: Words that may stand beside those in a name that marks such a part; any other word makes it a name of its own.
GENERIC = frozenset(
    "a above after area article aside bar before below block blog body bottom box btn button buttons center class col column component"
    " container content desktop entry fixed floating global group holder icon icons id inline inner item items js layout left link links"
    " list main mobile module narrow outer page panel post primary region right row secondary section single site small sticky sub thread"
    " title top web wide wrap wrapper zone".split()
)
COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A paragraph is left out for these names alone, and only when they are its whole class.
PAID = frozenset("ad ads adv advert advertisement advertising adbox promo promoted sponsor sponsored".split())
#: Elements whose class, id or role can name them as outside the article.
CONTAINERS = frozenset(
    "address aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol section table ul".split()
)

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE_OR_END = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Class names that say which parts stand next to an element, not what it is.
_BESIDE = re.compile(r"(?:no|not|has|have|with|without|hide|show|is-not)(?:[-_]|(?=[A-Z]))")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE | re.ASCII) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE | re.ASCII)
_HREF = re.compile(r"\bhref\s*=", re.IGNORECASE | re.ASCII)
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    kept: bool  # in no skipped part, nor in one named as outside unless that holds the main element
    article: bool
    heading: bool = False
    saved: bool = False  # kept, and the outermost article too may stand in parts named as outside


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place after the tag that starts before ``at``; quoted values may hold ``>``."""
    while True:
        found = _QUOTE_OR_END.search(html, at)
        if found is None:
            return len(html)
        mark, place = found.group(), found.start()
        if mark == ">":
            return place + 1
        # Only a quote after an equals sign opens a value; the last one of its kind closes nothing.
        if html[place - 1] not in "= \t\n\r" or place >= last[mark]:
            at = place + 1
        else:
            at = html.index(mark, place + 1) + 1


def _is_hidden(attributes: str) -> bool:
    for key, value in _NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def _names(attributes: str, keys: tuple[str, ...] = ("class", "id", "role")):
    """The words of every class, id and role that says what an element is."""
    for key, value in _NAMES.findall(attributes):
        if key.lower() in keys:
            for name in value.strip("\"'").split():
                if not _BESIDE.match(name):
                    yield [w.lower() for w in _WORDS.findall(name)]


def _marks(words: list[str], marks: frozenset[str]) -> bool:
    """Whether a name is made of ``marks`` and of words that say nothing else."""
    return any(w in marks for w in words) and all(w in marks or w in OUTSIDE or w in GENERIC or w.isdigit() for w in words)


def _is_outside(attributes: str) -> bool:
    """Whether class, id or role name a part outside the article."""
    return any(_marks(words, OUTSIDE) for words in _names(attributes))


def _is_comment(attributes: str) -> bool:
    return any(_marks(words, COMMENT) for words in _names(attributes))


def _is_paid(attributes: str) -> bool:
    return any(len(words) == 1 and words[0] in PAID for words in _names(attributes, ("class",)))


def page_lines(html: str) -> list[Line]:
    """Lines of a page, with the empty ones that stand for left-out parts."""
    lines: list[Line] = []
    pieces: list[str] = []
    linked = 0
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, skipped, named as outside, article
    places: dict[str, list[int]] = {}  # of a name's open elements in open_tags
    bases: list[tuple[int, int]] = []  # for every open article or main: parts named as outside around it
    skipped = outside = articles = 0
    links = 0  # 0: in no link; 1: in one that ends with its block; 2: in one that has an end tag
    link_depth = 0  # open elements around the link
    last = {q: html.rfind(q) for q in "\"'"}
    at, end = 0, len(html)

    def flush(heading: bool = False) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
        around_main, around = bases[-1] if bases else (0, 0)
        lines.append(Line(text, min(linked, len(text)), not skipped and outside == around_main, articles > 0, heading, not skipped and outside == around))
        pieces.clear()
        linked = 0

    def enter(name: str, out: bool, named: bool) -> None:
        nonlocal skipped, outside, articles
        mark = name in ARTICLE
        if mark:
            # What is around the main element says nothing about it, nor what is around the outermost article if no other has text.
            around_main, around = bases[-1] if bases else (0, outside)
            bases.append((outside if name == "main" else around_main, outside if name == "main" else around))
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append((name, out, named, mark))
        skipped += out
        outside += named
        articles += mark

    def leave(upto: int) -> None:
        nonlocal skipped, outside, articles, links
        if upto < link_depth:
            links = 0
        for name, was_skipped, was_named, was_article in open_tags[upto:]:
            skipped -= was_skipped
            outside -= was_named
            articles -= was_article
            places[name].pop()
            if was_article:
                bases.pop()
        del open_tags[upto:]

    def innermost(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    while at < end:
        tag = _TAG.search(html, at)
        text = html[at : tag.start() if tag else end]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if tag is None:
            break
        comment, other, closing, name = tag.groups()
        if comment:
            stop = html.find("-->", tag.end())
            at = end if stop < 0 else stop + 3
            continue
        at = _tag_end(html, tag.end(), last)
        if other:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
        if not closing and name in RAW:
            if not html[at - 2 : at] == "/>" or name in ("script", "style", "title", "textarea"):
                stop = _RAW_END[name].search(html, at)
                at = end if stop is None else _tag_end(html, stop.end(), last)
            pieces.append(" ")
            continue
        if name in BLOCKS:
            flush(closing == "/" and name in HEADINGS)
            if links == 1:
                links = 0
        if name == "a":
            links = 0
            if not closing and _HREF.search(html, tag.end(), at):
                following = _NEXT_LINK.search(html, at)
                links, link_depth = 2 if following and following.group(1) else 1, len(open_tags)
        if name in VOID:
            continue
        if closing:
            if places.get(name):
                leave(places[name][-1])
        elif name in BLOCKS or name in SKIPPED:
            if open_tags and open_tags[-1][0] == "p":
                leave(len(open_tags) - 1)
            if name in IMPLIED_ENDS:
                ended, bound = IMPLIED_ENDS[name]
                least = innermost(bound)
                for other in ended:
                    # An element of a kind is ended by the next of its kind, so few are open inside the bound.
                    while places.get(other) and places[other][-1] > least:
                        leave(places[other][-1])
            attributes = html[tag.end() : at]
            out = name in SKIPPED and name != "form" and not (name == "header" and articles)
            if name not in ("html", "body", "main"):
                # Readers' comments go wherever they stand, also as articles.
                out = out or ((name == "article" or name in CONTAINERS) and _is_comment(attributes))
                out = out or (name != "article" and _is_hidden(attributes)) or (name == "p" and _is_paid(attributes))
            enter(name, out, name == "form" or (name in CONTAINERS and _is_outside(attributes)))
        elif name in ("span", "font", "ins"):
            attributes = html[tag.end() : at]
            out, named = _is_hidden(attributes), _is_outside(attributes)
            if out or named:
                flush()
                enter(name, out, named)
    flush()
    return lines


def settled(lines: list[Line]) -> list[Line]:
    """``lines`` as they are kept in the end: where no article outside of other parts has text, one inside of them is kept."""
    if any(x.article and x.text and x.kept for x in lines):
        return lines
    return [x._replace(kept=True) if x.article and x.saved else x for x in lines]


def in_articles(lines: list[Line]) -> bool:
    """Whether articles bound the text: one has text of its own, or only links as the rest of the page has."""
    return any(x.article and x.kept and len(x.text) > x.linked for x in lines) or (
        any(x.article and x.kept and x.text for x in lines) and not any(x.kept and len(x.text) > x.linked for x in lines)
    )


def line_weights(lines: list[Line]) -> np.ndarray:
    """Characters per line that count: none in left-out parts, nor link text, nor in articles."""
    return np.array([0 if x.article or not x.kept else max(len(x.text) - x.linked, 0) for x in lines])


def article_weights(lines: list[Line]) -> np.ndarray:
    """All characters of the lines of articles."""
    return np.array([len(x.text) if x.article and x.kept else 0 for x in lines])


def linked_inside(lines: list[Line]) -> np.ndarray:
    """Lines of nothing but links that stand alone between or, as a heading, above other text."""
    kept = [i for i, x in enumerate(lines) if x.kept and x.text]
    own = [len(lines[i].text) > lines[i].linked for i in kept]
    out = np.zeros(len(lines), bool)
    for k, i in enumerate(kept):
        after = k + 1 < len(kept) and own[k + 1] and lines[kept[k + 1]].article == lines[i].article
        out[i] = not own[k] and after and ((k > 0 and own[k - 1]) or lines[i].heading)
    return out


def regions(weights: np.ndarray, window: int = WINDOW, surge: int = SURGE, gap: int = GAP, inside: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Runs of lines between surge and dive points; lines ``inside`` without weight belong to the run that they are in or next to."""
    if not len(weights) or not weights.any():
        return []
    sums = np.convolve(weights, np.ones(window, int))[window - 1 :]  # sum of a line and those after it
    full = np.flatnonzero(weights if inside is None else (np.asarray(weights) > 0) | inside)
    breaks = np.flatnonzero(np.diff(full) > window + gap)
    starts, ends = full[np.r_[0, breaks + 1]], full[np.r_[breaks, len(full) - 1]] + 1
    runs = list(zip(starts.tolist(), ends.tolist()))
    kept = [(a, b) for a, b in runs if sums[a:b].max() >= surge]
    return kept or [max(runs, key=lambda r: (sums[r[0] : r[1]].max(), -r[0]))]


def main_runs(lines: list[Line]) -> list[tuple[int, int]]:
    """Runs of lines between surge and dive points that are the main text.

    An article is a hard limit: inside of it any text is a surge and no gap a dive, so all of
    its lines belong to the run. It gives way to the rest of the page only where a run there has
    ``OUTWEIGHS`` times its text, as where articles are teasers beside it.
    """
    rest = line_weights(lines)
    own = article_weights(lines) if in_articles(lines) else None
    if own is not None and rest.sum() <= OUTWEIGHS * own.sum():
        return regions(own, surge=1, gap=len(lines))
    runs = regions(rest, inside=linked_inside(lines))
    if own is not None and max((rest[a:b].sum() for a, b in runs), default=0) <= OUTWEIGHS * own.sum():
        return regions(own, surge=1, gap=len(lines))
    return runs


def main_text(html: str) -> str:
    """The article text of a page."""
    lines = settled(page_lines(html))
    bounded = in_articles(lines)
    runs = main_runs(lines)
    article = bounded and any(x.article and x.kept and x.text for a, b in runs for x in lines[a:b])
    return "\n".join(x.text for a, b in runs for x in lines[a:b] if x.text and x.kept and (x.article or not article))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
