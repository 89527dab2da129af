import time

import pytest
from stacksift.llm import pagetext

LONG = "This is a sentence of the article that is long enough to count as text of its own, with some words more."

CASES = [
    ("", ""),
    ("just text", "just text"),
    (f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>", f"Title\n{LONG}\nShort."),
    (f"<div class='sidebar'>{LONG}</div><div>{LONG} &eacute;&#x41;&amp;amp;</div>", f"{LONG} éA&amp;"),
    (f"<main><p>a  \n b&nbsp;c<br>d</p><script>var a='</p>'</script><form><p>{LONG}</p></form></main>", "a b c d"),
    (f"<article><p>One</p><div class='ad'>{LONG}</div><p>Two</p><section id='comments'><p>{LONG}</p></section></article>", "One\nTwo"),
    (f"<header>{LONG}</header><article><header><h1>T</h1></header><p>x &lt;b&gt;</p></article>", "T\nx <b>"),
    (f"<p>{LONG}</p><aside>{LONG}</aside><p>end</p>", f"{LONG}\nend"),
    (f"<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><div><p>{LONG}</p></div>", LONG),
    (f"<p title='a > b'>{LONG}</p><!-- <p>no</p> --><p hidden>{LONG}</p>", LONG),
    ("<p>never closed <b>bold <!-- open", "never closed bold"),
    ("<article><p>a</p></article><style>p{}</style", "a"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert pagetext.main_text(html) == text


def test_regions_between_surge_and_dive():
    weights = [0, 5, 0, 0, 0, 0, 0, 80, 10, 0, 60, 0, 0, 0, 0, 0, 0, 0, 9]
    import numpy as np

    assert pagetext.regions(np.array(weights)) == [(7, 11)]
    assert pagetext.regions(np.array([0, 3, 0])) == [(1, 2)]
    assert pagetext.regions(np.zeros(4)) == []


def test_hostile_pages_are_linear():
    began = time.time()
    for html in ("<p>" * 200000, "<!--" * 200000, '<a href="x' * 100000, "<div>" * 100000 + "</p>" * 100000, "<" * 500000, "<script>" * 50000):
        pagetext.main_text(html)
    assert time.time() - began < 30


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>x</p>", "t"), (2, None, "<p>x</p>", "t"), (None, "", "", None)],
                                  "page_id long, url string, html string, text string")
    rows = sorted((r.page_id or 0, r.text) for r in pagetext.extract(pages).collect())
    assert rows == [(0, ""), (1, ""), (2, "x"), (2, "x")]
    assert pagetext.extract(pages.limit(0)).collect() == []


ROWS = "".join(f"<tr><td>{i}<td>x" for i in range(80))
TERMS = "".join(f"<dt>{i}<dd>x" for i in range(80))

LATER = [
    (f"<nav><table>{ROWS}</table></nav><p>{LONG}</p>", LONG),
    (f"<nav><table>{ROWS}</nav><p>{LONG}</p>", LONG),
    (f"<aside><dl>{TERMS}</dl></aside><p>{LONG}</p>", LONG),
    ("<div class=sidebar>" + "<div>" * 70 + "x" + f"</nav>{'</div>' * 71}<p>{LONG}</p>", LONG),
    (f"<ul><li>a<ul><li>{LONG}</li></ul><li><p>b<li>c</ul>", f"a\n{LONG}\nb\nc"),
    (f"<div class='content with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div id='page' class='no-sidebar hasHeader'><p>{LONG}</p></div>", LONG),
    (f"<div class=header><main><p>{LONG}</p><div class=ad>x</div></main></div>", LONG),
    (f"<form><div class=widget><article><p>{LONG}</p><p class=ad>x</p></article></div></form>", LONG),
    (f"<article><p>One</p></article><section id=comments><article><p>{LONG}</p></article></section>", "One"),
    (f"<p>{'İ' * 40}</p><script>x</script><p>{LONG}</p>", f"{'İ' * 40}\n{LONG}"),
    (f"<p>{'İ' * 40}</p><SCRIPT>var a = '</scr' + 'ipt'</SCRIPT><p>{LONG}</p>", f"{'İ' * 40}\n{LONG}"),
]


@pytest.mark.parametrize("html,text", LATER)
def test_later_text_is_kept(html, text):
    assert pagetext.main_text(html) == text


def test_deep_pages_are_linear():
    began = time.time()
    for html in ("<li>" * 200000, "<tr><td>" * 100000, "<div>" * 200000 + "</div>" * 200000, "<table><tr><td>" * 50000, "<div><li>" * 100000 + "</ul>" * 100000, "<article>" * 100000 + "</x>" * 100000):
        pagetext.main_text(html)
    assert time.time() - began < 30


LINKED = [
    (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><ul><li><a href=y>x</a></li></ul><p>end</p><p><a href=z>last</a></p></article>", f"Title\n{LONG}\nx\nend\nlast"),
    (f"<article><p><a href=x>open<p>{LONG}</p></article>", f"open\n{LONG}"),
    (f"<div><a name=top><p>{LONG}</p></div>", LONG),
    (f"<a href=x>open<p>{LONG}</p>", LONG),
    (f"<p>{LONG}</p><ul><li><a href=y>x</a></li></ul><p>{LONG}</p>", f"{LONG}\nx\n{LONG}"),
    (f"<p>{LONG}</p><ul><li><a href=y>x</a></li></ul><p>end</p>", f"{LONG}\nx\nend"),
    (f"<h1><a href=x>Title</a></h1><p>{LONG}</p>", f"Title\n{LONG}"),
    (f"<div><a href=x><div>{LONG}</div><p>{LONG}</p></a></div><p>{LONG} Own.</p>", f"{LONG} Own."),
    (f"<article><h2><a href=x>Teaser</a></h2></article><p>{LONG}</p>", LONG),
    ("<article><a href=x>only a link</a></article>", "only a link"),
]


@pytest.mark.parametrize("html,text", LINKED)
def test_link_text_inside_the_region_is_kept(html, text):
    assert pagetext.main_text(html) == text


def test_links_are_linear():
    began = time.time()
    for html in ("<a href=x>" * 100000, "<a href=x>x</a>" * 100000, "<p><a href=x>" * 100000, "<a " * 200000):
        pagetext.main_text(html)
    assert time.time() - began < 30


CONTRACT = [
    (f"<article><h2 id='share-of-market'>Share</h2><p>{LONG}</p></article>", f"Share\n{LONG}"),
    (f"<article><h2 id='search'>Search</h2><p>{LONG}</p></article>", f"Search\n{LONG}"),
    (f"<article><p>{LONG}</p><p class='related'>A related thought.</p><ul><li class=share>shared</li></ul></article>", f"{LONG}\nA related thought.\nshared"),
    (f"<article><p>{LONG}</p></article><article id='comment-1'><p>{LONG} Comment.</p></article>", LONG),
    (f"<article><p>{LONG}</p><article class='comment byuser'><p>no</p></article><article class='post-comment'><p>no</p></article></article>", LONG),
    (f"<main><p>{LONG}</p><section class='post-comments'><article><p>{LONG}</p></article></section></main>", LONG),
    (f"<div><p>{LONG}</p></div><section id=comments><article><p>{LONG} Comment.</p></article></section>", LONG),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data=a><p>Fallback</p></object></article>", "Let x=2 be.\nFallback"),
    (f"<article><p>{LONG}</p><div class='share-of-market'>kept</div><div class='share-buttons'>no</div><div id='site-sidebar-2'>no</div></article>", f"{LONG}\nkept"),
    (f"<article><p>teaser</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div><p>{LONG} Other.</p></div>", LONG),
    (f"<article><p>{LONG}</p><p class='ad'>Buy</p><div class='ads'>Buy</div></article>", LONG),
]


@pytest.mark.parametrize("html,text", CONTRACT)
def test_names_and_comments(html, text):
    assert pagetext.main_text(html) == text


def test_every_text_comes_through_regions(monkeypatch):
    seen = []
    real = pagetext.regions
    monkeypatch.setattr(pagetext, "regions", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    lines = pagetext.settled(pagetext.page_lines(f"<nav>x</nav><article><h1>T</h1><p>{LONG}</p><hr><hr><hr><hr><hr><hr><hr><p>end</p></article><p>after</p>"))
    runs = pagetext.main_runs(lines)
    assert seen and runs == seen[-1] and len(runs) == 1
    (a, b), = runs
    assert lines[a].text == "T" and lines[b - 1].text == "end"


def test_regions_like_brute_force():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        weights = rng.integers(0, 60, n) * (rng.random(n) < 0.3)
        runs, start = [], None
        full = [i for i in range(n) if weights[i]]
        for i in full:  # a new run after more than WINDOW + GAP - 1 lines without text
            if start is None:
                start, end = i, i
            elif i - end > pagetext.WINDOW + pagetext.GAP:
                runs.append((start, end + 1))
                start, end = i, i
            else:
                end = i
        runs += [(start, end + 1)] if full else []
        strength = [max(sum(weights[i : i + pagetext.WINDOW]) for i in range(a, b)) for a, b in runs]
        want = [r for r, s in zip(runs, strength) if s >= pagetext.SURGE]
        if runs and not want:
            want = [runs[strength.index(max(strength))]]
        assert pagetext.regions(weights) == want
