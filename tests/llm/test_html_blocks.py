"""HTML extraction: hand-made pages of several layouts, a plain check on the given pages, awkward rows."""

import html
import re

import pytest

from pointloom.llm import html_blocks, queries
from pointloom.llm.html_blocks import main_text

DATA = "/root/testdata/sf0.001"
LONG = "It was the first time that they had seen the house on the hill, and it was not what they had been told of it by the others in the village."
SECOND = "There is no doubt that the people of the town were with us, as the letters which we have from that year are all full of their thanks to her."


def page(body, head=""):
    return f"<!doctype html><html><head><title>no &lt;p&gt;</title>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><a href=/>Home</a></nav><article><h1>A title</h1><p>{LONG}</p><p>Of.</p></article><footer>&copy; us, and all of the rest</footer>"), ["A title", LONG, "Of."]),
    "title before the article": (page(f"<header><h2>Site of the day</h2></header><h1>A title</h1><article><p>{LONG}</p></article>"), ["A title", LONG]),
    "sidebar, notice, form, comments": (
        page(
            f'<div class="cookie-notice"><p>{SECOND}</p></div><main><p>{LONG}</p><aside>{SECOND}</aside><form><p>{SECOND}</p><button>Go</button></form><p>End</p>'
            f'<section id="comments"><article class="comment"><p>{SECOND}</p></article></section></main><div class="side-bar sidebar"><p>{SECOND}</p></div>'
        ),
        [LONG, "End"],
    ),
    "article header": (page(f'<article class="post"><header class="post-header"><h1>T</h1></header><p>{LONG}</p></article>'), ["T", LONG]),
    "comments as articles beside it": (page(f'<article><p>{LONG}</p></article><div class="commentList"><article><p>{SECOND}</p></article></div>'), [LONG]),
    "no article": (page(f"<div><a href=a>Home</a> <a href=b>News</a></div><h1>A title</h1><div>{LONG}</div><div>Short.</div><div>{SECOND}</div><div><a>Imprint</a> <a>About us</a></div>"), ["A title", LONG, "Short.", SECOND]),
    "advert without an article": (page(f'<div class="ad">{SECOND}</div><p>{LONG}</p><p>Short.</p><div class="adv-box">Buy</div>'), [LONG, "Short."]),
    "links in the article": (page(f"<article><p>{LONG} <a href=x>more of it</a></p><h2>Related</h2><ul><li><a>one</a></li><li><a>two</a></li></ul></article>"), [LONG + " more of it"]),
    "scripts and comments": (page(f'<script>var a="<p>no</p>";</script><article><!-- <p>no</p> --><p>{LONG}<script>no()</script></p><style>p{{}}</style><noscript>no</noscript></article>'), [LONG]),
    "page in a form": (page(f"<form action=x><article><p>{LONG}</p></article><label>Name</label></form>"), [LONG]),
    "page in a form, no article": (page(f"<form action=x><p>{LONG}</p><p>{SECOND}</p><p>Yes.</p></form>"), [LONG, SECOND, "Yes."]),
    "layout classes": (page(f'<div class="has-sidebar"><p>{LONG}</p></div>'), [LONG]),
    "broken markup": (f"<article><h1>T<p><b>{LONG}<br>next<p>Or &amp;amp; 3 < 4 &lt;b&gt;</span></article><footer>the end of it", ["T", LONG + " next", "Or &amp; 3 < 4 <b>"]),
    "quotes in attributes": (f"<article><p title=\"a > b\" data-x='<p>' alt=it's>{LONG}</p><p>don't</p></article>", [LONG, "don't"]),
    "white space": (page(f"<article><pre> a\n\tb&nbsp;c \r\n</pre><p>d<b>e</b> f</p><table><tr><td>g<td>h</table></article><p hidden>{LONG}</p>"), ["a b c", "de f", "g", "h"]),
    "unclosed comment": (f"<article><p>{LONG}</p><!-- open <p>no</p></article>", [LONG]),
    "unclosed script": (f"<article><p>{LONG}</p><script>no <p>no</p></article>", [LONG]),
    "hidden": (page(f'<article><p style="display: none">{SECOND}</p><p hidden>{SECOND}</p><p>{LONG}</p></article>'), [LONG]),
    "two articles": (page(f"<article><p>{LONG}</p></article><p>{SECOND}</p><article><p>{SECOND}</p></article>"), [LONG, SECOND]),
    "roles": (page(f'<div role="banner">{SECOND}</div><div role="main"><p>{LONG}</p></div><div role="contentinfo">{SECOND}</div>'), [LONG]),
    "language without a list": (page("<p>" + "これは村の人々が見た家の話であり長い文章です。" * 6 + "</p><p>終わり。</p>"), ["これは村の人々が見た家の話であり長い文章です。" * 6, "終わり。"]),
    "list of names": (page(f"<p>{LONG}</p>" + "<div>Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron</div>"), [LONG]),
    "plain text": ("just a line", ["just a line"]),
    "nothing": ("<nav>a</nav>", []),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    given, want = CASES[name]
    assert main_text(given) == "\n".join(want)


def test_time_grows_with_the_page():
    import time

    for unit in ("<div>", "<a ", "<!--", '<p a="', "<li>x", "<p title=it's>a</p>", "</div>", "<script>", "&amp;", "<b><p>x"):
        began = time.perf_counter()
        main_text(unit * 60_000)
        assert time.perf_counter() - began < 10, unit


def plain(page_html):
    """The article of the given pages, by their one layout."""
    article = re.search(r"<article>(.*?)</article>", page_html, re.S)[1]
    blocks = (re.sub(r"</?b>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_given_pages(spark):
    got = queries.op11_html_extraction(spark, DATA).toPandas()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    want = {p: plain(h) for p, h in zip(pages.page_id, pages.html)}
    assert len(got) == len(pages) and dict(zip(got.page_id, got.text)) == want
    assert (got.n_chars == got.text.str.len()).all()


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, label string"
    rows = [(1, "u", CASES["article"][0], "x", 1, "y"), (1, "u", CASES["article"][0], "x", 1, "y"), (None, None, None, None, None, None), (2, "v", "", "", 0, ""), (3, "w", f"<article><p>{LONG * 3000}</p></article>", "", 0, "")]
    got = html_blocks.extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(LONG) + 12), (1, len(LONG) + 12), (2, 0), (3, len(LONG * 3000))]
    assert html_blocks.extracted(spark.createDataFrame([], schema)).count() == 0
