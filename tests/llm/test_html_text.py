"""Main text of pages: the given pages against their article element, hand-made pages of other kinds, edge rows."""

import html
import re

import pytest

from deskpark.llm import html_text as h
from deskpark.llm.queries import queries
from llm.cases import SF_SMALL

PAGES = "page_id long, url string, html string, text string, n_chars string, label int"
LONG = ("The old mill by the river was built in the year of the great flood, and it is said that the man who owned it had to "
        "wait for three years until the water went down and the work could go on as it was planned by his father before him.")
MID = "It was not until the end of the war that they were able to come back to the farm."
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>All the news of the day and of the week</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 the owner of this site, and all of the rights that it has are his.</footer>"


def page(body):
    return f"<!doctype html><html lang=en><head><title>The title of it</title><style>p{{a:b}}</style></head><body>{body}</body></html>"


def test_query_takes_the_whole_article_of_every_page(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in queries()["op13_html_extraction"](spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|b|br)>", " ", inner)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


CASES = {
    # An article whose blocks are all short, with everything around it that is to go.
    "article": (NAV + "<header><h1>Site of the day</h1></header><article><header><h1>A b</h1></header><p>One.</p>"
                f"<div class='ad'>{LONG}</div><p>T<b>wo</b> &amp; <i>three</i>&nbsp;&eacute;&#x41;&am</p><aside>{MID}</aside>"
                f"<form><label>Mail</label><input value=x><button>Send</button></form><script>var a='<p>x</p>';</script><ul><li>four<li>five</ul>"
                f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section></article><aside>{LONG}</aside>" + FOOT,
                "A b One. Two & three éA&am four five"),
    "main": (f"{NAV}<div class=cookie-notice>{LONG}</div><main><h1>Top</h1><p>{MID}<p>Short one<div id=sidebar>{LONG}</div></main><div>{LONG}</div>{FOOT}",
             f"Top {MID} Short one"),
    "content by name": (f"<div class='site-header'>{MID}</div><div id='wrapper' class='content-sidebar-wrap'><div class='post-content'><h1>Top</h1><p>a b c</p>"
                        f"</div><div class='widget sidebar'>{LONG}</div></div><div class='commentList'>{LONG}</div>", "Top a b c"),
    # No marked article: the density rules decide, ambiguous blocks inherit.
    "density": (f"<div><a href=/>Home</a> <a href=/n>News of the day</a></div><h1>The mill</h1><p>{LONG}</p><p>So he said.</p><p>{LONG}</p><h3>More of it</h3>"
                f"<p><a href=/x>{MID}</a></p><p><a href=/y>{MID}</a></p><p>© 2020 all of it</p>", f"The mill {LONG} So he said. {LONG}"),
    "no content at all": (f"{NAV}<p><a href=/x>{MID}</a></p>{FOOT}", ""),
    "only nearly running text": (f"{NAV}<p>{MID}</p><p>{MID}</p>{FOOT}", f"{MID} {MID}"),
    "keywords are no running text": (f"<p>{LONG}</p><p>{'alpha beta gamma delta ' * 20}</p>{FOOT}", LONG),
    "language without a list": (f"<html lang=xx><article><p>{'lorem ipsum dolor ' * 30}</p></article>", " ".join(["lorem ipsum dolor"] * 30)),
    "hidden and foreign": (f"<article><p hidden>{LONG}</p><p style='Display: NONE'>{LONG}</p><svg><title>x</title><path d=z /></svg><p>Seen</p></article>", "Seen"),
    "form round the page": (f"<form><article><p>{MID}</p></article></form>", MID),
    "menu left open": (f"<nav><ul><li><a href=/>x</a><article><p>{MID}</p></article>", MID),
    "code": ("<article><pre class=code><span class=comment># add\n  it</span> x = 1</pre><table><tr><td>1<td>2</table></article>", "# add it x = 1 1 2"),
    "list of links behind the text": (f"<article><p>{LONG}</p><h2>Read more</h2><ul><li><a href=/a>{MID}</a></li><li><a href=/b>Other</a></li></ul></article>", LONG),
    "links in the text": (f"<article><p>{LONG} <a href=/q>See this one</a>.</p><h2><a href=/t>Linked head</a></h2><p>{MID}</p></article>",
                          f"{LONG} See this one. Linked head {MID}"),
    "cut off": (f"<article><p>{MID}</p><p>and so <b on", f"{MID} and so"),
    "no markup": (LONG, LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    body, want = CASES[name]
    assert h.main_text(page(body) if "<html" not in body else body) == want


def test_white_space_and_references_decode_once():
    assert h.main_text("<article><p> a&amp;lt;b \n\t c&#32;&#160;d </p>\n<p>e&lt;f&gt;</p><!-- gone --></article>") == "a&lt;b c d e<f>"


def test_long_deep_and_broken_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    assert h.main_text(deep) == LONG
    many = "<article>" + f"<p>{MID}</p>" * 20_000 + "</article>"
    assert h.main_text(many) == " ".join([MID] * 20_000)
    for text in ("<", "<<<>>>", "</p></div>", "<a <b <c", "<!-- open", "<script>x", "&#xFFFFFFF;", "<![CDATA[x", "<p " * 500, "<?x", "\x00퟿"):
        assert isinstance(h.main_text(text), str)


def test_edge_rows_and_empty_table(spark):
    rows = [(None, "u", f"<article>{MID}</article>"), (1, None, None), (2, "v", ""), (3, "v", " \n"), (4, "w", f"<p>{LONG}"), (4, "w", f"<p>{LONG}")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)
    got = sorted((tuple(r) for r in h.extract(df).collect()), key=str)
    want = [(None, "u", MID, len(MID)), (1, None, "", 0), (2, "v", "", 0), (3, "v", "", 0), (4, "w", LONG, len(LONG)), (4, "w", LONG, len(LONG))]
    assert got == sorted(want, key=str)
    assert h.extract(df.limit(0)).collect() == []
