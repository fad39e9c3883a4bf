"""Main text of pages: markup, host repeats against a brute force over all windows, and edge cases."""

import html as entities
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import html, pages
from tallyforge.llm.common import read

DATA = "/root/testdata/sf0.001"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def text(page):
    return pages.main_text(page)[0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>A &amp; B</h1><p><b>One\n two<br><p>three&nbsp;&eacute; &#233;</article><footer>x</footer>", "A & B\nOne two\nthree é é"),
        ("<nav>menu</nav><main><p>body</p><aside>side</aside><form><label>name</label></form></main>", "body"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>tags</footer></article>", "Title\nx"),
        ("<article><p>x <i>y</i>z</p><div class='ad'>buy</div><div class=\"cookie-notice\">ok?</div><section id=comments><article class=comment><p>first!</p></article></section></article>", "x yz"),
        ("<div class='wrapper has-sidebar'><div class='sidebar-left'>links</div><div class='content sidebar-right'><article><p>in</p></article></div></div>", "in"),
        ("<form action='/'><div><article><p>in a form</p></article></div></form>", "in a form"),
        ("<nav><ul><li>never ended<article><p>kept</p></article>", "kept"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><noscript>no</noscript>", "yes"),
        ("<article><p>1 < 2 and a<b>c</b></p><pre>x  <span class='comment'># note</span></pre><h2 id='related-work'>Related work</h2><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "1 < 2 and ac\nx # note\nRelated work\na\nb\nc\nd"),
        ("<p title=\"a > b\">quoted</p><p title='x>unended", "quoted\nunended"),
        ("plain text &lt;b&gt; only", "plain text <b> only"),
        ("<p>a</p><p hidden>b</p><p style='display: none'>c</p><p>x &copy y &#xD800; &bogus;</p>", "a\nx © y � &bogus;"),
        ("<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>About us</a></li></ul><p>The <a href=4>only</a> text</p>", "The only text"),
        ("<div class=top-line>Today</div><div class='post-content'><p>one two three</p><div class=ad>x</div><p>four</p></div><div>Elsewhere</div>", "one two three\nfour"),
        ("<div id=content>short</div><p>much longer than what is called the content here</p>", "short\nmuch longer than what is called the content here"),
        ("<div class=footer><div class=content>all rights</div></div><p>kept</p>", "kept"),
        ("<div class=content><article><p>in</p></article><p>out</p></div>", "in"),
        ("<form id=aspnet><p>all in a form</p></form>", "all in a form"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_long_and_broken_pages_take_linear_time():
    for page in ("<a href=\"x " * 200_000, "<" * 500_000, "<div>" * 20_000 + "x", "</p>" * 200_000, "<a ='>" * 100_000, "<!--" * 200_000, "&amp" * 100_000, "<p>w " * 100_000):
        html.blocks(page)


def brute_starts(streams):
    """streams: page -> tokens. Windows that another page holds too, by comparing all tokens."""
    at = defaultdict(set)
    for p, s in streams.items():
        for i in range(len(s) - pages.LENGTH + 1):
            at[tuple(s[i : i + pages.LENGTH])].add(p)
    return {p: {i for i in range(len(s) - pages.LENGTH + 1) if len(at[tuple(s[i : i + pages.LENGTH])]) > 1} for p, s in streams.items()}


def soup(k, head, foot):
    return f"<div id=top>{head}</div><div class=x><p>{words(k, 30)}</p><p>{words(900, 25)}</p><p>{words(k + 500, 12)}</p></div><div>{foot} edition {k} {words(k + 70, 1)}</div>"


def test_repeats_of_a_host(spark):
    head, foot = words(1000, 15), words(1001, 20)
    rows = [(k, f"http://A.example/{k}", soup(k, head, foot)) for k in range(6)]
    rows += [(k, f"http://user@b.example:80/{k}", soup(k, words(k + 2000, 15), words(k + 3000, 20))) for k in (10, 11)]  # no template
    rows += [(5, "http://a.example/copy", soup(5, head, foot)), (20, None, soup(0, head, foot)), (None, "no host", None), (21, "http://c.example/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.page_id, r.url): r for r in pages.extract(df).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        # unique runs and all prose between; head and foot, with the word behind it, are the host's
        assert got[k, f"http://A.example/{k}"].text == f"{words(k, 30)}\n{words(900, 25)}\n{words(k + 500, 12)}\n{k} {words(k + 70, 1)}"
    assert got[5, "http://a.example/copy"].text == got[5, "http://A.example/5"].text
    for k in (10, 11):
        assert words(k + 2000, 15) in got[k, f"http://user@b.example:80/{k}"].text and words(900, 25) in got[k, f"http://user@b.example:80/{k}"].text
    assert got[20, None].text.startswith(head) and got[20, None].n_repeated == 0
    assert got[None, "no host"].text == "" and got[21, "http://c.example/"].n_chars == 0
    streams = defaultdict(dict)
    for p, u, h in rows:
        if u and "://" in u:
            streams[re.sub(".*@|:80", "", u.split("/")[2]).lower()][h] = pages.stream(html.blocks(h))[0]
    want = {(host, h): s for host, of in streams.items() for h, s in brute_starts(of).items() if s}
    keys = {(r.p1, r.p2): (r.host, r.html) for r in pages.keyed(df).collect()}
    assert {keys[r.p1, r.p2]: set(r.starts) for r in pages.repeats(pages.keyed(df)).collect()} == want


def test_article_prose_stays_whoever_repeats_it(spark):
    shared = words(7, 40)
    rows = [(k, f"http://a.example/{k}", f"<article class=post><p>{shared}</p><div class=x-box>{words(8, 12)}</div><div>{words(9, 12)}</div><p>{words(k + 10, 30)}</p></article>") for k in range(3)]
    rows += [(9, "http://a.example/9", f"<div><p>{shared}</p></div>")]  # nothing of its own: its prose stays
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"{shared}\n{words(9, 12)}\n{words(k + 10, 30)}" for k in range(3)} | {9: shared}


def test_whole_table(spark):
    df = read(spark, DATA, "pages")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for r in df.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    assert pages.extract(df.limit(0)).count() == 0
