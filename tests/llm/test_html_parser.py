"""The parser on odd and hostile markup, and templates inside articles."""

import time

import pytest

from runlens.llm import html_text

CASES = {
    '<body><div class="layout has-sidebar"><p>Hello main text</p></div>': "Hello main text",
    '<div class="content no-comments">all</div>': "all",
    "<p class=it's>one</p>": "one",
    "<p>AT&am<b>p;T</b>": "AT&amp;T",
    "<p>a &<!--x-->amp; b &amp; c&nbsp;&copy;": "a &amp; b & c \u00a9",
    '<h1>Top <b>line</b></h1><div class="ad">Buy</div><article><p>x<div class="share-price">5</div><p class="login">y</article>': "Top line\nx\n5\ny",
    "<h1>Site</h1><article><h1>Own</h1><p>x</article><article><p>second</article>": "Own\nx\nsecond",
    "<div class=sidebar>all of the text</div>": "all of the text",
    '<div class="ad">Buy</div><p>text text text': "text text text",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "a < b <c": "a < b <c",
    '<a title="x>y" href=\'>\'>k</a>': "k",
    "<p>a<br/>b<p/>c": "a b\nc",
    "<i>x<div>y</i>z</div>": "x\nyz",
    "<script>if (a < b) '</p>'</script ><p>x</p><style>p{}</style>": "x",
    '<article><p>x</p><section id="comments"><p>nice!</section><form>f</form><aside>s</aside><div hidden>h</div></article>': "x",
}


@pytest.mark.parametrize("page", CASES)
def test_odd_markup(page):
    assert html_text.main_text(page) == CASES[page]


@pytest.mark.parametrize("page", ["<b>" * 60000 + "</div>" * 60000, '<a "' * 100000, '<a ="x>' * 80000, "<" * 500000, "<!" * 200000, "<script>" * 60000, "<ul><li>" + "<div>" * 50000 + "<li>x" * 30000, "<i><div>" * 30000 + "</i>" * 30000, "<article>" * 50000, "x " * 500000])
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    html_text.signatures(page)
    assert time.process_time() - began < 20


def test_templates_inside_articles_change_their_pages(spark):
    rows = [(k, "http://h.example/p", f"<body><article><h1>Head {k}</h1><p>Text {k} stands here</p><div class=box><span>Read more on this site</span></div><p>End of {k}</p></article></body>") for k in range(12)]
    rows += [(100 + k, "http://copies.example/p", "<body><article><p>One and the same</p><div>part of it</div></article></body>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast in (1000, 0):
        got = {r.page_id: r.text for r in html_text.extract(pages, broadcast=broadcast).collect()}
        assert all(got[k] == f"Head {k}\nText {k} stands here\nEnd of {k}" for k in range(12))
        assert all(got[100 + k] == "One and the same\npart of it" for k in range(9))
    assert sum(html_text.main_text(h) != got[k] for k, _, h in rows) == 12


def test_a_removed_inline_element_leaves_its_block_whole():
    for gone in ("<script>x()</script>", "<button>Buy</button>", "<iframe src=a></iframe>", "<svg><text>s</text></svg>", "<span hidden>h</span>", '<span class="ad">a</span>'):
        assert html_text.main_text(f"<article><p>Hello {gone}world</p><p>next</p></article>") == "Hello world\nnext"
    assert html_text.main_text("<article><p>Hello<nav>menu</nav>world</p></article>") == "Hello\nworld"


def test_no_main_text_stays_out_at_any_depth():
    for depth in (10, html_text.DEEPEST - 1, html_text.DEEPEST, html_text.DEEPEST + 50):
        for a, b in (("<nav>", "</nav>"), ("<form><div>", "</div></form>"), ('<div class="advert">', "</div>"), ("<nav><nav>", "</nav>inner</nav>"), ('<div class="ad"><aside>', "</aside></div>"), ('<div class="ad"><div>', "</div>inner</div>")):
            page = "<article>" + "<div>" * depth + f"one{a}menu<p>more</p>{b}<p>two</p>" + "</div>" * depth + "</article>"
            assert html_text.main_text(page).split() == ["one", "two"], (depth, a)
    html_text.main_text("<nav>" * 100_000 + "<li>" * 100_000 + "x" + "</nav>" * 100_000)
