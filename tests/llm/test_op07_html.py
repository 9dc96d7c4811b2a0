import html
import re

import pytest

from tassel.llm import op7_html as op
from tassel.llm.common import documents

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All news</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and this is a notice that you have to read, as it is the law of the land.</p></div>
%s
<aside><p>This is a text that stands in the sidebar and it is of no use to the reader of the page.</p></aside>
<form action="/x"><p>Type your mail and we will send you all of the news that we have for you.</p><input name="q"></form>
<section id="comments"><p>I think that this is the best of all the things that I have read on this site.</p></section>
<footer>&copy; example &middot; all rights reserved</footer></body></html>"""
BODY = """<h1>The head &amp; line</h1><p>It was the best of times, and it was the worst of times for all of them.</p>
<p>Short.</p><!-- <p>not this</p> --><p class=x>With <a href="#">a link</a> and <b>bold</b>&nbsp;&lt;tag&gt; in it that is of use.<br>Next
line</p><ul><li>Point one</li><li>Point two</li></ul><pre>a   b</pre><p hidden>It is not to be seen by any of you in the end.</p>"""
TEXT = """The head & line
It was the best of times, and it was the worst of times for all of them.
Short.
With a link and bold <tag> in it that is of use. Next line
Point one
Point two
a b"""


@pytest.mark.parametrize("holder", ["<article>%s</article>", "<main>%s</main>", '<main><article class="post">%s</article></main>', '<div class="content">%s</div>'])
def test_only_the_article(holder):
    assert op.main_text(PAGE % (holder % BODY)) == TEXT


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!-- open", "<script>x", "&", "</p></div>", "<p></p>" * 50])
def test_nothing_to_extract(page):
    assert op.main_text(page) in ("", "&", "<")


def test_cut_off_and_broken_markup():
    assert op.main_text("<article><p>One<p>Two <b>three<div>Four</article") == "One\nTwo three\nFour"
    assert op.main_text("<article><p>It ends he<a hre") == "It ends he"
    assert op.main_text('<article><p title="a > b">Quoted</p></article>') == "Quoted"
    assert op.main_text("just a text without any markup in it") == "just a text without any markup in it"
    assert op.main_text("日本語<p>二つ") == "日本語\n二つ"


def test_article_without_stop_words_is_whole():
    body = "".join(f"<p>{'xyz ' * n}</p>" for n in (1, 40, 300))
    assert op.main_text(PAGE % f"<article>{body}</article>") == "\n".join("xyz " * (n - 1) + "xyz" for n in (1, 40, 300))


LINE = "This is the text of the page and it is of use to all of the readers that we have."


@pytest.mark.parametrize(
    "tag",
    [
        'div style="overflow:hidden"', 'div data-x="hidden"', 'div title="not hidden"', 'div style="backface-visibility:hidden"',
        'div class="content has-sidebar"', 'div class="no-sidebar"', 'div class="overflow-hidden"', 'div data-class="sidebar"',
        'article class="post category-ads"', 'main class="widget"', 'div id="comments-open"', 'div class="page-widget-text"',
    ],
)
def test_loose_marks(tag):
    name = tag.split()[0]
    assert op.main_text(f"<{tag}><p>{LINE}</p></{name}>") == LINE
    assert op.main_text(f"<{tag}><article><p>{LINE}</p></article></{name}>") == LINE
    assert op.main_text(f"<p>Short</p><{tag}><article><p>{LINE}</p><p>End</p></article></{name}>") == f"{LINE}\nEnd"


@pytest.mark.parametrize("tag", ["div hidden", "div style='display: none'", 'article hidden=""', 'div class="sidebar"', 'section id="comments"', 'div aria-hidden="true"'])
def test_marked_beside_the_text(tag):
    marked = f"<{tag}><p>It is {LINE}</p></{tag.split()[0]}>"
    for page in (f"<div><p>{LINE}</p></div>{marked}", f"<article><p>{LINE}</p>{marked}</article>", f"{marked}<article><p>{LINE}</p></article>"):
        assert op.main_text(page) == LINE


def test_wrapper_of_the_longest_article():
    teaser = '<section class="related"><article><p>It is one of the other texts that we have.</p></article></section>'
    thread = f'<ol class="comment-list"><li class="comment"><article class="comment-body"><p>{LINE * 5}</p></article></li></ol>'
    assert op.main_text(f'<div class="sidebar-left"><article><p>{LINE}</p></article>{teaser}{thread}</div>') == LINE


def test_text_beside_short_articles():
    cards = "<article><h3>Other</h3><p>It is one of the other texts that we have.</p></article>" * 2
    assert op.main_text(f"<div><p>{LINE}</p><p>{LINE * 3}</p></div>{cards}").startswith(f"{LINE}\n{LINE * 3}")


def test_long_block_is_not_cut():
    long = "the word and " * 50_000
    assert op.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_neighbours_decide():
    text = "This is a text of some length and it is of use to all of the readers that we have."
    found = op.blocks(f"<div><a href=x>{'link ' * 9}</a></div><div>a</div><p>{text}</p><div>b</div>")
    for b in found:
        b.label = op.first_pass(b)
    assert [b.label for b in found] == [False, None, True, None]
    op.second_pass(found)
    assert [b.label for b in found] == [False, True, True, True]


def test_pages_of_the_tables(spark):
    pages = documents(spark, "/root/testdata/sf0.01", "pages")
    rows = {r.page_id: r for r in op.extract(pages, ["page_id", "url"]).collect()}
    source = {r.page_id: r.html for r in pages.collect()}
    assert rows.keys() == source.keys()
    for i, r in rows.items():
        body = re.split(r"</article>", source[i].split("<article>")[1])[0]
        parts = (html.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", p)) for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(" ".join(p.split()) for p in parts if p.split())
        assert r.n_chars == len(r.text)


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "y"), (2, "u", "<p>a", "z"), (2, "u", "<p>a", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in op.extract(pages, ["page_id", "url"]).collect()), key=str)
    assert out == sorted([(1, "u", "", 0), (None, None, "", 0), (2, "u", "a", 1), (2, "u", "a", 1)], key=str)
    assert op.extract(pages.filter("page_id > 9"), ["page_id"]).count() == 0
