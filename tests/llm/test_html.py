"""Golden pages for the extraction, and its time on pages made to be slow."""

import random
import time

import pytest

from tidemark.llm.html_text import LIKELY, MARKED, REMEMBERED, SUSPECT, _remembered, best, describe, host_of, parse, text_at

PROSE = ["This is the article, with many words in it and a few more. " * 4 + "End.", "A second paragraph of the same. " * 6 + "Stop."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
WANT = "\n".join(PROSE)


def alone(source):
    return text_at(parse(source), [])


@pytest.mark.parametrize("name", ["post legal", "article-form", "product-search", "col-side main", "content-comments-open", "x", "entry-content", "siteContent"])
def test_a_word_of_a_class_does_not_lose_the_article(name):
    page = f'<html><body><nav><a href=x>Home</a></nav><div class="{name}">{BODY}</div><div class="sidebar"><p>Side</p></div><div id="comments"><p>I disagree.</p></div><footer>f</footer></body></html>'
    assert alone(page) == WANT


def test_headline_in_the_header_of_an_article():
    assert alone(f"<body><header><h1>Site</h1></header><article><header class='entry-header'><h1>Head</h1></header>{BODY}<footer>tags</footer></article></body>") == f"Head\n{WANT}"
    assert alone(f"<body><div class='header'>Site</div><div class='post'><div class='post-header'><h2>Head</h2></div>{BODY}</div></body>") == f"Head\n{WANT}"


@pytest.mark.parametrize(
    "extra",
    ["<div id=comments><p>No.</p></div>", "<div class='post-comments'><p>No.</p></div>", "<ol class=comment-list><li>No.</ol>", "<aside>No.</aside>", "<div class='cookie-banner'>No.</div>", "<div class=notice><p>No.</p></div>",
     "<div class=adsbox-wrap style='display:none'>No.</div>", "<form>Name <input></form>", "<div class='share-links'>No.</div>", "<section class='newsletter'>No.</section>", "<script>No.</script>", "<style>No.</style>", "<div role=navigation>No.</div>",
     "<p hidden>No.</p>", "<!-- No. -->", "<noscript>No.</noscript>", "<div class='related-posts'>No.</div>", "<ul class=breadcrumbs><li>No.</ul>", "<div class=legal>No.</div>"],
)
def test_what_is_not_the_article(extra):
    assert alone(f"<body><main>{BODY}{extra}</main></body>") == WANT
    assert alone(f"<body>{extra}<article>{BODY}</article>{extra}</body>") == WANT


def test_more_comments_than_article():
    comments = "".join(f"<article class=comment><p>Opinion {k}, at some length, and then some more of it.</p></article>" for k in range(80))
    assert alone(f"<body><article>{BODY}</article><section id=comments>{comments}</section></body>") == WANT


def test_broken_nesting():
    assert alone("<body><article><p>One <b>two<p>three</b> four<ul><li>five<li>six</ul></p>seven</article>") == "One two\nthree four\nfive\nsix\nseven"
    assert alone("<article><table><tr><td>a<td>b<tr><td>c</table><p>d</div></section>e") == "a\nb\nc\nde"
    assert alone("<p>a < b and 3 <4 &lt;&#x41;&eacute;&nbsp;x</p>") == "a < b and 3 <4 <Aé x"
    assert alone("text <a href='x\">y</a> z") and alone("only text") == "only text" and alone("") == ""
    assert alone("<p>one<script>var a = '<p>';</script>two<svg/>three <button>b</button>four</p>") == "onetwothree four"
    assert alone("<p>cut <a ") == "cut <a" and alone("<p>x<!-- never ends <p>y") == "x" and alone("a<!-->b<!--->c") == "abc"
    assert alone('<p title="a > b">c</p>') == "c" and alone("<P CLASS=x>up<BR/>down</P>") == "up\ndown"


def test_form_around_the_whole_page():
    assert alone(f"<body><form id=aspnetForm><div class=menu>Home</div><div id=text>{BODY}</div></form></body>") == WANT


def test_the_host_s_vote_decides():
    page = parse(f"<body><div class='product-search'>{BODY}</div><div class=post><p>A teaser that is nearly as long as what it points to, as such things are.</p></div></body>")
    path = best(page)
    assert path == "/body/div.product-search" and text_at(page, [path]) == WANT
    assert text_at(page, ["/body/div.missing", path]) == WANT
    odd = parse(f"<body><div class='a/b 12'>{BODY}</div></body>")
    assert best(odd) == "/body/div.0.a|b" and odd.find(best(odd)) == odd.path[2]


def test_blocks_are_lost_by_no_page():
    """Every visible piece of an article's random mark-up comes out once, in order."""
    rng = random.Random(4)
    for _ in range(200):
        words = iter(range(10**6))
        parts = []

        def make(depth):
            for _ in range(rng.randrange(1, 5)):
                tag = rng.choice(["p", "div", "b", "span", "ul><li", "blockquote", "h2", "section", "em", "table><tr><td"])
                parts.append(f"<{tag}>")
                parts.append(f"w{next(words)} ")
                if depth < 4:
                    make(depth + 1)
                if rng.random() < 0.7:
                    parts.append("".join(f"</{t}>" for t in reversed(tag.split("><"))))

        make(0)
        source = "<body><nav>n</nav><article>" + "".join(parts)
        found = alone(source).split()
        assert found == [f"w{k}" for k in range(len(found))] and len(found) == next(words)


@pytest.mark.parametrize("source", ["<a " * 350_000, '<a "' * 260_000, "<b>" * 100_000 + "x", "<div>" * 100_000 + "x", '<a ">" ' * 170_000 + "'", "<script" * 150_000, "<!--" * 250_000, "<" * 1_000_000, "<b>" * 1000 + "</i>" * 200_000, "<p " + 'a="' * 300_000 + ">"])
def test_time_is_linear(source):
    start = time.process_time()
    page = parse(source)
    text_at(page, [best(page)])
    assert time.process_time() - start < 6 and max(page.depth) <= 512


def test_names():
    assert describe("div", ' class="comments"')[1] == MARKED and describe("div", ' class="post-comments"')[1] == LIKELY and describe("div", ' class="share-price"')[1] == SUSPECT and describe("div", ' class="contentWrapper"')[1] == 0
    assert describe("body", ' class="menu"')[1] == 0 and describe("div", ' class="top-Header" id=x')[3]
    assert [host_of(u) for u in (None, "", "x", "http://A.b:80/c", "//u@h/p")] == ["", "", "", "a.b", "h"]


@pytest.mark.parametrize(
    "start", ['<article title="A hidden valley">', '<main aria-label="main text, class hidden">', '<div data-hidden="false"><article>', "<article data-class='ads' data-role='navigation'>", '<article title=\'role="banner" hidden\'>', "<div my-id=comments class=text>", '<article data-style="display:none">']
)
def test_values_and_other_names_hide_nothing(start):
    assert alone(f"<body><nav>n</nav>{start}{BODY}</body>") == WANT


@pytest.mark.parametrize(
    "part",
    ['<div class="legal-analysis">Kept.</div>', '<section class="share-price">Kept.</section>', '<h2 id="search-for-truth">Kept.</h2>', '<h2 id="forms">Kept.</h2>', '<p id="top-form">Kept.</p>', '<p data-role="navigation">Kept.</p>',
     '<div id="search-for-truth">Kept.</div>', '<p><span class="share-price">Kept.</span></p>', '<p><a id="related">Kept.</a></p>', '<h3 id="comments">Kept.</h3>', '<blockquote title="hidden">Kept.</blockquote>'],
)
def test_a_word_of_a_name_loses_no_part(part):
    assert alone(f"<body><article>{part}{BODY}</article><div class=ad>No.</div></body>") == f"Kept.\n{WANT}"


def test_random_attributes_lose_nothing():
    """Whatever stands in values of attributes that say nothing of an element's part, its text is kept."""
    rng = random.Random(8)
    words = "hidden class role id style ads nav display:none = navigation comments aria-hidden true banner".split()
    names = "title data-hidden data-role aria-label alt lang data-id x-class data-style itemprop".split()
    for _ in range(300):
        some = []
        for _ in range(rng.randrange(4)):
            quote, value = rng.choice("\"'"), " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
            some.append(f"{rng.choice(names)}{rng.choice(['=', ' = '])}{quote}{value}{quote}")
        source = f"<body><nav>n</nav><article><p {' '.join(some)}>One.</p><div {' '.join(some)}>Two.</div>{BODY}</article></body>"
        assert alone(source) == f"One.\nTwo.\n{WANT}", source


def test_long_attributes_are_not_remembered():
    held = _remembered.cache_info().currsize
    for k in range(50):
        describe("div", f' data-x="{k}{"y" * REMEMBERED}"')
    assert _remembered.cache_info().currsize == held and _remembered.cache_info().maxsize * REMEMBERED <= 1 << 22
