import html
import random
import re

import pytest

from rankloom.llm.html_text import extract_pages, line_weights, main_text
from tests.llm.conftest import prose

LONG = "A sentence of the article that is long enough to count as text by itself."
CASES = {
    "named": (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>b &amp;amp; c&nbsp;d<div class='ad-slot'>buy</div><p>tail</article><footer>f</footer>", f"T\n{LONG}\nb &amp; c d\ntail"),
    "comments": (f"<article><p>{LONG}</p><section id='comments'><p>{LONG} says a reader</p></section></article>", LONG),
    "by density": (f"<div><a href=1>One</a> <a href=2>Two</a></div><p>{LONG}</p><p>{LONG}</p><div><a href=3>More</a></div>", f"{LONG}\n{LONG}"),
    "content div": (f"<div class='sidebar'><p>{LONG}</p></div><div id='content'><p>short</p></div>", "short"),
    "script": (f'<article><script>var a="</p><article>";</script><style>p{{}}</style><p>{LONG}</p></article>', LONG),
    "forms": (f"<article><form><p>name</p></form><p>{LONG}</p><div role='alert'>note</div><div hidden>h</div></article>", LONG),
    "cookie": (f"<div class='cookieNotice'><p>{LONG}</p></div><main><p>x  y\n z</p></main>", "x y z"),
    "cut off": (f"<html><body><article><p>{LONG}</p><p>end of the pa", f"{LONG}\nend of the pa"),
    "open aside": (f"<aside>never closed<article><p>{LONG}</p></article>", LONG),
    "with-sidebar": (f"<article class='post with-sidebar'><p>{LONG}</p></article>", LONG),
    "header inside": (f"<header>site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    "less than": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "comment mark": (f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- open", LONG),
    "stray quote": (f"""<article><p title="5" tall">{LONG}</p><p title='it's'>b</p></article>""", f"{LONG}\nb"),
    "unclosed quote": (f'<article><p title="5>{LONG}</p></article>', LONG),
    "comment lists": (f'<article><p>{LONG}</p><div class="post-comments-wrapper"><p>{LONG} says one</p></div><ol class="commentlist"><li>{LONG} says two</li></ol></article>', LONG),
    "names on paragraphs": (f'<article><p class="discussion">{LONG}</p><p class="search-intro">b</p><p class="advert">buy</p></article>', f"{LONG}\nb"),
    "teaser article": (f'<div id="text"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article><h2>Teaser</h2><p>Read on</p></article>', f"{LONG}\n{LONG}\n{LONG}"),
    "two articles": (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><p>Next one</p></article>", f"{LONG}\n{LONG}"),
    "text before title": (f"<div>buy this now</div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>", f"Title\n{LONG}\n{LONG}"),
    "short lines": ("<p>a</p><p>b</p>", "a\nb"),
    "plain": ("only words", "only words"),
    "empty": ("", ""),
    "blank": ("<html><body> \n </body></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_columns_and_nulls(spark):
    rows = [(1, None, "a"), (None, "<article>x</article>", None), (2**60 + 1, "", "b")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string").selectExpr("*", "'u' as url")
    got = extract_pages(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", ""), (None, "u", "x"), (2**60 + 1, "u", "")], key=repr)
    assert extract_pages(pages.limit(0)).count() == 0


def test_very_long_and_deep_pages():
    assert len(main_text("<article>" + "<b><p>word " * 100_000)) > 400_000
    assert main_text("<" * 200_000).count("<") == 200_000


def test_weights_follow_the_share_of_the_text():
    line = lambda n, group: ("x", n, group, False)
    assert line_weights([line(100, 1), line(300, 1), line(20, 0)]) == [141, 341, 0]  # 40 * 400 / 20 lost
    assert line_weights([line(10, 1), line(400, 0)]) == [0, 400]
    assert line_weights([line(400, 0), line(0, 0)]) == [400, 0]


def written(draw: random.Random, names: bool) -> tuple[str, str]:
    """A page of random blocks and its article, one line a block."""
    tags = ["<p>", "<p class=lead>", '<p title="a > b">', "<p data-x='\"'>", "<h2>", "<blockquote><p>", "<ul><li>", "<table><tr><td>"]
    text, page = [], []
    for i in range(draw.randint(2, 12)):
        words = prose(draw.randrange(10**9), draw.randint(12, 60)).split()
        words[draw.randrange(len(words))] = draw.choice(["a & b", "<i>", "1 < 2", "caf\u00e9", "\u2014", "'s"])
        text.append(" ".join(words))
        shown = [f"<b>{html.escape(w)}</b>" if draw.random() < 0.1 else html.escape(w) for w in words]
        if draw.random() < 0.3:
            shown[0] = f"<a href='/x?a=1&b=2'>{shown[0]}</a>"
        tag = draw.choice(tags)
        page.append(tag + draw.choice([" ", "\n\t "]).join(shown) + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tag))))
        if draw.random() < 0.2:
            page.append(draw.choice(["<!-- <p>no</p> -->", "<script>var a = '<p>no</p>';</script>", "<form><label>no</label></form>", "<aside><p>no</p></aside>"]))
    menu = "<nav>" + "".join(f"<a href=/{i}>{prose(i, 2)}</a>" for i in range(8)) + "</nav>"
    links = "<ul>" + "".join(f"<li><a href=/{i}>{prose(i, 3)}</a></li>" for i in range(6)) + "</ul>"
    body = "".join(page)
    if names:
        extra = f"<div class='{draw.choice(['ad', 'comments', 'post-comments', 'cookieNotice', 'share-box'])}'><p>{prose(draw.randrange(999), 30)}</p></div>"
        tag = draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("<div class='post-body'>", "</div>"), ("<div>", "</div>")])
        body = menu + tag[0] + body + tag[1] + extra
    else:
        body = menu + "<div>" + body + "</div>" + links
    return f"<!DOCTYPE html><html><head><title>no</title></head><body>{body}<footer>no</footer></body></html>", "\n".join(text)


@pytest.mark.parametrize("names", [True, False])
def test_random_pages(names):
    draw = random.Random(4)
    for _ in range(200):
        page, want = written(draw, names)
        assert main_text(page) == want, page


def test_given_pages_need_no_names(spark, small):
    """Without the elements and names that mark the article, nearly the same text is found."""
    pages = [r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    shares = []
    for page in pages:
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"</?(article|main)\b[^>]*>", "", page))
        one, two = main_text(page).split("\n"), main_text(bare).split("\n")
        size = lambda lines: max(1, sum(map(len, lines)))
        shares.append(min(size([x for x in one if x in two]) / size(one), size([x for x in two if x in one]) / size(two)))
    assert min(shares) >= 0.95
