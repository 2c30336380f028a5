"""The page scanner and the extractor on pages that the training generator did not write."""

import re
import time
from html import unescape

import numpy as np
import pytest

from corpuscle.llm import html


@pytest.fixture(scope="module")
def model():
    return html.train()


HOSTILE = {
    "unclosed tags": "<a " * 400_000,
    "unclosed inline": "<font>x<p>" * 100_000,
    "nested blocks": "<div>x" * 150_000,
    "nested lists": "<ul><li>x" * 100_000,
    "crossed inline": "<b>" * 70_000 + "<i>" * 70_000 + "</b>x" * 70_000,
    "open quotes": '<a ="' * 200_000,
    "quotes over tags": '<a href="x>' * 90_000,
    "many names": "".join(f'<div class="n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}">t' for i in range(40_000)),
    "signs": "<" * 1_000_000,
    "comments": "<!--" * 250_000,
    "scripts": "<script>" * 120_000,
    "stray ends": "<div>" * 60_000 + "</x></p>" * 80_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_follows_length(model, name):
    start = time.process_time()
    assert isinstance(html.extract(model, HOSTILE[name]), str)
    assert time.process_time() - start < 8  # some 2 s at most on an idle machine; a scan that goes back takes hours


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<p>b<p>c", [("a", "none"), ("b", "p"), ("c", "p")]),
        ("<p><b>a<br>b<p>c", [("a b", "p"), ("c", "p")]),
        ("<p title='a>b'>x</p>", [("x", "p")]),
        ("<p title=it's>x</p>y", [("x", "p"), ("y", "none")]),
        ('<p title="open>x</p>y', [("x", "p"), ("y", "none")]),
        ("a < b &lt; c<!-- <p>no --><!--> d", [("a < b < c d", "none")]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", [("a", "li"), ("b", "li"), ("c", "li"), ("d", "li"), ("e", "none")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", [("a", "td"), ("b", "td"), ("c", "th"), ("d", "none")]),
        ("<script>a</scripty></script >b<style>c</style>", [("b", "none")]),
        ("<div><span>a</div>b</span>c", [("a", "div"), ("bc", "none")]),
        ("x<p", [("x", "none")]),
        ("<P CLASS=Q>a</P>", [("a", "p")]),
        ("<dl><dt>a<dd>b</dl>", [("a", "dt"), ("b", "dd")]),
        ("<math><mi>x</mi></math> y", [("x y", "none")]),
    ],
)
def test_blocks(page, want):
    assert [(b.text, b.tag) for b in html.leaf_blocks(page)] == want


def brute_outer(page):
    """For well-formed nested pages: (text, distinct tags and names of all open elements) by a plain stack."""
    out, stack = [], []
    for tag, text in re.findall(r"<([^>]*)>|([^<]+)", page):
        if text:
            found = set()
            for t, attrs in stack:
                found |= {f"a={t}"} if t in html._BLOCK else set()
                found |= {f"n={x}" for x in re.findall("[a-z]+", attrs)}
            out.append((text, {html._slot(x) for x in found}))
        elif tag.startswith("/"):
            stack.pop()
        else:
            t, _, rest = tag.partition(' class="')
            stack.append((t, rest))
    return out


def test_all_ancestors_count_and_weigh(model):
    rng = np.random.default_rng(8)
    weights = [int(x) for x in rng.integers(-(2**40), 2**40, 1 << html.BITS)]
    for depth in (1, 5, 60):
        tags = [str(rng.choice(["div", "section", "b", "span"])) for _ in range(depth)]
        opening = "".join(f'<{t} class="{"".join(rng.choice(list("abcdef"), 3))} {"".join(rng.choice(list("abcdef"), 2))}">t{i}' for i, t in enumerate(tags))
        page = opening + "".join(f"</{t}>u{i}" for i, t in enumerate(reversed(tags)))
        want = dict(brute_outer(page))
        plain, weighed = html.leaf_blocks(page), html.leaf_blocks(page, weights)
        assert [b.text for b in plain] == [b.text for b in weighed]
        for b, w in zip(plain, weighed):
            assert set(b.outer) == want[re.match("[tu][0-9]+", b.text).group()]
            assert w.outer == sum(weights[f] for f in b.outer)


def labelled_by_hand():
    """Pages in layouts of common publishing systems, each block marked + (article) or - by hand."""
    p = "+The council met on Tuesday to discuss the new bridge, and after two hours of debate it agreed to send the plan back."
    q = "+Nobody spoke against it. The engineers will report in spring; until then the ferry runs every hour, as it did before."
    blog = [
        '<body class="home wp-custom"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">-The Daily Ferry</a></p></div>',
        '<nav id="site-navigation" class="main-navigation"><ul class="menu"><li><a href="/1">-Home</a></li><li><a href="/2">-About</a></li><li><a href="/3">-Contact</a></li></ul></nav></header>',
        f'<div id="content" class="site-content"><main id="main"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">+The bridge plan goes back</h1></header><div class="entry-content"><p>{p}</p><p>{q}</p><h2>+What comes next</h2><ul><li>+A report in spring.</li><li>+A vote before the summer.</li></ul><p>{q}</p></div></article>',
        '<div id="comments" class="comments-area"><h2 class="comments-title">-Two thoughts</h2><ol class="comment-list"><li class="comment"><p>-I have always liked the ferry and would be sorry to see it go, whatever the council says.</p></li></ol></div></main></div>',
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>-Recent posts</h2><ul><li><a href="/a">-Harbour fees rise</a></li><li><a href="/b">-Old mill sold</a></li></ul></section></aside>',
        '<footer class="site-footer"><p>-Proudly made by a small team of readers.</p></footer></div></body>',
    ]
    news = [
        '<body><div class="cookie-consent"><p>-We and our partners store information on your device to show you fitting content.</p><button>-Accept</button></div><div class="topnav"><a href="/1">-World</a> <a href="/2">Sport</a> <a href="/3">Weather</a></div>',
        f'<div class="story"><h1>+Bridge plan sent back</h1><div class="article-body"><p>{p}</p><div class="advertisement"><p>-Save a third on every new pair of shoes this week only, in all our shops.</p></div><p>{q}</p><blockquote><p>+We will wait for the report.</p></blockquote><p>{p}</p></div></div>',
        '<div class="related"><h3>-More on this</h3><ul><li><a href="/x">-Ferry fares</a></li><li><a href="/y">-The harbour in pictures</a></li></ul></div><form class="newsletter"><label>-Your mail</label><input><button>-Send</button></form>',
        "<footer><ul><li><a href='/t'>-Terms</a></li><li><a href='/p'>-Privacy</a></li></ul><p>-© 2021 The Paper. All rights reserved.</p></footer></body>",
    ]
    plain = [f"<body><nav><a href='/'>-Start</a> <a href='/b'>Back</a></nav><article><h1>+Plan sent back</h1><p>{p}<p>{q}<p>{p}</article><footer>-Made in 2020</footer></body>"]
    return ["".join(x) for x in (blog, news, plain)]


def test_hand_labelled_layouts(model):
    hit = false = missed = 0
    for page in labelled_by_hand():
        blocks = html.leaf_blocks(re.sub(r"(?<=>) *(?=<)", "", page))
        want = [b.text[1:] if b.text[0] in "+-" else b.text for b in blocks if b.text[0] == "+"]
        got = html.extract(model, re.sub(r"(?<=>)[+-]", "", page)).split("\n\n")
        hit += len(set(got) & set(want))
        false += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert 2 * hit / (2 * hit + false + missed) > 0.9, (hit, false, missed)


def test_rows_of_the_table(spark, data, model):
    """Every row of the smallest ``pages``, against what stands between its article tags."""
    right = total = 0
    for r in html.extract_pages(spark.read.parquet(f"{data}/pages.parquet").where("html is not null"), model).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search("<article>(.*?)</article>", r.html, re.S)
        cut = re.split("</?(?:p|h1|h2)>", m.group(1).replace("<br>", " ")) if m else []
        want = [t for t in (" ".join(unescape(re.sub("<[^>]*>", "", c)).split()) for c in cut) if t]
        right, total = right + (r.text == "\n\n".join(want)), total + 1
    assert total and right >= 0.99 * total


def test_only_the_article_in_any_case(spark, model):
    rows = [(1, "u", "<article><p>" + "word and word, " * 300_000 + "</p></article>"), (2, None, None), (2, None, None)]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted((r.page_id, r.n_chars) for r in out)[:2] == [(1, 300_000 * 15 - 1), (2, 0)] and len(out) == 3
