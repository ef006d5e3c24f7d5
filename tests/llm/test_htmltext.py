"""Page texts: hand-made pages in layouts that no labelled page has, marked pages, odd html."""

import itertools
import re
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm.htmltext import extracted, fit, labelled, leaf_blocks, main_text, page_texts, train, viterbi

SF = "/root/testdata/sf0.01"

NEWS = """<html><head><title>X</title><style>p{}</style></head><body><div class="cookie-wall"><p>This website uses cookies to improve your stay here.</p></div>
<header id="top"><a href="/">Site</a> The daily news of town</header><div id="main-nav"><a href=a>Home</a><a href=b>About</a></div>
<div class="article-text"><h1>Big news today</h1><p>Something happened in the town centre this morning,
and many people saw it.</p><!-- <p>no</p> --><p>The mayor said: &quot;no comment&quot;.</p><div class="advertisement-box">Buy two get one free today only.</div>
<p>Later more people came &amp; went&nbsp;home.</p><ul><li>First point of the day</li><li>Second point of the day</li></ul></div>
<div id="user-comments"><h3>2 Comments</h3><div class="comment"><p>I was there too and I saw all of it happen with my own eyes.</p></div></div>
<div class="right-sidebar"><h4>Latest</h4><p>Another story about the weather in the north this week.</p></div>
<form><label>Email</label><input><button>Go</button></form><script>document.write("<p>x</p>")</script><footer>Copyright 2024 The Site. All rights reserved.</footer></body></html>"""
NEWS_TEXT = [
    "Big news today", "Something happened in the town centre this morning, and many people saw it.", 'The mayor said: "no comment".',
    "Later more people came & went home.", "First point of the day", "Second point of the day",
]
TALK = """<body><nav><a href=1>One</a></nav><main><h1>Title here</h1><p>Paragraph one is long enough to be read as a text.<br>And a second line of it.</p>
<aside><p>See also our other pages about this topic here.</p></aside><p>Paragraph two ends.</p>
<section class="comments"><article><p>Great text, thank you very much for writing this one.</p></article></section></main><footer><p>Foot words here.</p></footer>"""
TALK_TEXT = ["Title here", "Paragraph one is long enough to be read as a text. And a second line of it.", "Paragraph two ends."]


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("html, lines", [(NEWS, NEWS_TEXT), (TALK, TALK_TEXT), ("", []), ("plain text without any markup, but it is a text too.", ["plain text without any markup, but it is a text too."])])
def test_hand_made_pages(model, html, lines):
    assert main_text(html, *model).split("\n") == (lines or [""])


def test_marked_pages_are_read_exactly(spark):
    """Brute force: what stands between the article tags of each page."""
    rows = {r["page_id"]: r for r in page_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, html in pages:
        inside = re.search("(?s)<article>(.*?)</article>", html)[1].replace("<br>", " ")
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", inside)]
        text = "\n".join(x for x in lines if x)
        assert (rows[page_id]["text"], rows[page_id]["n_chars"]) == (text, len(text))


def test_held_out_layouts(spark):
    """Share of blocks marked right on dressed pages that were left out of training."""
    htmls = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    weights, step = train(labelled(htmls[:150]))
    right = total = 0
    from fleetspark.llm.htmltext import dressed, page_features

    for i, html in enumerate(htmls[150:]):
        texts = [t for t, e, _ in leaf_blocks(html) if e.mark == "article"]
        page, labels = dressed({"content": texts[1:], "title": texts[:1], "menu": ["Home", "News"]}, 100_000 + i)
        blocks = leaf_blocks(page)
        assert len(blocks) == len(labels)
        marks = viterbi([sum(weights[f] for f in row) for row in page_features(blocks)], step.tolist())
        right, total = right + sum(a == b for a, b in zip(marks, labels)), total + len(labels)
    assert right / total > 0.98


def test_viterbi_by_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        scores, step = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist()
        value = lambda ys: sum(s for s, y in zip(scores, ys) if y) + sum(step[a][b] for a, b in zip(ys, ys[1:]))
        assert viterbi(scores, step) == list(max(itertools.product((0, 1), repeat=n), key=value))


def test_gradient_ascent_finds_the_marks():
    pages = [([[0, 1], [0, 2], [0, 2], [0, 1]], [0, 1, 1, 0]), ([[0, 2], [0, 1]], [1, 0])] * 5
    weights, step = train(pages)
    assert all(viterbi([sum(weights[f] for f in row) for row in rows], step.tolist()) == labels for rows, labels in pages)


def test_blocks_of_broken_markup():
    text = lambda html: [t for t, _, _ in leaf_blocks(html)]
    assert text("<p>a <b>b<p>c</b> d</i></p>e") == ["a b", "c d", "e"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert text("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert text("1 < 2 &lt; 3<p title='>'>x</p><p title=\"unclosed>y</p>z") == ["1 < 2 < 3", "x", "y", "z"]
    assert text("<SCRIPT>a</SCRIPT >b<style>c") == ["b"]
    assert text("<head><title>t</title><meta><body>x <svg><p>y</p></svg>z") == ["x z"]
    assert text("&#233;&eacute;&amp;amp;&nbsp;&#x41; &unknown;") == ["éé&amp; A &unknown;"]
    assert len(text("<div>" * 50_000 + "x")) == 1 and text("<" * 50_000 + "a") and text("<a b=\"" * 20_000) is not None


def test_tables(spark, model):
    schema = "page_id long, url string, html string"
    line = "A sentence that is long enough to be a text of its own here."
    long = "<article>" + f"<p>{line}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", TALK), (3, "u", TALK), (3, "u", TALK), (4, "u", long), (5, "u", " \n ")]
    pages = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("text", "n_chars", "code")})
    got = extracted(pages, model).collect()
    talk = "\n".join(TALK_TEXT)
    want = [(1, "u", 0), (2, None, 0), (None, "u", len(talk)), (3, "u", len(talk)), (3, "u", len(talk)), (4, "u", 20_000 * (len(line) + 1) - 1), (5, "u", 0)]
    assert sorted(((r["page_id"], r["url"], r["n_chars"]) for r in got), key=str) == sorted(want, key=str)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == by_id[2] == by_id[5] == "" and by_id[3] == by_id[None] == talk and by_id[4].count("\n") == 19_999
    assert len(page_texts(pages).collect()) == len(rows) and page_texts(pages.limit(0)).collect() == []
