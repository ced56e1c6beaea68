"""Parsing, exact marginals, and the text of pages whose main text is known."""

import html
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import html_extract, page_model
from veritable.llm.html_tree import Tree
from veritable.llm.page_model import Forest, messages

SMALL = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, text string, k0 int"


@pytest.fixture(scope="module")
def model():
    return page_model.fit(page_model.written_pages(500))


def runs(page):
    tree = Tree(page)
    return [t for t in tree.text if t]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        (" \n ", []),
        ("plain & simple", ["plain & simple"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<p>one<p>two<b>three</b>four<br>five", ["one", "twothreefour five"]),
        ("<p><b>bold<br><p>next</p>after", ["bold", "next", "after"]),
        ("<script>var t='</p>';</script>x<style>p{}</style>y<!-- <p>no --> z", ["xy z"]),
        ("x<script>never <b>ended</b> t", ["x"]),
        ("x<!-- never <b>ended</b> t", ["x"]),
        ("x<p class='a", ["x"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("&lt;p&gt; &amp;amp; &#8364;&nbsp;&copy;", ["<p> &amp; € ©"]),
        ('<a title="x>y" href=z>link</a> and </nothing>text</p></div>', ["link and text"]),
        ('<a title="open>kept', ["kept"]),
        ("<select><option>a<option>b</select><button>ok</button>rest", ["rest"]),
        ("<div>a<x-card>b</x-card>c</div></body></html>d", ["a", "b", "c", "d"]),
        ("<DIV>A</Div><ScRipT>no</sCript >B", ["A", "B"]),
    ],
)
def test_runs_of_a_page(page, want):
    assert runs(page) == want


def test_broken_and_deep_markup_takes_linear_time():
    start = time.time()
    n = 30_000
    for page in ["<div>" * n + "x", "<p>" * n + "x", "<b>" * n + "x</i>" * n, "<a href='" * n, "</div>" * n, "<" * n, "<!--" * n, "<li><b>" * n + "y"]:
        runs(page)
    page_model.PageModel({}, np.zeros((9, 2, 2))).main_texts(["<div>" * 3000 + "x"])
    assert time.time() - start < 60


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    forest = Forest([Tree("<div><p>a<p>b<ul><li>c</ul></div><h1>d</h1>"), Tree("e"), Tree("")])
    n = len(forest.tags)
    own, edge = rng.normal(size=n), rng.normal(size=(9, 2, 2))
    got, pair = messages(forest, own, edge)
    total, single, double = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product([0, 1], repeat=n):
        weight = sum(own[i] for i in range(n) if y[i])
        weight += sum(edge[forest.group[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
        weight = np.exp(weight)
        total += weight
        single += weight * np.array(y)
        for i in range(n):
            if forest.parent[i] >= 0:
                double[i, y[forest.parent[i]], y[i]] += weight
    np.testing.assert_allclose(got, single / total, rtol=1e-9)
    np.testing.assert_allclose(pair, double / total, rtol=1e-9)


def test_held_out_pages(model):
    pages = page_model.written_pages(250, seed=77)
    forest = Forest([Tree(p) for p in pages])
    y = page_model.labels(forest)
    said = model.marginals(forest) >= 0.5
    runs_, right = forest.is_text, said == y
    assert right[runs_].mean() >= 0.97
    assert said[runs_ & (y == 1)].mean() >= 0.97 and y[runs_ & said].mean() >= 0.96


NEWS = """<html><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies on this site. Accept them all, please.</p>
<button>OK</button></div><header class="site-header"><a href="/">Home</a><h2>The Paper</h2></header>
<div class="menu"><ul><li><a href="/a">News</a></li><li><a href="/b">Sports</a></li></ul></div>
<div id="main"><div class="{name}"><h1>A title of the story</h1><p>First paragraph, with a <a href="/x">link</a> in it. It goes on and on, as such texts do.</p>
<div class="advert">Buy this thing now. It is the best thing that you can buy.</div>
<p>Second paragraph; short.</p><ul><li>One point of it.</li><li>Another point of it.</li></ul>
<p>Third paragraph. It has two sentences, and commas, too.</p></div>
<form action="/s"><label>Your name</label><input name="n"><p>Write to us about this.</p></form>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/1">Other story one</a></li><li><a href="/2">Other story two</a></li></ul></div>
<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I like this story very much. Really, I do.</p></div>
<div class="comment"><b>Bob</b><p>I don't. It has no end, and no beginning.</p></div></section></div>
<footer>&copy; 2024 The Paper. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("name", ["article-body", "entry-content", "post", "story"])
def test_a_page_of_another_kind(model, name):
    want = (
        "A title of the story First paragraph, with a link in it. It goes on and on, as such texts do. Second paragraph; short. "
        "One point of it. Another point of it. Third paragraph. It has two sentences, and commas, too."
    )
    assert model.main_texts([NEWS.format(name=name)]) == [want]


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = html_extract.extract(pages, html_extract.learn(pages)).collect()
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeats_long_pages_and_other_columns(spark, model):
    long = "<article>" + "<p>" + "A sentence of many, with a comma. " * 60_000 + "</p></article>"
    rows = [(1, "u", None, "t", 1), (2, None, "", None, 2), (2, None, "", None, 2), (None, "u", "<article><p>Some text here, long enough.</p></article>", "", 3), (4, "v", long, "", 4)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = html_extract.extract(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, r.n_chars) for r in got.collect()), key=repr)
    assert found == sorted([(1, "u", 0), (2, None, 0), (2, None, 0), (None, "u", 28), (4, "v", 34 * 60_000 - 1)], key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert html_extract.extract(empty, html_extract.learn(empty)).count() == 0
    kept = html_extract.extract(pages, model, keep=("page_id", "text", "k0"))
    assert kept.filter(F.col("k0") == 2).count() == 2
