import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import html
from loomwork.llm.queries import op10_html


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        unary = rng.normal(size=n).tolist()
        edge = [tuple(rng.normal(size=4)) for _ in range(n)]
        p, z = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u for u, s in zip(unary, y) if s) + sum(edge[i][2 * y[parent[i]] + y[i]] for i in range(1, n)))
            z += w
            p += w * np.array(y)
        got, pairs = html.marginals(parent, unary, edge)
        assert np.allclose(got, p / z)
        assert all(sum(x) == pytest.approx(1) for x in pairs[1:])


def test_held_out_pages_of_the_templates():
    model, rng = html.train(), random.Random(99)
    hit = miss = extra = 0
    for _ in range(200):
        page, kept = html.sample_page(rng)
        got, want = Counter(x for x in html.main_text(page, model).split("\n") if x), Counter(x for x in kept if x)
        hit, miss, extra = hit + (got & want).total(), miss + (want - got).total(), extra + (got - want).total()
    assert hit / (hit + miss) > 0.97 and hit / (hit + extra) > 0.97


PAGE = """<html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class=cookie-notice>We use cookies.</div>
<article><h1>A  &lt;b&gt; title</h1><p>First&nbsp;para <b>bold<br>text</b> &amp more.<p>Second one, unclosed.<div class="ad">Buy this thing now!</div><ul><li>point one<li>point two</ul></article>
<section id="comments"><p>I like this article a lot.</p></section><footer>&copy; 2020 someone</footer></body></html>"""


def test_a_page_by_hand():
    assert html.main_text(PAGE, html.train()).split("\n") == ["A <b> title", "First para bold text & more.", "Second one, unclosed.", "point one", "point two"]


@pytest.mark.parametrize("cut", range(0, len(PAGE), 7))
def test_cut_pages_are_read(cut):
    assert isinstance(html.main_text(PAGE[:cut], html.train()), str)


def test_odd_markup():
    model = html.train()
    for page in ("", "   ", "<", "<p", "</p>", "<!-- no end", "<p>a<!-- x --> b</p>" * 3, "<div " + "a='" * 2000, "<div>" * 3000 + "deep text here" + "</div>" * 10, "<" * 5000, "<a>" * 3000 + "x", "plain text only"):
        assert isinstance(html.main_text(page, model), str)


def test_query_and_edges(spark):
    got = op10_html(spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_chars > 0 for r in got) > 0.9 * len(got)
    assert not any("©" in r.text or "track(" in r.text for r in got)
    rows = [(1, None, "x"), (1, "", "x"), (2, PAGE, "x"), (2, PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = html.extract(df)
    assert out.columns == ["page_id", "text"] and sorted(len(r.text) > 0 for r in out.collect()) == [False, False, True, True]
    assert html.extract(df.where("false")).count() == 0
    named = spark.createDataFrame([(1, "up", PAGE, "u")], "page_id long, TEXT string, html string, Url string")
    assert html.extract(named).columns == ["page_id", "Url", "text"] and html.extract(named).select("text").first().text


def matrix_marginals(parent, unary, edge):
    """Sum-product by normalised vectors, children's messages multiplied in, apart from the log-odds form."""
    n = len(parent)
    kids = [[] for _ in range(n)]
    for i in range(1, n):
        kids[parent[i]].append(i)
    tie = [np.exp(np.array(e, dtype=float).reshape(2, 2)) for e in edge]
    own = [np.array([1.0, np.exp(np.clip(u, -30, 30))]) for u in unary]
    up, below = [None] * n, [None] * n
    for i in reversed(range(n)):
        below[i] = own[i].copy()
        for k in kids[i]:
            below[i] *= up[k]
            below[i] /= below[i].sum()
        up[i] = tie[i] @ below[i]
        up[i] /= up[i].sum()
    down = [np.ones(2)] * n
    out = [0.0] * n
    for i in range(n):
        full = below[i] * down[i]
        out[i] = float((full / full.sum())[1])
        for k in kids[i]:
            rest = full / up[k]
            down[k] = (rest / rest.sum()) @ tie[k]
    return out


def test_query_is_the_sum_product_of_every_page(spark):
    sf, model = "/root/testdata/sf0.001", html.train()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op10_html(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        tree = html.parse(page or "")
        p = matrix_marginals(tree.parent, *html.potentials(tree, model))
        assert got[i] == "\n".join(t for t, x in zip(tree.text, p) if t is not None and x >= 0.5)


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "</x>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<body>" * n, lambda n: "<b>" * n + "<option/>" * n, lambda n: '<b ">"' * n, lambda n: "<a><b>" * n, lambda n: "<p><b>" * n])
def test_parsing_is_linear(make):
    """About a megabyte of odd markup in a few seconds; looking through the stack for each tag would take an hour."""
    began = time.perf_counter()
    html.parse(make(110_000))
    assert time.perf_counter() - began < 20
