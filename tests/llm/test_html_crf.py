"""Main text by the random field: the parser, the field against all labellings, held-out pages, and odd input."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from gridweave.llm import html_crf as h

SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in h.Reader().blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain & simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<p>d", ["abc", "d"]),
        ("<p>a<br>b \n c&nbsp;d</p>", ["a b c d"]),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", ["one", "two", "in", "three"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a<!-- <p>no</p> -->b<!---->c<!-->d", ["abcd"]),
        ("x<!-- never closed <p>y", ["x"]),
        ("<script>var t='</p>';</script>a<STYLE>p{}</STYLE>b<script>open", ["ab"]),
        ("<title>t</title><p>b</p>", ["b"]),
        ("<p>1 < 2 &lt;b&gt; &amp;amp; &#233; &eacute &am", ["1 < 2 <b> &amp; é é &am"]),
        ("<p>cut <a hre", ["cut"]),
        ("<p>cut <", ["cut"]),
        ("<p>cut </", ["cut"]),
        ('<p title="a > b">x</p><p title="open>y</p>z', ["x", "y", "z"]),
        ("<div>a<div>b</div>c</div>d", ["a", "b", "c", "d"]),
        ("<p hidden>no</p><p style='display:none'>no</p><p aria-hidden='true' class='hidden x'>yes</p><input type=hidden>", ["yes"]),
        ("<form><select><option>no</select><label>name</label></form>", ["name"]),
        ("</div></p>a</b>b</div>c", ["ab", "c"]),
        ("<p>" * 50_000 + "x", ["x"]),
        ("<div>" * 20_000 + "x" + "</b>" * 20_000 + "</div>" * 20_000, ["x"]),
        ("<" * 100_000, ["<" * 99_999]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    a, b, c = h.Reader().blocks('<article class="post"><p>x <a href="#">y y</a></p><div id="commentList"><p>z</p></div><header><h1>t</h1></header></article>')
    assert (a.node.speaks, a.node.tag, a.linked, a.raw) == (("body",), "p", 3, 5)
    assert b.node.speaks == ("body", "comment") and "in:body&away" in b.node.features
    assert c.node.speaks == ("body", "head")
    assert a.parent != b.parent


def score(model, blocks, labels):
    total = model.ends[0][labels[0]] + model.ends[1][labels[-1]]
    for i, (b, p, y) in enumerate(zip(blocks, h.place_features(blocks), labels, strict=True)):
        total += y * model.emission([*b.node.features, *h.text_features(b), *p])
        if i:
            total += model.pairs[int(b.parent == blocks[i - 1].parent)][labels[i - 1]][y]
    return total


def some_pages(seed, n=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    run = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    return [h.dressed(rng, run(2, 5), [run(3, 30) + "." for _ in range(rng.randint(1, 4))], words, [run(4, 20) for _ in range(9)]) for _ in range(n)]


def test_viterbi_and_fit_against_all_labellings():
    labelled = []
    for page, said in some_pages(5):
        blocks = h.Reader().blocks(page)[:7]
        labelled.append((blocks, [y for _, y in said][: len(blocks)]))
    model = h.fit(labelled, steps=30)
    rng = np.random.default_rng(2)
    wild = h.Field({k: float(rng.normal()) for k in model.weights}, rng.normal(size=(2, 2, 2)), rng.normal(size=(2, 2)))
    for field in (model, wild):
        for blocks, _ in labelled:
            for b in blocks:
                b.node.emission = None
            found = field.labels(blocks)
            best = max(score(field, blocks, ys) for ys in itertools.product((0, 1), repeat=len(blocks)))
            assert score(field, blocks, found) == pytest.approx(best)

    def loss(m):
        out = 0.0
        for blocks, labels in labelled:
            all_scores = [score(m, blocks, ys) for ys in itertools.product((0, 1), repeat=len(blocks))]
            out -= score(m, blocks, labels) - np.logaddexp.reduce(all_scores)
        return out + sum((np.asarray(x) ** 2).sum() for x in (list(m.weights.values()), m.pairs, m.ends))

    # At the end of a long fit no weight can be moved with profit: the slope worked out by forward and backward is right.
    model = h.fit(labelled, steps=1500)
    at = loss(model)
    for key in ["near:body", "words:0", "main:in", "in:comment"]:
        for by in (-0.05, 0.05):
            if key in model.weights:
                assert loss(h.Field(model.weights | {key: model.weights[key] + by}, model.pairs, model.ends)) > at
    for by in (-0.05, 0.05):
        pairs = model.pairs.copy()
        pairs[1, 1, 1] += by
        assert loss(h.Field(model.weights, pairs, model.ends)) > at


def truth(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    found = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<[^>]*$", "", z))).split()) for z in re.split(r"</?(?:p|h1)>|<br>", inner))
    return " ".join(x for x in found if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return h.fit(h.labelled_pages(h.sample(pages)))


def test_query_equals_the_articles(spark, pages):
    source = {r["page_id"]: r for r in pages.collect()}
    found = h.op11_html_crf(spark, SF)
    assert found.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == truth(source[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == source[r["page_id"]]["url"]


def test_pages_of_other_dress(model):
    wrong = total = 0
    for page, said in some_pages(99, 300):
        found = model.labels(h.Reader().blocks(page))
        wrong += sum(x != y for x, (_, y) in zip(found, said, strict=True))
        total += len(said)
    assert wrong < 0.01 * total


def test_foreign_layouts(model):
    page = """<html><head><title>T</title></head><body><div id="top-banner" class="banner">Buy now, it is cheap and good for you.</div>
    <header><h1>Site of sites</h1><nav><a href="/">Home</a> | <a href="/a">About</a></nav></header>
    <div class="cookie-consent"><p>We use cookies to make this site better for you.</p></div>
    <main><article><h1>Rain &amp; wind</h1><p>It rained for a long time, and nobody went out.</p>
    <aside>Read more: the sun came out again.</aside><p>Then the wind came, and it was <a href="/w">very strong</a>.</p>
    <form><label>Subscribe to our newsletter</label><input></form><ul><li>First it rained.</li><li>Then it blew.</li></ul></article></main>
    <section id="comments"><h3>Comments</h3><article class="comment"><p>I was there and I saw all of it, it was great.</p></article></section>
    <div class="sidebar"><p>Most read: everything about the weather of last year.</p></div>
    <footer><p>© 2024 Site of sites. All rights reserved.</p></footer></body></html>"""
    assert model.main_text(h.Reader().blocks(page)) == "Rain & wind It rained for a long time, and nobody went out. Then the wind came, and it was very strong. First it rained. Then it blew."


def test_odd_rows(spark, model):
    long = "<article><p>" + "word " * 200_000 + "</p>" + "<p>again and again it is said.</p>" * 3000 + "</article>"
    odd = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "v", "<nav><a>menu</a></nav>", "x"), (5, "w", long, "x"), (6, None, "<p>\U0001f600 𝒳 and some more text of it.</p>", "x")]
    rows = h.extract(spark.createDataFrame(odd, "page_id long, url string, html string, text string"), model).collect()
    by = {r["page_id"]: r for r in rows}
    assert len(rows) == len(odd) and [by[k]["text"] for k in (1, 2)] == ["", ""] and by[None]["text"] == ""
    assert by[5]["text"] == " ".join(re.sub("<[^>]*>", " ", long).split()) and by[6]["n_chars"] == len(by[6]["text"]) > 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert h.extract(empty, h.fit(h.labelled_pages(h.sample(empty)))).collect() == []


def test_sample_is_bounded(spark):
    rows = [(i, f"<article><p>page {i % 50}.</p></article>") for i in range(500)] + [(900, "<article>" + "x" * h.WIDEST), (901, "<p>none</p>")]
    found = h.sample(spark.createDataFrame(rows, "page_id long, html string"), most=20)
    assert len(found) == len(set(found)) == 20 and all(len(p) < 100 for p in found)
