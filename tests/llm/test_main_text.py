"""Extraction on given, generated and broken pages; messages against enumeration."""

import itertools
import random
import time

import numpy as np
import pytest

from pagewright.llm import main_text as M


@pytest.fixture(scope="module")
def model():
    rng = random.Random(M.SEED)
    labelled = [M.generated_page(rng) for _ in range(M.GENERATED_PAGES)]
    return M.train([p for p, _ in labelled], [l for _, l in labelled])


def test_marginals_equal_enumeration():
    page = M.parse("<div><p>a</p><ul><li>b</li></ul></div><p>c</p>")
    forest = M.Forest([page], {})
    rng = np.random.default_rng(0)
    scores, pairs = rng.normal(size=forest.n), rng.normal(size=(3, 2, 2))
    own, both = M.marginals(forest, scores, pairs)
    weights, states = [], list(itertools.product([0, 1], repeat=forest.n))
    for state in states:
        value = sum(s * x for s, x in zip(scores, state))
        value += sum(pairs[forest.kind[i], state[forest.parent[i]], state[i]] for i in range(forest.n) if forest.parent[i] >= 0)
        weights.append(np.exp(value))
    weights = np.array(weights) / sum(weights)
    assert np.allclose(own, [sum(w for w, s in zip(weights, states) if s[i]) for i in range(forest.n)])
    for i in range(1, forest.n):
        want = sum(w for w, s in zip(weights, states) if s[forest.parent[i]] and not s[i])
        assert both[i, 1, 0] == pytest.approx(want)


def test_held_out_accuracy_on_generated_pages(model):
    rng = random.Random(99)
    pages = [M.generated_page(rng) for _ in range(200)]
    forest = M.Forest([p for p, _ in pages], model.vocabulary)
    own, _ = M.marginals(forest, forest.scores(model.weights), model.pairs)
    truth = np.array([x for _, labels in pages for x in labels])
    assert ((own > 0.5) == truth).mean() > 0.98


def test_parts_of_a_page(model):
    html = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice">We use cookies</div>
    <header><a href="/">Logo</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
    <div class="sidebar"><h3>Related</h3><ul><li><a href="/c">More of this</a></ul></div>
    <article><h1>A &amp; B</h1><p>First   <b>bold</b>er
    paragraph&#8212;with an <a href="/x">inner link</a> and enough words to count as text.<br>Next line.<p>Second paragraph, also of some length.
    <ul><li>one item</li><li>two items</li></ul><script>var x = "<p>no</p>"</script></article>
    <section id="comments"><div class="comment">I have something to say about all of this, at length.</div></section>
    <footer>&copy; us</footer></body></html>"""
    want = "A & B\nFirst bolder paragraph—with an inner link and enough words to count as text. Next line.\nSecond paragraph, also of some length.\none item\ntwo items"
    assert M.extracted(model, [M.parse(html)]) == [want]


def test_odd_pages(model):
    odd = [None, "", " ", "<", "<!DOCTYPE", "<p", "<div>" * 3000 + "deep", "</p></div>", "<![bad[x]]>", "<nav>only</nav>", "&amp;" * 1000, "<p>" + "w " * 100_000]
    assert len(M.extracted(model, [M.parse(x) for x in odd])) == len(odd)
    assert M.extracted(model, [M.parse(x) for x in odd[:3]]) == ["", "", ""]


def test_query_form(spark, model):
    rows = [(1, "u", "<article><h1>T</h1><p>Some words in a row that make a text.</p></article>", "clash"), (1, None, None, None), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = M.main_text(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 0), (1, 39)]
    assert M.main_text(pages.limit(0)).count() == 0
    fitted = M.main_text(pages).collect()
    assert any(r.text == "T\nSome words in a row that make a text." for r in fitted)


def test_landmark_labels():
    page = M.parse("<body><nav>x</nav><article><p>y</p><div class='ad'>z</div></article></body>")
    assert [t for t, l in zip(page.tag, M.landmark_labels(page)) if l] == ["article", "p"]
    assert M.landmark_labels(M.parse("<p>none</p>")) is None


WORDS = "Enough words in a row to make a paragraph of some length here."
CUT = {
    "unknown section": (f"<p>before <![foo[ x ]]> after</p><p>{WORDS}</p>", f"before  after {WORDS}"),
    "section without a name": (f"<p>a</p><![[x]]><p>{WORDS}</p>", f"a {WORDS}"),
    "head without end": (f"<html><head><title>x</title><body><p>{WORDS}</p>", WORDS),
    "head ended by a block": (f"<head><meta charset=utf-8><title>x</title><p>{WORDS}</p>", WORDS),
    "head ended by text": (f"<head><title>x</title>{WORDS} <b>More</b>", f"{WORDS} More"),
    "head with noscript": (f"<head><noscript><p>Enable it</p></noscript><title>x</title><body><p>{WORDS}</p>", WORDS),
    "closed head": (f"<head><title>x</title></head><body><p>{WORDS}</p>", WORDS),
    "self-closed svg": (f"<div><svg/><p>{WORDS}</p></div>", WORDS),
    "parts of svg": (f"<div><svg><title/><g><path/></g><text>no</text></svg><p>{WORDS}</p></div>", WORDS),
    "unclosed button": (f"<div><button>Label<p>{WORDS}</p></div><p>end</p>", f"{WORDS} end"),
    "unclosed object": (f"<div><object data=x>{WORDS}<p>on</p></div><p>end</p>", f"{WORDS} on end"),
    "unclosed noscript": (f"<div><noscript><img src=x><p>{WORDS}</p></div><p>end</p>", f"{WORDS} end"),
    "unclosed select": (f"<div><select><option>a<option>b<p>{WORDS}</p></div>", WORDS),
    "closed ones": (f"<div><button><div>no</div></button><object><p>no</p></object><noscript><p>no</p></noscript><p>{WORDS}</p></div>", WORDS),
    "closed in unclosed": (f"<div><object><p>{WORDS}</p><noscript><p>no</p></noscript><button>no</button></div>", WORDS),
}


@pytest.mark.parametrize("name", sorted(CUT))
def test_nothing_after_odd_markup_is_lost(name):
    html, want = CUT[name]
    page = M.parse(html)
    assert " ".join(" ".join(x for _, _, x in page.texts).split()) == " ".join(want.split())
    assert sum(page.chars) == sum(len(x.strip()) for _, _, x in page.texts)


@pytest.mark.parametrize(
    "html",
    ["<b>" * 30_000 + "</x>" * 30_000 + WORDS, "<b>" * 30_000 + "<p></p>" * 30_000 + WORDS, "<div>" * 30_000 + "<li></li>" * 30_000 + WORDS, "<i>" * 30_000 + "<q/>" * 30_000 + WORDS],
    ids=["end tags", "paragraphs", "items", "self-closed"],
)
def test_time_does_not_grow_with_the_square_of_a_page(html):
    started = time.time()
    assert [x for _, _, x in M.parse(html).texts] == [WORDS]
    assert time.time() - started < 10


def test_texts_of_pages_that_were_cut(model):
    head = f"<html><head><title>x</title><body><article><h1>Title</h1><p>{WORDS}</p><![foo[ y ]]><svg/><p>{WORDS}</p></article></body></html>"
    assert M.extracted(model, [M.parse(head)]) == [f"Title\n{WORDS}\n{WORDS}"]
