import random
import re
from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagewright.operators import extract as X
from pagewright.operators import marks as M
from pagewright.operators.nodes import _NodeReader, with_nodes

PRODUCT = """
<html><body><nav>Home Products Support</nav>
<main><h1>Gorenje RB-492</h1><div class="price">$499</div>
<table><tr><th>Height</th><td>84.5 cm</td></tr></table></main>
<footer>Footer links</footer></body></html>
"""


class Tree:
    """Slow, direct tree version of the extraction rules."""

    def __init__(self, html):
        self.nodes = [dict(zip(("parent", "last", "kind", "tag", "attrs", "text"), n)) for n in _NodeReader().read(html)]
        for i, n in enumerate(self.nodes):
            n.update(id=i, attrs=dict(n["attrs"]), alive=True, title=None)

    def below(self, n):
        return [m for m in self.nodes[n["id"] + 1 : n["last"] + 1] if m["alive"]]

    def children(self, n):
        return [m for m in self.below(n) if m["parent"] == n["id"] and m["kind"] == "e"]

    def drop(self, n, keep_root=False):
        for m in self.nodes[n["id"] + keep_root : n["last"] + 1]:
            m["alive"] = False

    def pieces(self, n):
        own = [n["title"]] if n["title"] else []
        return own + [p for m in self.below(n) for p in ([m["title"]] if m["title"] else [m["text"].strip()] if m["kind"] == "t" else []) if p]

    def elements(self):
        return [n for n in self.nodes if n["kind"] == "e" and n["alive"]]

    @staticmethod
    def preserved(n):
        a = n["attrs"]
        return bool(
            (n["tag"] == "a" and a.get("href")) or a.get("data-ph-at-id") in M.PRESERVE_DATA_IDS or any(a.get(k) for k in M.PRESERVE_ATTRS)
        )

    def clean_text(self, base):
        for n in self.elements():
            if not n["alive"]:
                continue
            words = " ".join(n["attrs"].get(k, "") for k in ("class", "id", "role", "aria-label")).lower()
            if n["tag"] in M.NOISE_TAGS or (not self.preserved(n) and any(h in words for h in M.NOISE_HINTS)):
                self.drop(n)
        for n in self.elements():
            title = n["attrs"].get("data-ph-at-job-title-text", "").strip()
            if n["alive"] and n["tag"] == "a" and "href" in n["attrs"] and title and not self.pieces(n):
                self.drop(n, keep_root=True)
                n["title"] = title
        shapes, seen = {}, Counter()
        for n in self.elements():
            size = len(" ".join(self.pieces(n)))
            shape = (n["tag"], tuple(sorted(n["attrs"].get("class", "").split())[:3]), tuple(c["tag"] for c in self.children(n)[:4]), min(size // 20, 6))
            shapes[n["id"]] = (shape, size)
            seen[shape] += 1
        for n in self.elements():
            shape, size = shapes[n["id"]]
            if not self.preserved(n) and seen[shape] >= 4 and size < 120:
                self.drop(n)
        out, skip, previous, raw = [], -1, None, ""

        def finish():
            nonlocal raw
            if raw.strip():
                out.append(raw.strip())
            raw = ""

        for n in (m for m in self.nodes if m["alive"]):
            if n["id"] <= skip:
                continue
            if n["kind"] == "t" and previous == n["parent"]:
                raw += n["text"]
                continue
            finish()
            previous = n["parent"] if n["kind"] == "t" else None
            if n["kind"] == "t":
                raw = n["text"]
            elif n["tag"] == "a" and "href" in n["attrs"]:
                href, text = urljoin(base, n["attrs"]["href"]), self.link_text(n)
                if text and href and not href.startswith("javascript:"):
                    out.append(f"{text} ({href})")
                    skip = n["last"]
                elif n["title"]:
                    out.append(n["title"])
            elif n["title"]:
                out.append(n["title"])
        finish()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()

    def link_text(self, link):
        if link["title"]:
            return link["title"]
        text, run, previous = "", "", None
        for m in self.below(link) + [None]:
            same = m is not None and m["kind"] == "t" and previous == m["parent"]
            if not same:
                text += run.strip()
                run = ""
            if m is not None:
                run += m["text"] if m["kind"] == "t" else ""
                if m["title"]:
                    text += m["title"]
                previous = m["parent"] if m["kind"] == "t" else None
        return text


def random_page(rng):
    words = ["alpha", "beta &amp; gamma", " ", "\n", "delta " * 8, "x", "&eacute;t&eacute", "price"]
    tags = ["div", "p", "li", "span", "b", "ul", "section"]
    attrs = ["", ' class="k"', ' class="b a"', ' id="Cookie-bar"', ' class="promo"', ' itemprop="name"', ' role="navigation"', ' aria-label="related"']
    out = []
    for _ in range(rng.randint(5, 60)):
        r = rng.random()
        if r < 0.35:
            out.append(rng.choice(words))
        elif r < 0.6:
            out.append(f"<{rng.choice(tags)}{rng.choice(attrs)}>")
        elif r < 0.8:
            out.append(f"</{rng.choice(tags)}>")
        elif r < 0.9:
            out.append(
                rng.choice(
                    ['<a href="/x">go <b>on</b></a>', '<a href="javascript:1">js</a>', '<a href="../y" data-ph-at-job-title-text=" Job ">  </a>', "<a>plain</a>", '<a href="">', "</a>"]
                )
            )
        else:
            out.append(rng.choice(["<!-- c -->", "<br>", "<script>var t='</p>';</script>", "<nav>n<p>m</nav>", "<img src=a.png srcset='b.png 2x, c.png 300w'>", "<hr/>"]))
    return "".join(out)


def test_product_page(spark):
    df = spark.createDataFrame([(1, "https://example.com/product/1", PRODUCT)], "page_id int, url string, html string")
    row = X.extract_content(df).first()
    assert row.clean_text == "Gorenje RB-492\n$499\nHeight\n84.5 cm"
    assert "Footer" not in row.markdown and "# Gorenje RB-492" in row.markdown
    assert row.metrics.text_length == len(row.clean_text) and row.metrics.mode == "balanced"
    assert row.normalized_html.count("<main>") == 1 and "<nav>" not in row.normalized_html


def test_marks_equal_tree_version(spark):
    rng = random.Random(7)
    base = "https://example.com/a/b"
    pages = [(i, base, random_page(rng)) for i in range(300)]
    got = {r.page_id: r.clean_text for r in X.clean_html_to_text(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    for number, _, html in pages:
        assert got.get(number, "") == Tree(html).clean_text(base), html


def test_noise_does_not_change_text(spark):
    noisy = PRODUCT.replace("</main>", '<div class="newsletter"><p>Join</p></div></main>')
    df = spark.createDataFrame([(1, "u", PRODUCT), (2, "u", noisy)], "page_id int, url string, html string")
    texts = {r.page_id: r.clean_text for r in X.clean_html_to_text(df).collect()}
    assert texts[1] == texts[2]


def test_normalized_html(spark):
    html = """<!DOCTYPE html><p CLASS=" b  a " title='say "hi"'>1 &lt; 2<br><img srcset="a.png 1x, b.png 2x, c.png 900w" src=z><a href='/q?a=1&amp;b'>k</a>"""
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id int, url string, html string")
    assert X.normalize_html(df).first().normalized_html == (
        '<!DOCTYPE html>\n<p class="b a" title=\'say "hi"\'>1 &lt; 2<br/>'
        '<img src="http://h/b.png" srcset="a.png 1x, b.png 2x, c.png 900w"/><a href="http://h/q?a=1&amp;b">k</a></p>'
    )


def test_markdown_subset(spark):
    html = "<h2>T</h2><p>a <b>b</b> <em>c</em> <code>d</code></p><ul><li>x<li>y</ul><ol><li>1</li><li>2</li></ol><a href='/l'>k</a><hr>"
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id int, url string, html string")
    text = X.extract_content(df).first().markdown
    for part in ("## T", "a **b** *c* `d`", "- x", "- y", "1. 1", "2. 2", "[k](http://h/l)", "---"):
        assert part in text


def test_node_intervals(spark):
    df = spark.createDataFrame([("<div><p>a<p>b</div>c<br/>",)], "html string")
    nodes = with_nodes(df).select(F.inline("nodes")).collect()
    assert [(n.id, n.parent, n.last, n.tag or n.text) for n in nodes] == [
        (0, -1, 4, "div"), (1, 0, 4, "p"), (2, 1, 2, "a"), (3, 1, 4, "p"), (4, 3, 4, "b"), (5, -1, 5, "c"), (6, -1, 6, "br"),
    ]


def test_no_shuffle_and_one_parse(spark):
    df = spark.createDataFrame([(1, "u", PRODUCT)], "page_id int, url string, html string")
    plan = X.extract_content(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1


def markdown_of(spark, html):
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id int, url string, html string")
    return X.extract_content(df).first().markdown


def test_markdown_nested_lists(spark):
    html = "<p>a</p><ul><li>x<ul><li>y <code>k</code></li><li><p>z1</p><p class=k>z2</p></li></ul></li><li class=e></li><li>w</li></ul><ol><li>one</li><li>two</li></ol>"
    assert markdown_of(spark, html) == "a\n\n- x\n  - y `k`\n  - z1\n\n    z2\n- w\n\n1. one\n2. two"


def test_markdown_quotes(spark):
    html = "<blockquote><p>q1</p><p class=k>q2<br>q3</p><ul><li>item<blockquote>deep</blockquote></li></ul></blockquote>after"
    assert markdown_of(spark, html) == "> q1\n>\n> q2  \n> q3\n>\n> - item\n>\n>   > deep\n\nafter"


def test_markdown_tables(spark):
    html = "<table><thead><tr><th>H</th><th>I</th></tr></thead><tbody><tr><td>1<p>p</p></td><td>2<br>3</td></tr></tbody></table><table><tr><td>alone</td></tr></table>"
    assert markdown_of(spark, html) == "| H | I |\n| --- | --- |\n| 1p | 2 3 |\n\n| alone |\n| --- |"


def test_markdown_preformatted_headings_and_empty_marks(spark):
    html = "<b></b><h3>T<br>u</h3><pre>  a\n   <b>b</b></pre><hr><i> </i><dl><dt>t</dt><dd>d</dd></dl>"
    assert markdown_of(spark, html) == "### T u\n\n```\n  a\n   b\n```\n\n---\n\nt\n:   d"
    assert markdown_of(spark, "<nav>only</nav>") == "" and markdown_of(spark, "bare") == "bare"


def test_long_and_deep_pages(spark):
    wide = "<ul>" + "".join(f"<li>{i} {'w' * 130}" + "</li>" for i in range(20_000)) + "</ul>"
    deep = "<div>" * 3_000 + "text " * 30 + "</div>" * 3_000
    assert markdown_of(spark, wide).count("\n") == 19_999
    assert markdown_of(spark, deep) == ("text " * 30).strip()


def test_one_row_per_page_whatever_is_in_it(spark):
    rows = [(1, "https://e.com/", "<nav>menu</nav>"), (2, "https://e.com/", ""), (3, "https://e.com/", None), (4, None, "<p>a</p>"), (4, "https://e.com/", "<p>b</p>"), (None, "u", "<p>c</p>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    from pagewright.operators.extract import clean_html_to_text, extract_content

    got = sorted((r.page_id or 0, r.clean_text) for r in clean_html_to_text(pages).collect())
    assert got == [(0, "c"), (1, ""), (2, ""), (3, ""), (4, "a"), (4, "b")]
    assert sorted(r.markdown for r in extract_content(pages).collect()) == ["", "", "", "a", "b", "c"]


def test_links_of_anchors_only_and_without_limit(spark):
    from pagewright.operators.links import extract_links

    html = '<link href="/css/x"><a href=/plain>p</a><a href="/s?a=1&amp;b=2">s</a><a href="#top">t</a>' + "".join(f'<a href="/n{i}">n</a>' for i in range(600))
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id int, url string, html string")
    links = extract_links(pages).first().links
    assert links[:2] == ["https://e.com/plain", "https://e.com/s?a=1&b=2"] and len(links) == 602
    assert "https://e.com/css/x" in extract_links(pages, by_pattern=True).first().links
