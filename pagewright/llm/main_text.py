"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable that is content or not. Its tag, names, amount of text and
share of link text give it a score; a table per kind of element scores it together with its parent. Messages
passed from the leaves up and from the root down give the exact probability of each element (sum-product),
and the text of those more likely content than not is the page's text. Weights are fitted by the gradient of the
likelihood, which the same messages give.

Labelled pages: a bounded sample of the given pages whose landmarks (article, main, nav, footer ...) say what is
content, and generated pages, which have the same parts under other names and without landmarks.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 200
GENERATED_PAGES = 400
STEPS = 120
RATE = 0.1
DECAY = 1e-4
SEED = 42
# Pages whose trees are passed through together.
BATCH_PAGES = 200

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select button textarea option title".split())
# Of these, what hides only up to its own end tag: where that is missing, the page's text goes on inside. Those that
# are labelled or have a fixed content hide what comes before the first block.
UNTIL_CLOSED = frozenset("head noscript svg math object canvas audio video select button".split())
UNTIL_BLOCK = frozenset("head select button".split())
# What a head can hold: anything else ends it.
HEAD_PARTS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
LANDMARKS = frozenset("article main nav header footer aside form section".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address summary legend label".split())
CONTAINERS = frozenset("html body div ul ol dl table thead tbody tfoot tr figure details fieldset center hgroup dialog menu search".split())
BLOCKS = LANDMARKS | TEXT_BLOCKS | CONTAINERS
CLOSED_BY_NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table html body".split())
NOT_CONTENT = frozenset("nav header footer aside form".split())


@dataclass
class Page:
    """Block elements in page order; element 0 is the root, a parent comes before its children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    # (element, block number, text); blocks end wherever a block element begins or ends.
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.block, self.hidden, self.links = Page(), [("#root", 0)], 0, 0, 0
        # Of each text whether it stands in a link and whether it is shown; of each open element of UNTIL_CLOSED the
        # number of texts before it and before its first block.
        self.in_link, self.shown, self.covers, self.fresh = bytearray(), bytearray(), [], []
        # How many elements of a tag are open, and where block elements lie in `open`: tags without a partner, and blocks
        # in many inline elements, do not walk through all that is open.
        self.n_open, self.block_depths = Counter(), []

    def _close(self, depth: int, ended: bool = False) -> None:
        """Close `open[depth:]`; with `ended` the first of them by its own end tag, all others by what follows."""
        for at in range(len(self.open) - 1, depth - 1, -1):
            tag = self.open[at][0]
            if tag in UNTIL_CLOSED:
                cover = self.covers.pop()
                if self.fresh and self.fresh[-1] is cover:
                    self.fresh.pop()
                start, block = cover
                if ended and at == depth:
                    end = len(self.shown)
                else:
                    end = (len(self.shown) if block is None else block) if tag in UNTIL_BLOCK else start
                self.shown[start:end] = bytes(end - start)
            else:
                self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.block += tag in BLOCKS
            self.n_open[tag] -= 1
        del self.open[depth:]
        while self.block_depths and self.block_depths[-1] >= depth:
            self.block_depths.pop()

    def _imply(self, tag: str) -> None:
        """Close what this start tag ends: a paragraph, or the item, cell or row before."""
        if not self.n_open["p"] and not any(self.n_open[name] for name in CLOSED_BY_NEXT.get(tag, ())):
            return None
        for depth in reversed(self.block_depths):
            name = self.open[depth][0]
            if name == "p" and tag in BLOCKS or name in CLOSED_BY_NEXT.get(tag, ()):
                return self._close(depth)
            if name in SCOPES or name in BLOCKS and tag not in CLOSED_BY_NEXT:
                return None

    def _end_head(self, tag: str) -> None:
        """Close the head, whose end tag may be left out, at what it cannot hold."""
        if not self.n_open["head"]:
            return
        if tag == "body":
            for depth in range(1, len(self.open)):
                if self.open[depth][0] == "head":
                    return self._close(depth)
        elif self.open[-1][0] == "head" and tag not in HEAD_PARTS:
            self._close(len(self.open) - 1)

    def parse_marked_section(self, i, report=1):
        """Unknown sections are bogus comments, as in browsers; the base class stops at them."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag == "br":
            return self.handle_data("\n")
        if tag in VOID:
            self.block += tag == "hr"
            return None
        if tag in BLOCKS or tag == "option":
            while self.open[-1][0] == "option":
                self._close(len(self.open) - 1)
        if tag in BLOCKS:
            self._imply(tag)
            for cover in self.fresh:
                cover[1] = len(self.shown)
            self.fresh.clear()
        element = self.open[-1][1]
        if tag in BLOCKS:
            self.block += 1
            page, names = self.page, " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            page.parent.append(element)
            page.tag.append(tag)
            page.names.append(tuple(re.findall("[a-z]+", names.lower())))
            page.chars.append(0)
            page.linked.append(0)
            element = len(page.tag) - 1
        if tag in UNTIL_CLOSED:
            cover = [len(self.shown), None]
            self.covers.append(cover)
            self.fresh.append(cover)
        else:
            self.hidden += tag in HIDDEN
        self.links += tag == "a"
        if tag in BLOCKS:
            self.block_depths.append(len(self.open))
        self.n_open[tag] += 1
        self.open.append((tag, element))

    def handle_startendtag(self, tag, attrs):
        """Only svg and math, and what they hold, can close themselves; elsewhere the slash means nothing."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.n_open["svg"] or self.n_open["math"]):
            self._close(len(self.open) - 1, ended=True)

    def handle_endtag(self, tag):
        if not self.n_open[tag]:
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                return self._close(depth, ended=True)

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self._close(len(self.open) - 1)
        if not self.hidden:
            self.page.texts.append((self.open[-1][1], self.block, data))
            self.in_link.append(self.links > 0)
            self.shown.append(1)

    def finish(self) -> Page:
        self._close(1)
        page, texts = self.page, []
        for text, linked, shown in zip(page.texts, self.in_link, self.shown):
            if shown:
                texts.append(text)
                size = len(text[2].strip())
                page.chars[text[0]] += size
                page.linked[text[0]] += size if linked else 0
        page.texts = texts
        return page


def parse(html: str | None) -> Page:
    """Elements and texts of a page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.finish()


# Fragments have their elements at the top.
_TOP = {"#root": "body", "html": "body"}


def _bucket(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def features(page: Page) -> list[list[str]]:
    """Names of the features of each element."""
    n = len(page.tag)
    chars, linked = list(page.chars), list(page.linked)
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        density = _bucket(linked[i] / chars[i], (0.05, 0.35, 0.75)) if chars[i] else 9
        size = _bucket(page.chars[i], (1, 20, 80, 200))
        tag = page.tag[i]
        out.append(
            ["bias", f"tag {tag}", f"under {_TOP.get(page.tag[page.parent[i]], page.tag[page.parent[i]])}" if i else "root", f"links {density}", f"size {size}", f"tag {tag} size {size}"]
            + [f"name {name}" for name in dict.fromkeys(page.names[i])]
        )
    return out


def _kind(tag: str) -> int:
    return 0 if tag in CONTAINERS else 1 if tag in LANDMARKS else 2


class Forest:
    """Many pages as one set of arrays, elements by depth for passing messages level by level."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int], grow: bool = False):
        parents, kinds, owner, ids = [], [], [], []
        self.first = []
        for page in pages:
            base = len(parents)
            self.first.append(base)
            parents.extend(p + base if p >= 0 else -1 for p in page.parent)
            kinds.extend(map(_kind, page.tag))
            for i, names in enumerate(features(page)):
                for name in names:
                    number = vocabulary.setdefault(name, len(vocabulary)) if grow else vocabulary.get(name)
                    if number is not None:
                        owner.append(base + i)
                        ids.append(number)
        self.n, self.parent, self.kind = len(parents), np.array(parents, np.int64), np.array(kinds, np.int64)
        self.owner, self.ids = np.array(owner, np.int64), np.array(ids, np.int64)
        depth = np.zeros(self.n, np.int64)
        for i, p in enumerate(parents):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.nonzero(np.diff(depth[order]))[0] + 1) if self.n else []

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.ids], self.n)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # (kind of child, parent state, child state)


def marginals(forest: Forest, scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content per element, and of (parent, own) states per element; exact on trees."""
    up = np.zeros((forest.n, 2))
    up[:, 1] = scores
    message = np.zeros((forest.n, 2))
    table = pairs[forest.kind]
    for level in forest.levels[:0:-1]:
        joint = table[level] + up[level][:, None, :]
        message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(up, forest.parent[level], message[level])
    full, both = up, np.zeros((forest.n, 2, 2))
    for level in forest.levels[1:]:
        joint = (full[forest.parent[level]] - message[level])[:, :, None] + table[level]
        both[level] = joint + up[level][:, None, :]
        full[level] = up[level] + np.logaddexp(joint[:, 0, :], joint[:, 1, :])
    own = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
    both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
    return own, both / both.sum(axis=(1, 2), keepdims=True)


def train(pages: list[Page], labels: list[list[bool]]) -> Model:
    """Maximum likelihood with a small decay, by Adam over all labelled pages at once."""
    vocabulary: dict[str, int] = {}
    forest = Forest(pages, vocabulary, grow=True)
    truth = np.array([x for page in labels for x in page], float)
    inner = forest.parent >= 0
    states = np.zeros((forest.n, 2, 2))
    states[np.nonzero(inner)[0], truth[forest.parent[inner]].astype(int), truth[inner].astype(int)] = 1
    parts = [np.zeros(len(vocabulary)), np.zeros((3, 2, 2))]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        own, both = marginals(forest, forest.scores(parts[0]), parts[1])
        slope = np.bincount(forest.ids, (truth - own)[forest.owner], len(vocabulary)) / len(pages) - DECAY * parts[0]
        pair = np.zeros((3, 2, 2))
        np.add.at(pair, forest.kind[inner], (states - both)[inner])
        for p, g, m, v in zip(parts, (slope, pair / len(pages) - DECAY * parts[1]), mean, square):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, parts[0], parts[1])


def landmark_labels(page: Page) -> list[bool] | None:
    """Content by landmarks: inside the page's only article or main and outside of what is never content."""
    inside, barred, out, found = [False], [False], [False], 0
    for i in range(1, len(page.tag)):
        p, tag = page.parent[i], page.tag[i]
        starts = tag in ("article", "main") and not inside[p]
        found += starts
        inside.append(inside[p] or starts)
        barred.append(barred[p] or tag in NOT_CONTENT or bool(NOT_CONTENT_NAMES.intersection(page.names[i])))
        out.append(inside[i] and not barred[i])
    return out if found == 1 else None


# Usual names of the parts of a page.
CONTENT_NAMES = "content article post entry story main body text page prose".split()
PART_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs".split(),
    "header": "header masthead topbar branding logo".split(),
    "footer": "footer copyright legal colophon bottom".split(),
    "sidebar": "sidebar aside widget related recommended trending popular tags archive".split(),
    "notice": "notice cookie cookies consent banner alert popup modal gdpr overlay".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion".split(),
    "form": "form newsletter subscribe signup search login contact".split(),
    "comments": "comments comment discussion replies reply respond disqus".split(),
    "share": "share social sharing follow".split(),
}
NOT_CONTENT_NAMES = frozenset(name for names in PART_NAMES.values() for name in names)
PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def generated_page(rng: random.Random) -> tuple[Page, list[bool]]:
    """A labelled page: content among the other parts, with or without landmarks and telling names."""
    page, labels = Page(), [False]

    def add(parent: int, tag: str, names: tuple[str, ...], content: bool, chars: int = 0, linked: int = 0) -> int:
        page.parent.append(parent)
        page.tag.append(tag)
        page.names.append(names)
        page.chars.append(chars)
        page.linked.append(linked)
        labels.append(content)
        return len(page.tag) - 1

    def part(parent: int, kind: str) -> None:
        tag = PART_TAGS.get(kind, "div") if rng.random() < 0.6 else rng.choice(["div", "section", "ul"])
        named = tag == "div" or tag == "section" or tag == "ul" or rng.random() < 0.5
        names = tuple({rng.choice(PART_NAMES[kind]), rng.choice([*PART_NAMES[kind], "box", "wrapper", "left", "inner"])}) if named else ()
        top = add(parent, tag, names, False, 0 if rng.random() < 0.4 else rng.randint(5, 160))
        if rng.random() < 0.3:
            top = add(top, "div", (rng.choice(["inner", "container", "row", "wrap"]),), False)
        if rng.random() < 0.4:
            add(top, rng.choice(["h2", "h3", "h4", "p"]), (), False, rng.randint(5, 40))
        for _ in range(rng.randint(0, 8)):
            size = rng.randint(3, 60) if kind not in ("comments", "notice", "advert") else rng.randint(20, 400)
            linked = size if kind in ("menu", "share", "sidebar") and rng.random() < 0.9 else 0
            tag = rng.choice(["li", "p", "div"]) if kind != "comments" else rng.choice(["div", "p", "li", "article"])
            child = add(top, tag, (rng.choice(PART_NAMES[kind]),) if rng.random() < 0.3 else (), False, size, linked)
            if rng.random() < 0.3:
                add(child, "p", (), False, rng.randint(5, 300))

    def parts(parent: int, kinds: list[str], chance: float) -> None:
        for kind in kinds:
            if rng.random() < chance:
                part(parent, kind)

    top = add(add(0, "html", (), False), "body", (), False)
    if rng.random() < 0.4:
        top = add(top, "div", (rng.choice(["wrapper", "container", "site", "page", "layout", "row"]),), False)
    parts(top, ["notice", "header", "menu", "advert", "share", "form"], 0.5)
    holder = top
    if rng.random() < 0.4:
        holder = add(top, rng.choice(["div", "section"]), (rng.choice(["container", "wrapper", "row", "column", "layout"]),), False)
        parts(holder, ["sidebar", "advert"], 0.3)
    tag = rng.choice(["article", "main", "article", "div", "section"])
    names = (rng.choice(CONTENT_NAMES),) if tag == "div" or tag == "section" or rng.random() < 0.4 else ()
    # Some pages have their paragraphs among the other parts, in nothing of their own.
    article = holder if rng.random() < 0.15 else add(holder, tag, names, True)
    inner = article if article == holder else add(article, "div", (rng.choice(CONTENT_NAMES),), True) if rng.random() < 0.3 else article
    add(inner, "h1", ("title",) if rng.random() < 0.3 else (), True, rng.randint(10, 90))
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.62:
            size = rng.randint(2, 900)
            add(inner, "p", (), True, size, rng.choice([0, 0, 0, min(size, 15)]))
        elif kind < 0.7:
            add(inner, rng.choice(["h2", "h3"]), (), True, rng.randint(3, 60))
        elif kind < 0.86:
            group = add(inner, rng.choice(["ul", "ol"]), (), True)
            for _ in range(rng.randint(1, 7)):
                add(group, "li", (), True, rng.choice([rng.randint(3, 30), rng.randint(5, 200)]))
        elif kind < 0.9:
            row = add(add(inner, "table", (), True), "tr", (), True)
            for _ in range(rng.randint(1, 4)):
                add(row, "td", (), True, rng.randint(1, 40))
        elif kind < 0.95:
            add(add(inner, rng.choice(["blockquote", "figure", "div"]), (), True), "p", (), True, rng.randint(10, 300))
        else:
            parts(inner, ["advert", "share", "sidebar", "form", "notice", "menu"], 0.3)
    parts(article if rng.random() < 0.3 else holder, ["share", "comments", "sidebar", "form"], 0.4)
    parts(top, ["sidebar", "comments", "advert", "notice", "footer", "form", "footer"], 0.4)
    return page, labels


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES) -> Model:
    """Model from about `sample` pages, picked by a hash of their key, and generated pages."""
    share = min(1.0, sample / max(1, pages.count()))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30))
    # Twice as many is far more than the hash can pick by chance: the limit is a guard for repeated keys.
    picked = pages.where(F.col(html).isNotNull() & (draw <= int((1 << 30) * share))).select(html).limit(2 * sample)
    rows = sorted(picked.collect())
    rng = random.Random(SEED)
    labelled = [generated_page(rng) for _ in range(GENERATED_PAGES)]
    for row in rows:
        page = parse(row[0])
        labels = landmark_labels(page)
        if labels is not None:
            labelled.append((page, labels))
    return train([p for p, _ in labelled], [l for _, l in labelled])


def extracted(model: Model, pages: list[Page]) -> list[str]:
    """Texts of the pages: blocks of content elements, one a line."""
    forest = Forest(pages, model.vocabulary)
    own, _ = marginals(forest, forest.scores(model.weights), model.pairs)
    out = []
    for page, base in zip(pages, forest.first):
        lines: list[str] = []
        pieces: list[str] = []
        last = None
        for element, block, text in page.texts:
            if block != last and pieces:
                lines.append("".join(pieces))
                pieces = []
            last = block
            if own[base + element] > 0.5:
                pieces.append(text)
        lines.append("".join(pieces))
        out.append("\n".join(line for line in (" ".join(x.split()) for x in lines) if line))
    return out


def main_text(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """`pages` without `html`, with `text` and `n_chars`: one row per row; null and empty pages have empty text.

    Columns called `text` or `n_chars` in `pages` are replaced.
    """
    model = model or fit(pages, html)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                rows = batch.slice(at, BATCH_PAGES)
                texts = extracted(model, [parse(x.as_py()) for x in rows.column(rows.num_columns - 1)])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*rows.schema.names[:-1], "text", "n_chars"],
                )

    own = pages.select(*kept, F.col(html).alias("__html"))
    return own.mapInArrow(apply, pages.select(*kept).schema.add("text", "string").add("n_chars", "long"))
