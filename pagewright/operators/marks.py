"""What rendering needs to know of each node, as one array of events per page.

The nodes of a page are numbered in document order, so that a subtree is an interval. Removed subtrees are a running
maximum of interval ends, text below an element is the difference of two prefix sums, and the place of a block in lists,
quotes and tables is a stack. All of it is made in the pass that parses the page; how events are written is left to Spark.
Work is linear in the nodes of a page, but for sorting class names.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.nodes import ELEMENT, TEXT, read_nodes, in_slices

# Elements removed as noise, and words in class/id/role/label that mark noise.
NOISE_TAGS = ["script", "style", "noscript", "svg", "canvas", "iframe", "header", "footer", "nav", "aside"]
NOISE_HINTS = [
    "cookie", "consent", "newsletter", "modal", "popup", "social", "breadcrumb", "related", "recommend", "promo",
]
NOISE_ATTRS = ["class", "id", "role", "aria-label"]
PRESERVE_ATTRS = [
    "data-ph-at-job-title-text", "data-ph-at-job-id-text", "data-ph-at-job-seqno-text", "data-ph-at-id", "itemprop",
]
PRESERVE_DATA_IDS = ["job-link", "jobdescription-text", "apply-link", "pagination-page-number-link"]

REPEATED_BLOCKS, SHORT_BLOCK_CHARS = 4, 120

OPEN, CLOSE, TEXT_EVENT, MARKUP_EVENT = "o", "c", "t", "m"
EVENT_TYPE = T.ArrayType(
    T.StructType()
    .add("what", "string")
    .add("tag", "string")
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("text", "string")  # of a text; of an element the job title that stands for its content
    .add("href", "string")  # of a link, at both ends
    .add("filled", "boolean")  # the element has text
    .add("cited", "boolean")  # outermost link whose address is written behind its text
    .add("in_link", "boolean")
    .add("new_run", "boolean")  # no text of the same parent comes just before
    .add("in_pre", "boolean")
    .add("flat", "boolean")  # inside a heading or table row, which are one line
    .add("rule", "integer")  # columns of the rule below a table's first row, at the row's end
    .add("lead", "string")  # where a Markdown block begins: what comes before it, and before its further lines
    .add("hang", "string")
)

# Elements that stand in lines of their own, and that are one line.
HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
FLAT = {*HEADINGS, "tr"}
BLOCK_TAGS = {
    *FLAT, *"p div section article main ul ol li dl dt dd table thead tbody tfoot blockquote pre hr title body form figure figcaption address".split(),
}


def is_preserved(tag: str, attrs: dict) -> bool:
    linked = tag == "a" and attrs.get("href")
    return bool(linked or attrs.get("data-ph-at-id") in PRESERVE_DATA_IDS or any(attrs.get(name) for name in PRESERVE_ATTRS))


def is_noise(tag: str, attrs: dict) -> bool:
    if tag in NOISE_TAGS:
        return True
    described = " ".join(attrs.get(name, "") for name in NOISE_ATTRS).lower()
    return any(hint in described for hint in NOISE_HINTS) and not is_preserved(tag, attrs)


def _outside(kept: list[int], nodes: list[list], starts) -> list[int]:
    """Numbers in `kept` without the subtrees whose root `starts` accepts."""
    out, end = [], -1
    for i in kept:
        if i > end:
            if starts(i):
                end = nodes[i][1]
            else:
                out.append(i)
    return out


def _sums(n: int, values: dict[int, int]) -> list[int]:
    return [0, *accumulate(values.get(i, 0) for i in range(n))]


def _pruned(nodes: list[list]) -> tuple[list[int], list[dict], dict[int, str]]:
    """Numbers of the nodes that stay, the attributes of all, and the titles given to links without text."""
    n, attrs = len(nodes), [dict(node[4]) for node in nodes]
    element = [node[2] == ELEMENT for node in nodes]
    kept = _outside(list(range(n)), nodes, lambda i: element[i] and is_noise(nodes[i][3], attrs[i]))

    size = {i: len(nodes[i][5].strip()) for i in kept if nodes[i][2] == TEXT}
    shown, titles = _sums(n, {i: 1 for i, s in size.items() if s}), {}
    stay, end = [], -1
    for i in kept:
        if i <= end:
            continue
        stay.append(i)
        title = attrs[i].get("data-ph-at-job-title-text", "").strip()
        if title and nodes[i][3] == "a" and "href" in attrs[i] and shown[nodes[i][1] + 1] == shown[i]:
            titles[i], end = title, nodes[i][1]
    kept = stay

    own = {i: len(titles[i]) if i in titles else size.get(i, 0) for i in kept}
    chars, pieces = _sums(n, own), _sums(n, {i: 1 for i, s in own.items() if s})
    children: dict[int, list[str]] = {}
    for i in kept:
        if element[i] and len(first := children.setdefault(nodes[i][0], [])) < 4:
            first.append(nodes[i][3])
    shape, length = {}, {}
    for i in kept:
        if element[i]:
            behind = nodes[i][1] + 1
            length[i] = chars[behind] - chars[i] + max(pieces[behind] - pieces[i] - 1, 0)
            names = tuple(sorted(attrs[i].get("class", "").split())[:3])
            shape[i] = (nodes[i][3], min(length[i] // 20, 6), names, tuple(children.get(i, ())))
    times = Counter(shape.values())

    def repeated(i: int) -> bool:
        short = element[i] and length[i] < SHORT_BLOCK_CHARS and times[shape[i]] >= REPEATED_BLOCKS
        return short and not is_preserved(nodes[i][3], attrs[i])

    return _outside(kept, nodes, repeated), attrs, titles


class _Lines:
    """Where Markdown blocks begin and what stands before their lines, given the open lists, quotes and tables."""

    def __init__(self):
        self.hang, self.first, self.written, self.last_hang = "", None, 0, ""
        self.contexts: list[tuple[str, str | None, int]] = []
        self.lists: list[list] = []  # of each open list its tag and the number of items so far
        self.rows: list[int] = []  # rows so far of each open table
        self.items, self.tight, self.boundary = 0, False, None

    def push(self, first: str, further: str) -> None:
        self.contexts.append((self.hang, self.first, self.written))
        self.first = (self.hang if self.first is None else self.first) + first
        self.hang += further

    def pop(self) -> None:
        self.hang, first, written = self.contexts.pop()
        self.first = first if written == self.written else None

    def content(self) -> None:
        """The block that begins at the last boundary is not empty."""
        if self.boundary is None:
            return
        gap = "\n" if self.tight else f"\n{commonprefix([self.last_hang, self.hang]).rstrip()}\n"
        self.boundary["lead"] = gap + (self.hang if self.first is None else self.first)
        self.boundary["hang"] = self.last_hang = self.hang
        self.boundary, self.first, self.tight = None, None, False
        self.written += 1

    def opened(self, tag: str, event: dict) -> None:
        self.boundary = event
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "table":
            self.rows.append(0)
        elif tag == "tr" and self.rows:
            self.tight = self.rows[-1] > 0
            self.rows[-1] += 1
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            self.tight = self.items > 0 or kind[1] > 0
            kind[1] += 1
            bullet = f"{kind[1]}. " if kind[0] == "ol" else "- "
            self.push(bullet, " " * len(bullet))
            self.items += 1
        elif tag == "dd":
            self.push(":   ", "    ")
            self.tight = True
        elif tag == "blockquote":
            self.push("> ", "> ")
        elif tag in HEADINGS:
            self.push(HEADINGS[tag], "")

    def closed(self, tag: str, event: dict) -> None:
        if tag in ("ul", "ol"):
            self.lists.pop()
        elif tag == "table":
            self.rows.pop()
        elif tag in ("li", "dd", "blockquote") or tag in HEADINGS:
            self.pop()
            self.items -= tag == "li"
        self.boundary, self.tight = event, False


def page_events(html: str) -> list[dict]:
    """Events of the nodes that stay: both ends of elements, texts and markup, in document order."""
    nodes = read_nodes(html)
    kept, attrs, titles = _pruned(nodes)
    is_shown = {i: 1 for i in kept if i in titles or nodes[i][2] == TEXT and nodes[i][5].strip()}
    shown = _sums(len(nodes), is_shown)
    events: list[dict] = []
    lines, open_elements = _Lines(), []
    links = pre = flat = 0
    cells: list[int] = []  # of each open table row

    def finish(before: int) -> None:
        nonlocal links, pre, flat
        while open_elements and nodes[open_elements[-1][0]][1] < before:
            i, start = open_elements.pop()
            tag = nodes[i][3]
            links -= start["cites"]
            pre -= tag == "pre"
            flat -= tag in FLAT
            event = start | {"what": CLOSE, "attrs": None, "text": None, "lead": None, "hang": None}
            if tag == "tr":
                columns = cells.pop()
                event["rule"] = columns if lines.rows and lines.rows[-1] == 1 and not flat else 0
            events.append(event)
            if tag in BLOCK_TAGS and not flat:
                lines.closed(tag, event)

    previous = None  # parent of the text just before
    for i in kept:
        parent, last, kind, tag, _, text = nodes[i]
        finish(i)
        event = {"what": OPEN, "tag": tag, "text": text, "in_link": links > 0, "in_pre": pre > 0, "flat": flat > 0}
        events.append(event)
        if kind == ELEMENT:
            href, title = attrs[i].get("href") if tag == "a" else None, titles.get(i)
            filled = shown[last + 1] > shown[i]
            cites = filled and href is not None and not href.startswith("javascript:")
            event |= {
                "attrs": attrs[i], "text": title, "href": href, "filled": filled, "cites": cites, "cited": cites and not links,
            }
            if tag in BLOCK_TAGS and not flat:
                lines.opened(tag, event)
            if tag in ("td", "th") and cells:
                cells[-1] += 1
            if title or tag in ("img", "hr") or filled and tag in ("pre", "tr"):
                lines.content()
            links += cites
            pre += tag == "pre"
            flat += tag in FLAT
            if tag == "tr":
                cells.append(0)
            open_elements.append((i, event))
            previous = None
        else:
            is_text = kind == TEXT
            event |= {"what": TEXT_EVENT if is_text else MARKUP_EVENT, "new_run": is_text and previous != parent}
            previous = parent if is_text else None
            if i in is_shown:
                lines.content()
    finish(len(nodes))
    return events


def _events(html: pa.Array) -> pa.Array:
    offsets, attr_offsets, names, values = [0], [0], [], []
    columns = {f.name: [] for f in EVENT_TYPE.elementType.fields if f.name != "attrs"}
    for page in html.to_pylist():
        for event in page_events(page or ""):
            for name, column in columns.items():
                column.append(event.get(name))
            for name, value in (event.get("attrs") or {}).items():
                names.append(name)
                values.append(value)
            attr_offsets.append(len(names))
        offsets.append(len(attr_offsets) - 1)
    kinds = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32()}
    arrays = []
    for f in EVENT_TYPE.elementType.fields:
        if f.name == "attrs":
            arrays.append(pa.MapArray.from_arrays(pa.array(attr_offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())))
        else:
            arrays.append(pa.array(columns[f.name], kinds[f.dataType]))
    structs = pa.StructArray.from_arrays(arrays, names=EVENT_TYPE.elementType.names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


# Declared non-deterministic so that the optimizer neither repeats the call nor copies it into several projections.
parse_events = F.arrow_udf(in_slices(_events), EVENT_TYPE).asNondeterministic()
