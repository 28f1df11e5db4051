"""HTML to node arrays: the only step of page processing that needs Python.

Each element, text and comment becomes one struct with its pre-order `id`, its `parent`
and `last`, the greatest id inside its subtree. With that interval numbering, "inside",
"subtree removed" and "text below" turn into comparisons, running maxima and running
sums, which the extraction and pagination operators express with Spark columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import nvl, strip

ELEMENT, TEXT, HIDDEN, MARKUP = "e", "t", "h", "m"

NODE_TYPE = T.ArrayType(
    T.StructType()
    .add("id", "integer")
    .add("parent", "integer")
    .add("last", "integer")
    .add("kind", "string")
    .add("tag", "string")
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("text", "string")
)

# Elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound "
    "command frame image isindex nextid spacer".split()
)
HIDDEN_TEXT_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
KEEP_SPACE_TAGS = frozenset(["pre", "textarea"])


class _NodeReader(HTMLParser):
    """Collects nodes. End tags close the nearest open element of that name, nothing is implied."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.n_open: Counter[str] = Counter()  # open elements by tag
        self.pending: list[str] = []

    def _add(self, kind, tag, attrs, text):
        number = len(self.nodes)
        self.nodes.append([self.open[-1] if self.open else -1, number, kind, tag, attrs, text])
        return number

    def _inside(self, tags):
        return any(self.n_open[tag] for tag in tags)

    def _flush(self):
        text = "".join(self.pending)
        self.pending.clear()
        if not text:
            return
        if not text.strip(" \n\t\f\r") and not self._inside(KEEP_SPACE_TAGS):
            text = "\n" if "\n" in text else " "
        self._add(HIDDEN if self._inside(HIDDEN_TEXT_TAGS) else TEXT, None, [], text)

    def _close_to(self, depth):
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            node[1] = len(self.nodes) - 1
            self.n_open[node[3]] -= 1

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = {name: value or "" for name, value in attrs}
        number = self._add(ELEMENT, tag, list(values.items()), None)
        if tag not in VOID_TAGS:
            self.open.append(number)
            self.n_open[tag] += 1

    def handle_endtag(self, tag):
        self._flush()
        if not self.n_open[tag]:
            return None
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][3] == tag:
                return self._close_to(depth)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        known = unescape(f"&{name};")
        self.pending.append(f"&{name}" if known == f"&{name};" else known)

    def _markup(self, text):
        self._flush()
        self._add(MARKUP, None, [], text)

    def handle_comment(self, data):
        self._markup(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._markup(f"<!DOCTYPE {decl[8:]}>\n")

    def unknown_decl(self, data):
        self._markup(f"<![{data}]]>")

    def handle_pi(self, data):
        self._markup(f"<?{data}>")

    def read(self, html):
        try:
            self.feed(html)
            self.close()
        except AssertionError:
            pass  # hopeless declaration: keep what was read before it
        self._flush()
        self._close_to(0)
        return self.nodes


def read_nodes(html: str) -> list[list]:
    """Nodes of one page: parent, last, kind, tag, attribute pairs, text; the id is the place in the list."""
    return _NodeReader().read(html)


# Pages whose nodes a worker holds as Python objects at a time.
PAGES_AT_ONCE = 100


def in_slices(parse: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """`parse` over slices of each batch: what it makes of a batch can be many times as large as the batch."""

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), PAGES_AT_ONCE):
                yield parse(batch.slice(at, PAGES_AT_ONCE))

    return over


def _parse(html: pa.Array) -> pa.Array:
    offsets, attr_offsets = [0], [0]
    ids, parents, lasts, kinds, tags, texts, names, values = ([] for _ in range(8))
    for page in html.to_pylist():
        for number, (parent, last, kind, tag, attrs, text) in enumerate(read_nodes(page or "")):
            ids.append(number)
            parents.append(parent)
            lasts.append(last)
            kinds.append(kind)
            tags.append(tag)
            texts.append(text)
            for name, value in attrs:
                names.append(name)
                values.append(value)
            attr_offsets.append(len(names))
        offsets.append(len(ids))
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())
    )
    columns = {
        "id": pa.array(ids, pa.int32()),
        "parent": pa.array(parents, pa.int32()),
        "last": pa.array(lasts, pa.int32()),
        "kind": pa.array(kinds, pa.string()),
        "tag": pa.array(tags, pa.string()),
        "attrs": attrs,
        "text": pa.array(texts, pa.string()),
    }
    structs = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


# Declared non-deterministic so that the optimizer neither repeats the call in an inferred
# filter nor copies it into several projections.
parse_nodes = F.arrow_udf(in_slices(_parse), NODE_TYPE).asNondeterministic()


def with_nodes(pages: DataFrame, html: str = "html", out: str = "nodes") -> DataFrame:
    return pages.withColumn(out, parse_nodes(nvl(F.col(html))))


def attr(node: Column, name: str) -> Column:
    """Attribute value, NULL where the attribute is absent."""
    return F.try_element_at(node["attrs"], F.lit(name))


def attr_or_empty(node: Column, name: str) -> Column:
    return nvl(attr(node, name))


def class_names(node: Column) -> Column:
    return F.filter(F.split(attr_or_empty(node, "class"), r"(?U)\s+"), lambda c: c != "")


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(class_names(node), name)


def inside(node: Column, container: Column) -> Column:
    """True for proper descendants."""
    return (container["id"] < node["id"]) & (node["id"] <= container["last"])


def inside_any(node: Column, containers: Column) -> Column:
    return F.exists(containers, lambda c: inside(node, c))


def element_text(node: Column, texts: Column, separator: str = "") -> Column:
    """Stripped text pieces below an element, joined."""
    pieces = F.transform(F.filter(texts, lambda t: inside(t, node) & (t["kind"] == TEXT)), lambda t: strip(t["text"]))
    return F.array_join(F.filter(pieces, lambda p: p != ""), separator)


def is_disabled(node: Column) -> Column:
    return (
        attr(node, "disabled").isNotNull()
        | (F.lower(attr_or_empty(node, "aria-disabled")) == "true")
        | F.contains(F.lower(attr_or_empty(node, "class")), F.lit("disabled"))
    )


def dom_hrefs(nodes: Column) -> Column:
    """Non-empty href values of anchors in document order."""
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & (attr_or_empty(n, "href") != ""))
    return F.transform(anchors, lambda n: attr(n, "href"))
