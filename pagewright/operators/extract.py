"""Page content extraction inside the row: no shuffle, no window, one parse per page.

The parse gives a page's events in document order, each with what depends on other nodes (see `marks`). Everything that is
written - links, attributes, text, Markdown - are column expressions over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.functions.text import let, nvl, strip
from pagewright.operators import marks as M
from pagewright.operators import nodes as N

# Words of product pages, and attributes that are lists of words.
PRODUCT_HINTS = ["price", "sku", "spec", "product", "buy", "cart", "availability"]
LIST_ATTRS = ["class", "rel", "rev", "headers", "accesskey", "dropzone"]

# Unicode noncharacters as stream marks: end of a text run, of a run inside a link, of link text; begin of a Markdown block,
# end of its first prefix and of the prefix of its further lines.
RUN, LINK_RUN, LINK_END = "\ufdd0", "\ufdd1", "\ufdd2"
BLOCK, LEAD_END, HANG_END = "\ufdd3", "\ufdd4", "\ufdd5"


def looks_like_product(text: Column) -> Column:
    lowered = F.lower(text)
    hits = [F.contains(lowered, F.lit(h)).cast("int") for h in PRODUCT_HINTS]
    return sum(hits[1:], hits[0]) >= 2


def best_srcset(srcset: Column) -> Column:
    """Candidate with the largest width (`w`) or 1000 x density (`x`); the first of equals."""

    def scored(item: Column, i: Column) -> Column:
        words = F.split(strip(item), r"(?U)\s+")
        descriptor = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("1x"))
        number = F.regexp_extract(descriptor, r"^(.*)[wx]$", 1).try_cast("double")
        weight = F.when(F.endswith(descriptor, F.lit("x")), F.lit(1000.0)).otherwise(F.lit(1.0))
        score = F.coalesce(number * weight, F.lit(1.0))
        return F.struct(score.alias("score"), (-i).alias("order"), F.element_at(words, 1).alias("src"))

    ranked = F.filter(F.transform(F.split(srcset, ","), scored), lambda c: c["src"] != "")
    return F.array_max(ranked)["src"]


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _attribute(entry: Column) -> Column:
    tidy = F.when(
        entry["key"].isin(LIST_ATTRS), F.trim(F.regexp_replace(entry["value"], r"(?U)\s+", " "))
    ).otherwise(entry["value"])

    def quoted(v: Column) -> Column:
        double, single = F.contains(v, F.lit('"')), F.contains(v, F.lit("'"))
        return (
            F.when(double & ~single, F.concat(F.lit("'"), v, F.lit("'")))
            .when(double, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit('"')))
            .otherwise(F.concat(F.lit('"'), v, F.lit('"')))
        )

    return F.concat(F.lit(" "), entry["key"], F.lit("="), let(_escape(tidy), quoted))


def _open_tag(tag: Column, attrs: Column, link: Column) -> Column:
    """`link` replaces href or src where it is not NULL."""
    entries = F.map_entries(attrs)
    address = F.when(tag == "a", F.lit("href")).otherwise(F.lit("src"))
    linked = F.concat(
        F.filter(entries, lambda e: e["key"] != address),
        F.array(F.struct(address.alias("key"), link.alias("value"))),
    )
    listed = F.array_sort(F.when(link.isNotNull(), linked).otherwise(entries))
    end = F.when(tag.isin(sorted(N.VOID_TAGS)), F.lit("/>")).otherwise(F.lit(">"))
    return F.concat(F.lit("<"), tag, F.array_join(F.transform(listed, _attribute), ""), end)


# Markdown written before and after an element's content; blocks, lists and quotes come with the events.
_PLAIN_MARKS = {
    "b": ("**", "**"), "strong": ("**", "**"), "i": ("*", "*"), "em": ("*", "*"), "del": ("~~", "~~"), "s": ("~~", "~~"),
    "code": ("`", "`"), "kbd": ("`", "`"), "samp": ("`", "`"), "pre": ("```\n", "\n```"), "tr": ("|", ""), "td": (" ", " |"), "th": (" ", " |"),
}
# Inside preformatted text and without any text there are no marks but those of cells.
_CELLS = ("td", "th")


def _mark(e: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(x) for t, marks in _PLAIN_MARKS.items() for x in (t, marks[which])])
    wanted = (e["filled"] & ~e["in_pre"]) | e["tag"].isin(*_CELLS)
    return F.when(wanted, nvl(F.try_element_at(table, e["tag"]))).otherwise(F.lit(""))


def _linked(e: Column, base: Column) -> Column:
    """The event with `link`: the resolved address of a link, at both ends, or of an image."""
    picture = F.when((e["tag"] == "img") & (e["what"] == M.OPEN), best_srcset(N.attr_or_empty(e, "srcset")))
    source = F.nullif(F.coalesce(F.nullif(picture, F.lit("")), N.attr_or_empty(e, "src")), F.lit(""))
    address = F.when(e["tag"] == "a", e["href"]).when((e["tag"] == "img") & (e["what"] == M.OPEN), source)
    resolved = let(address, lambda a: F.when(a.isNotNull(), F.element_at(U.resolve_all(F.array(a), base), 1)))
    return e.withField("link", resolved)


def _html_token(e: Column) -> Column:
    end = F.when(e["tag"].isin(sorted(N.VOID_TAGS)), F.lit("")).otherwise(F.concat(F.lit("</"), e["tag"], F.lit(">")))
    return (
        F.when(e["what"] == M.OPEN, F.concat(_open_tag(e["tag"], e["attrs"], e["link"]), _escape(nvl(e["text"]))))
        .when(e["what"] == M.CLOSE, end)
        .when(e["what"] == M.TEXT_EVENT, _escape(e["text"]))
        .otherwise(e["text"])
    )


def _text_token(e: Column) -> Column:
    mark = F.when(e["in_link"], F.lit(LINK_RUN)).otherwise(F.lit(RUN))
    return (
        F.when(e["what"] == M.TEXT_EVENT, F.concat(F.when(e["new_run"], mark).otherwise(F.lit("")), e["text"]))
        .when((e["what"] == M.OPEN) & e["cited"], F.concat(F.lit(RUN), nvl(e["text"])))
        .when((e["what"] == M.OPEN) & e["text"].isNotNull(), F.concat(mark, e["text"]))
        .when((e["what"] == M.CLOSE) & e["cited"], F.concat(F.lit(LINK_END), e["link"], F.lit(RUN)))
        .otherwise(F.lit(""))
    )


def _md_token(e: Column) -> Column:
    link = (e["tag"] == "a") & (nvl(e["link"]) != "") & e["filled"]
    flowing = F.when(e["in_pre"] & ~e["flat"], e["text"]).otherwise(F.regexp_replace(e["text"], "[\t \r\n]+", " "))
    begin = nvl(F.concat(F.lit(BLOCK), e["lead"], F.lit(LEAD_END), e["hang"], F.lit(HANG_END)))
    image = F.concat(F.lit("!["), N.attr_or_empty(e, "alt"), F.lit("]("), nvl(e["link"]), F.lit(")"))
    opened = (
        F.when(link, F.lit("["))
        .when(e["tag"] == "img", image)
        .when(e["tag"] == "hr", F.lit("---"))
        .when(e["tag"] == "br", F.when(e["flat"], F.lit(" ")).when(e["in_pre"], F.lit("\n")).otherwise(F.lit("  \n")))
        .otherwise(_mark(e, 0))
    )
    rule = F.when(e["rule"] > 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), e["rule"]))).otherwise(F.lit(""))
    closed = (
        F.when(link, F.concat(F.lit("]("), e["link"], F.lit(")")))
        .when((e["tag"] == "tr") & e["filled"], rule)
        .otherwise(_mark(e, 1))
    )
    return (
        F.when(e["what"] == M.OPEN, F.concat(begin, opened, nvl(e["text"])))
        .when(e["what"] == M.CLOSE, F.concat(closed, begin))
        .when(e["what"] == M.TEXT_EVENT, flowing)
        .otherwise(F.lit(""))
    )


def _clean_text(stream: Column) -> Column:
    def segment(s: Column) -> Column:
        parts = F.split(s, LINK_END)
        body = F.array_join(F.transform(F.split(F.element_at(parts, 1), LINK_RUN), strip), "")
        return F.when(F.size(parts) > 1, F.concat(body, F.lit(" ("), F.element_at(parts, -1), F.lit(")"))).otherwise(body)

    segments = F.transform(F.split(stream, RUN), lambda s: strip(segment(s)))
    joined = F.array_join(F.filter(segments, lambda s: s != ""), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def _markdown(stream: Column) -> Column:
    """Blocks with their prefixes before the first and before further lines; what comes before the first block is inline."""

    def block(s: Column) -> Column:
        body = F.regexp_replace(F.element_at(F.split(s, HANG_END), -1), r"^\s+|\s+$", "")
        tidy = F.when(F.startswith(body, F.lit("```")), body).otherwise(F.regexp_replace(body, "\n[ \t]+", "\n"))
        lead = F.when(F.contains(s, F.lit(LEAD_END)), F.substring_index(s, LEAD_END, 1)).otherwise(F.lit(""))
        hang = F.regexp_extract(s, f"{LEAD_END}([^{HANG_END}]*){HANG_END}", 1)
        return F.concat(lead, F.replace(tidy, F.lit("\n"), F.concat(F.lit("\n"), hang)))

    return strip(F.array_join(F.transform(F.split(stream, BLOCK), block), ""))


_TOKENS = {"html": _html_token, "text": _text_token, "md": _md_token}


def _streams(pages: DataFrame, key: str, url: str, html: str, notations: tuple[str, ...]) -> DataFrame:
    """One row per row of `pages` with the token stream of each wanted notation; empty without nodes."""
    parsed = pages.select(F.col(key), U.base_parts(nvl(F.col(url))).alias("__base"), M.parse_events(nvl(F.col(html))).alias("__events"))
    linked = parsed.select(F.col(key), F.transform("__events", lambda e: _linked(e, F.col("__base"))).alias("__events"))
    return linked.select(F.col(key), *[F.array_join(F.transform("__events", _TOKENS[f]), "").alias(f"__{f}") for f in notations])


def extract_content(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", mode: str = "balanced"
) -> DataFrame:
    """One row per row of `pages`: key, normalized_html, clean_text, markdown, metrics.

    Null or empty HTML gives empty strings; a null URL leaves addresses as they are.
    """
    streams = _streams(pages, key, url, html, ("html", "text", "md"))
    bundle = streams.select(
        key,
        F.col("__html").alias("normalized_html"),
        _clean_text(F.col("__text")).alias("clean_text"),
        _markdown(F.col("__md")).alias("markdown"),
    )
    return bundle.withColumn(
        "metrics",
        F.struct(
            F.lit(mode).alias("mode"),
            F.char_length("clean_text").alias("text_length"),
            F.char_length("markdown").alias("markdown_length"),
            F.char_length("normalized_html").alias("normalized_html_length"),
        ),
    )


def clean_html_to_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Clean text only; the tokens of the other notations are not built."""
    return _streams(pages, key, url, html, ("text",)).select(key, _clean_text(F.col("__text")).alias("clean_text"))


def normalize_html(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Normalized HTML only."""
    return _streams(pages, key, url, html, ("html",)).select(key, F.col("__html").alias("normalized_html"))
