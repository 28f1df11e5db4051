"""Link extraction. Everything per page stays in one row: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.functions.text import let, nvl, strip
from pagewright.operators import nodes as N
from pagewright.operators.nodes import ELEMENT, read_nodes
from pagewright.session import materialize

# Fixed value: attribute scan used where no parsed tree is wanted.
HREF_PATTERN = r"""(?i)href=["']([^"'#\s][^"']*)["']"""


@F.udtf(returnType="pos int, href string")
class PageHrefs:
    """Table function for lateral joins: the non-empty href values of a page's anchors with their places, in document order.

    A null or empty page has no rows. Registered under a name, it serves SQL: `FROM pages, LATERAL page_hrefs(html)`.
    """

    def eval(self, html: str):
        place = 0
        for _, _, kind, tag, attrs, _ in read_nodes(html or ""):
            href = dict(attrs).get("href") if kind == ELEMENT and tag == "a" else None
            if href:
                yield place, href
                place += 1


def hrefs_by_pattern(html: Column) -> Column:
    """href values of any tag, in document order, found without parsing."""
    return F.regexp_extract_all(nvl(html), F.lit(HREF_PATTERN), F.lit(1))


def placed_links(hrefs: Column, base_url: Column, same_domain_only: bool = True) -> Column:
    """Crawlable absolute URLs of one page, `(pos, dst)`, repeats included; pos is the 0-based place among all hrefs."""
    numbered = F.transform(hrefs, lambda h, i: F.struct(i.alias("pos"), h.alias("href")))
    usable = F.filter(numbered, lambda x: U.is_valid_href(x["href"]))

    def finish(base: Column) -> Column:
        absolute = F.transform(U.resolve_all(F.transform(usable, lambda x: strip(x["href"])), base["parts"]), U.page_url)
        kept = F.filter(F.zip_with(usable, absolute, lambda x, u: F.struct(x["pos"].alias("pos"), u.alias("dst"))), lambda x: x["dst"].isNotNull())
        return F.filter(kept, lambda x: U.same_domain(U.base_domain(x["dst"]), base["domain"])) if same_domain_only else kept

    base = F.struct(U.base_parts(base_url).alias("parts"), U.base_domain(base_url).alias("domain"))
    return F.when(nvl(base_url) != "", let(base, finish))


def url_edges(pages: DataFrame) -> DataFrame:
    """Distinct links of each URL: src, dst, pos, the first place of the link on any page of that URL."""
    found = N.with_nodes(pages).select(F.col("url").alias("src"), placed_links(N.dom_hrefs(F.col("nodes")), F.col("url")).alias("links"))
    return found.select("src", F.inline("links")).groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def page_links(
    hrefs: Column, base_url: Column, same_domain_only: bool = True, max_links: int | None = None
) -> Column:
    """Crawlable absolute URLs of one page: valid, resolved, distinct in first-seen order.

    `max_links` is a limit per page; without it all links are kept.
    """
    usable = F.transform(F.filter(hrefs, U.is_valid_href), strip)

    def finish(base: Column) -> Column:
        absolute = F.transform(U.resolve_all(usable, base["parts"]), U.page_url)
        kept = F.filter(absolute, lambda u: u.isNotNull())
        if same_domain_only:
            kept = F.filter(kept, lambda u: U.same_domain(U.base_domain(u), base["domain"]))
        return F.array_distinct(kept)

    base = F.struct(U.base_parts(base_url).alias("parts"), U.base_domain(base_url).alias("domain"))
    links = let(base, finish)
    links = F.when(nvl(base_url) == "", F.array().cast("array<string>")).otherwise(links)
    return links if max_links is None else F.slice(links, 1, max_links)


def extract_links(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    out: str = "links",
    same_domain_only: bool = True,
    max_links: int | None = None,
    by_pattern: bool = False,
) -> DataFrame:
    """Add an array of links: those of the anchors in the parsed page, or of any href found by the attribute scan."""
    if by_pattern:
        return pages.withColumn(out, page_links(hrefs_by_pattern(F.col(html)), F.col(url), same_domain_only, max_links))
    found = N.with_nodes(pages, html, "__nodes")
    return found.withColumn(out, page_links(N.dom_hrefs(F.col("__nodes")), F.col(url), same_domain_only, max_links)).drop("__nodes")


def link_edges(pages_with_links: DataFrame, url: str = "url", links: str = "links") -> DataFrame:
    """One row per link: src, pos (0-based order on the page), dst."""
    # The outer form keeps the optimizer from computing the array once more for an inferred filter.
    edges = pages_with_links.select(F.col(url).alias("src"), F.posexplode_outer(links).alias("pos", "dst"))
    return edges.filter(F.col("dst").isNotNull())


def edges_of(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For `crawl`: the links of a table of `url`s, read on those of the `pages(url, html)` alone.

    A crawl parses what it fetches, however large the snapshot is.
    """

    def read(urls: DataFrame) -> DataFrame:
        # Written, so that its true size is known and the pages' HTML is not shuffled for a few URLs.
        fetched = pages.select("url", "html").join(materialize(urls, "fetched"), "url", "left_semi")
        return link_edges(extract_links(fetched))

    return read


def subdomain_pairs(hosts: DataFrame, host: str = "host", key: str = "n") -> DataFrame:
    """Pairs (host, base_host) where host equals base_host or lies below it.

    `hosts` must be distinct on `host`. The suffix test becomes an equi-join on
    exploded parent domains, so work grows with hosts x labels, not hosts squared.
    """
    bases = hosts.select(F.col(host).alias("base_host"))
    listed = hosts.select(F.col(host).alias("host"), F.col(key), U.host_suffixes(F.col(host)).alias("suffixes"))
    expanded = listed.select("host", key, F.explode_outer("suffixes").alias("base_host"))
    return expanded.join(bases, "base_host")
