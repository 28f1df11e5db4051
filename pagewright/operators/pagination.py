"""Pagination inference from page content and traversal over stored page sequences.

Inference works on one page's node array inside its row: no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import paging as P
from pagewright.functions import urls as U
from pagewright.functions.text import let, nvl, strip, try_int, word_count
from pagewright.operators import nodes as N
from pagewright.operators.crawl import Edges, crawl
from pagewright.session import materialize

# Selectors that find a "next page" control, tried in this order.
NEXT_SELECTORS = [
    "a[rel='next']",
    "link[rel='next']",
    "[aria-label='Next']",
    "[aria-label='Next page']",
    "button[aria-label*='Next']",
    "a[aria-label*='Next']",
    ".mat-paginator-navigation-next",
    "button.mat-paginator-navigation-next",
    "[class*='pagination'][class*='next']",
    "[class*='pager'][class*='next']",
    "[data-testid*='next']",
    "[data-cy*='next']",
    ".pagination__next",
    ".pagination-next",
    ".next-page",
    "a.next",
    "li.next > a",
    ".paginate_button.next",
]

# Selectors that find a "load more" control, tried in this order.
LOAD_MORE_SELECTORS = [
    "button:contains('Load More')",
    "button:contains('Show More')",
    "button:contains('See More')",
    "a:contains('Load More')",
    "a:contains('Show More')",
    "[data-testid*='load-more']",
    "[data-cy*='load-more']",
    "[class*='load-more']",
]
LOAD_MORE_WORDS = ["load more", "show more", "see more"]
SHELL_MARKERS = ["items per page", " of ", "total jobs", "mat-paginator"]

# Parameters that mark a page link, and those that order such links.
OFFSET_PARAMS = ["from", "offset", "start", "page", "pg", "p", "cursor", "after", "before"]
ORDER_PARAMS = ["from", "offset", "start", "page", "pg", "p"]

NUMBERED_LINK_SELECTOR = "nav[aria-label*='pagination'] a, .pagination a, ol.page-list a"
MATERIAL_RANGE = r"(?iU)\b1\s*\D+\s*\d+\s+of\s+\d+"
SCROLL_MIN_WORDS = 150
DEFAULT_MAX_PAGES = 20

DETECTION_TYPE = (
    "struct<has_pagination:boolean,mode:string,confidence:int,next_selector:string,param:string,step:int,"
    "next_url:string,page_urls:array<string>,evidence:array<string>>"
)


def _is(name: str, value: str):
    return lambda n: N.attr(n, name) == value


def _has(name: str, part: str):
    return lambda n: F.contains(N.attr_or_empty(n, name), F.lit(part))


def _tag(name: str):
    return lambda n: n["tag"] == name


def _class(name: str):
    return lambda n: N.has_class(n, name)


def _all(*tests):
    def both(n: Column) -> Column:
        result = tests[0](n)
        for test in tests[1:]:
            result = result & test(n)
        return result

    return both


def _any(*tests):
    def either(n: Column) -> Column:
        result = tests[0](n)
        for test in tests[1:]:
            result = result | test(n)
        return result

    return either


_IN_PAGINATION = _has("class", "pagination")
_PAGE_LABEL = lambda n: F.startswith(N.attr_or_empty(n, "aria-label"), F.lit("Page "))
_NUMBER_LINK = _is("data-ph-at-id", "pagination-page-number-link")

# One test per entry of NEXT_SELECTORS; the child selector needs the page and is built later.
_NEXT_TESTS = [
    _all(_tag("a"), _is("rel", "next")),
    _all(_tag("link"), _is("rel", "next")),
    _is("aria-label", "Next"),
    _is("aria-label", "Next page"),
    _all(_tag("button"), _has("aria-label", "Next")),
    _all(_tag("a"), _has("aria-label", "Next")),
    _class("mat-paginator-navigation-next"),
    _all(_tag("button"), _class("mat-paginator-navigation-next")),
    _all(_has("class", "pagination"), _has("class", "next")),
    _all(_has("class", "pager"), _has("class", "next")),
    _has("data-testid", "next"),
    _has("data-cy", "next"),
    _class("pagination__next"),
    _class("pagination-next"),
    _class("next-page"),
    _all(_tag("a"), _class("next")),
    None,
    _all(_class("paginate_button"), _class("next")),
]


def _first(nodes: Column) -> Column:
    return F.try_element_at(nodes, F.lit(1))


def _usable(node: Column) -> Column:
    return let(node, lambda n: n.isNotNull() & ~N.is_disabled(n))


def _numbered_links(elements: Column, texts: Column, base_url: Column) -> Column:
    """Absolute URLs of numbered page links, in document order, repeats kept."""
    boxes = F.filter(
        elements,
        _any(_all(_tag("nav"), _has("aria-label", "pagination")), _IN_PAGINATION, _all(_tag("ol"), _class("page-list"))),
    )

    def is_numbered(a: Column) -> Column:
        digits = r"^\p{Nd}+$"
        return (
            F.startswith(F.lower(N.attr_or_empty(a, "aria-label")), F.lit("page "))
            | N.attr_or_empty(a, "data-ph-at-text").rlike(digits)
            | N.element_text(a, texts).rlike(digits)
        )

    def pick(containers: Column) -> Column:
        anchors = F.filter(
            elements,
            lambda n: (n["tag"] == "a")
            & (N.attr_or_empty(n, "href") != "")
            & (_PAGE_LABEL(n) | _NUMBER_LINK(n).eqNullSafe(True) | N.inside_any(n, containers)),
        )
        return F.transform(F.filter(anchors, is_numbered), lambda a: N.attr(a, "href"))

    hrefs = let(boxes, pick)
    return let(U.base_parts(base_url), lambda base: U.resolve_all(hrefs, base))


def _offset_links(elements: Column, current_url: Column) -> Column:
    """Distinct page links that carry an offset parameter, ordered by its number."""
    boxes = F.filter(elements, _IN_PAGINATION)

    def pick(containers: Column) -> Column:
        anchors = F.filter(
            elements,
            lambda n: (n["tag"] == "a")
            & (N.attr_or_empty(n, "href") != "")
            & (_PAGE_LABEL(n) | _NUMBER_LINK(n).eqNullSafe(True) | N.inside_any(n, containers)),
        )
        return F.transform(anchors, lambda a: N.attr(a, "href"))

    def keys(text: Column) -> Column:
        return F.transform(P.query_keys(P.query_pairs(text)), F.lower)

    def has_offset(url: Column) -> Column:
        found = F.concat(keys(U.query(U.clean(url))), keys(U.fragment(U.clean(url))))
        return F.arrays_overlap(found, F.array(*[F.lit(p) for p in OFFSET_PARAMS]))

    def order(url: Column) -> Column:
        def number(pairs: Column) -> Column:
            firsts = [F.try_element_at(P.values_of(pairs, p), F.lit(1)) for p in ORDER_PARAMS]
            return F.coalesce(try_int(F.coalesce(*firsts)), F.lit(0).cast("bigint"))

        return let(P.query_pairs(U.query(U.clean(url))), number)

    hrefs = let(boxes, pick)
    urls = F.array_distinct(let(U.base_parts(current_url), lambda base: U.resolve_all(hrefs, base)))
    kept = F.filter(urls, lambda u: (u != current_url) & has_offset(u))
    ranked = F.array_sort(F.transform(kept, lambda u, i: F.struct(order(u).alias("n"), i.alias("i"), u.alias("url"))))
    return F.transform(ranked, lambda r: r["url"])


def _aria_selector(node: Column) -> Column:
    label = F.replace(F.replace(N.attr(node, "aria-label"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    name = F.when(node["tag"].isin("button", "a"), node["tag"]).otherwise(F.lit(""))
    return F.concat(name, F.lit("[aria-label='"), label, F.lit("']"))


def _next_selector(elements: Column) -> Column:
    """First selector of the table whose first match is not disabled."""

    def hinted(n: Column) -> Column:
        marks = F.concat_ws(" ", *[N.attr(n, a) for a in ("rel", "aria-label", "class", "data-testid", "data-cy")])
        return F.contains(F.lower(marks), F.lit("next"))

    def choose(candidates: Column) -> Column:
        options = []
        for selector, test in zip(NEXT_SELECTORS, _NEXT_TESTS):
            if test is None:
                items = F.filter(candidates, _all(_tag("li"), _class("next")))
                found = F.filter(
                    elements, lambda n: (n["tag"] == "a") & F.exists(items, lambda li: li["id"] == n["parent"])
                )
            else:
                found = F.filter(candidates, test)
            options.append(F.when(_usable(_first(found)), F.lit(selector)))
        # Nearly every page has no candidate at all; then nothing else is evaluated.
        return F.coalesce(*options)

    return let(F.filter(elements, hinted), lambda c: F.when(F.size(c) > 0, choose(c)))


def _next_label(elements: Column) -> Column:
    """First enabled element whose label speaks of the next page."""

    def speaks(n: Column) -> Column:
        label = F.lower(N.attr_or_empty(n, "aria-label"))
        return F.contains(label, F.lit("next")) & F.contains(label, F.lit("page")) & ~N.is_disabled(n)

    return _first(F.filter(elements, speaks))


def _load_more(elements: Column, texts: Column) -> Column:
    """Evidence of a "load more" control: its selector, 'text' for a plain button, or NULL."""
    joined = F.array_join(F.transform(texts, lambda t: t["text"]), "")

    def with_text(tag: str, words: str) -> Column:
        def holds(n: Column) -> Column:
            whole = F.array_join(F.transform(F.filter(texts, lambda t: N.inside(t, n)), lambda t: t["text"]), "")
            return (n["tag"] == tag) & F.contains(whole, F.lit(words))

        return F.when(F.contains(joined, F.lit(words)), _first(F.filter(elements, holds)))

    options = []
    for selector in LOAD_MORE_SELECTORS:
        if ":contains" in selector:
            tag, words = selector.split(":contains(")
            found = with_text(tag, words.strip("')"))
        else:
            name, part = selector.strip("[]").split("*=")
            found = _first(F.filter(elements, _has(name, part.strip("'"))))
        options.append(F.when(_usable(found), F.lit(selector)))
    squeezed = F.lower(F.array_join(F.transform(texts, lambda t: strip(t["text"])), ""))
    plain = F.filter(
        elements, lambda n: n["tag"].isin("button", "a") & F.lower(N.element_text(n, texts)).isin(LOAD_MORE_WORDS)
    )
    mentioned = F.lit(False)
    for words in LOAD_MORE_WORDS:
        mentioned = mentioned | F.contains(squeezed, F.lit(words))
    options.append(F.when(mentioned & _usable(_first(plain)), F.lit("text")))
    return F.coalesce(*options)


def _page_buttons(elements: Column) -> Column:
    def count(lists: Column) -> Column:
        items = F.filter(elements, lambda n: (n["tag"] == "li") & N.inside_any(n, lists))
        return let(
            items,
            lambda li: F.size(
                F.filter(
                    elements,
                    lambda n: _class("paginate_button")(n)
                    | _has("class", "page-number")(n)
                    | _has("class", "pageNumber")(n)
                    | _has("aria-label", "Page ")(n)
                    | ((n["tag"] == "a") & N.inside_any(n, li)),
                )
            ),
        )

    return let(F.filter(elements, _all(_tag("ul"), _class("pagination"))), count)


def _result(mode: str | Column, confidence: int | Column, evidence: list[Column], **fields: Column) -> Column:
    null = F.lit(None)
    found = {
        "has_pagination": F.lit(True),
        "mode": F.lit(mode) if isinstance(mode, str) else mode,
        "confidence": F.lit(confidence) if isinstance(confidence, int) else confidence,
        "next_selector": null,
        "param": null,
        "step": null,
        "next_url": null,
        "page_urls": null,
        "evidence": F.filter(F.array(*evidence), lambda e: e.isNotNull()),
    }
    found.update(fields)
    return F.struct(*[c.alias(n) for n, c in found.items()]).cast(DETECTION_TYPE)


def with_page_pagination(pages: DataFrame, url: str = "url", html: str = "html", out: str = "paging") -> DataFrame:
    """Add `out`: how the page continues, found by a fixed chain of tests of falling confidence."""
    page_url = nvl(F.col(url))
    step = N.with_nodes(pages, html, "__nodes")
    step = step.withColumns(
        {
            "__els": F.filter("__nodes", lambda n: n["kind"] == N.ELEMENT),
            "__texts": F.filter("__nodes", lambda n: n["kind"].isin(N.TEXT, N.HIDDEN)),
        }
    )
    els, texts = F.col("__els"), F.col("__texts")
    rel_next = _first(
        F.filter(
            els,
            lambda n: n["tag"].isin("link", "a") & (N.attr(n, "rel") == "next") & N.attr(n, "href").isNotNull(),
        )
    )
    page_text = F.array_join(
        F.filter(
            F.transform(F.filter(texts, lambda t: t["kind"] == N.TEXT), lambda t: strip(t["text"])), lambda s: s != ""
        ),
        " ",
    )
    material = F.exists(els, _any(_tag("mat-paginator"), _class("mat-paginator"))) & page_text.rlike(MATERIAL_RANGE)
    step = step.withColumns(
        {
            "__offset": _offset_links(els, page_url),
            "__rel": F.nullif(N.attr(rel_next, "href"), F.lit("")),
            "__numbered": _numbered_links(els, texts, page_url),
        }
    )
    # Each later test runs only where the earlier ones found nothing.
    open_question = (F.size("__offset") < 2) & F.col("__rel").isNull()
    step = step.withColumns(
        {
            "__rel_url": F.when(F.col("__rel").isNotNull(), U.resolve(F.col("__rel"), page_url)),
            "__material": F.when(open_question, material),
            "__selector": F.when(open_question, _next_selector(els)),
            "__buttons": _page_buttons(els),
            "__more": F.when(open_question, _load_more(els, texts)),
            "__prev_off": F.exists(
                els, lambda n: F.contains(F.lower(N.attr_or_empty(n, "aria-label")), F.lit("prev")) & N.is_disabled(n)
            ),
            "__shell": F.exists(
                F.array(*[F.lit(m) for m in SHELL_MARKERS]), lambda m: F.contains(F.lower(nvl(F.col(html))), m)
            ),
        }
    )
    # The page's own URL and the one it names go through the same inference.
    inferred = F.transform(F.array(page_url, F.col("__rel_url")), P.infer_from_url)
    step = step.withColumns(
        {
            "__inferred": inferred,
            "__label": F.when(open_question & F.col("__selector").isNull(), _next_label(els)),
        }
    ).withColumns(
        {
            "__url_type": F.element_at("__inferred", 1)["type"],
            "__rel_config": F.when(F.col("__rel_url").isNotNull(), F.element_at("__inferred", 2)),
        }
    )
    n_numbered, buttons = F.size("__numbered"), F.col("__buttons")
    offset, selector, label, more = (F.col(c) for c in ("__offset", "__selector", "__label", "__more"))
    score = (
        F.when(F.col("__url_type").isNotNull(), 3).otherwise(0)
        + F.when(n_numbered > 0, 4).otherwise(0)
        + F.when(buttons >= 2, 3).otherwise(0)
        + F.when(F.col("__prev_off"), 2).otherwise(0)
        + F.when(F.col("__shell"), 2).otherwise(0)
    )
    early = [
        F.concat(F.lit("url pattern: "), F.col("__url_type")),
        F.when(n_numbered > 0, F.concat(F.lit("numbered href links: "), n_numbered, F.lit(" found"))),
        F.when(buttons >= 2, F.concat(F.lit("numbered page buttons: "), buttons, F.lit(" found"))),
        F.when(F.col("__prev_off"), F.lit("disabled previous button")),
    ]
    shell = F.when(F.col("__shell"), F.lit("pagination text/shell marker"))
    rel_config = F.col("__rel_config")
    result = (
        F.when(
            F.size(offset) >= 2,
            _result(
                "url_list", 10, [F.concat(F.lit("offset page links in DOM: "), F.size(offset), F.lit(" found"))],
                page_urls=offset,
            ),
        )
        .when(
            F.col("__rel").isNotNull(),
            _result(
                "url_param", 10, [F.concat(F.lit("rel=next href: "), F.col("__rel_url"))],
                param=F.coalesce(rel_config["param"], F.lit("page")),
                step=F.coalesce(rel_config["step"], F.lit(1)),
                next_url=F.col("__rel_url"),
            ),
        )
        .when(
            F.col("__material"),
            _result(
                "url_param", 9, [F.lit("material paginator range supports page query")], param=F.lit("page"), step=F.lit(1)
            ),
        )
        .when(
            selector.isNotNull(),
            _result("next_button", 9, [F.concat(F.lit("selector match: "), selector)], next_selector=selector),
        )
        .when(
            label.isNotNull(),
            _result(
                "next_button", 9, [F.concat(F.lit("aria wildcard: "), N.attr(label, "aria-label"))],
                next_selector=_aria_selector(label),
            ),
        )
        .when(
            more == "text",
            _result(
                "load_more", 8, [*early, F.lit("load-more text button")], next_selector=F.lit(", ".join(LOAD_MORE_SELECTORS))
            ),
        )
        .when(
            more.isNotNull(),
            _result("load_more", 8, [*early, F.concat(F.lit("load-more selector match: "), more)], next_selector=more),
        )
        .when(
            score >= 4,
            _result(
                F.when((n_numbered > 0) | (buttons >= 2), F.lit("page_numbers")).otherwise(F.lit("load_more")),
                F.least(score + 2, F.lit(9)),
                [*early, shell],
            ),
        )
        .otherwise(
            _result("none", F.greatest(F.lit(1), F.lit(10) - score), [*early, shell], has_pagination=F.lit(False))
        )
    )
    step = step.withColumn(out, result).withColumn("numbered_links", F.col("__numbered"))
    return step.drop(*[c for c in step.columns if c.startswith("__") and c not in pages.columns])


def config_from_page(
    paging: Column, numbered_links: Column, clean_text: Column, max_pages: Column | int = DEFAULT_MAX_PAGES
) -> Column:
    """Pagination configuration of a first page (a `config` struct), or NULL to stop at it."""
    limit = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    mode = paging["mode"]
    every_next = F.lit(", ".join(NEXT_SELECTORS))
    return (
        F.when(
            ~paging["has_pagination"],
            F.when(word_count(nvl(clean_text)) > SCROLL_MIN_WORDS, P.config(type=F.lit("scroll"), max_pages=limit)),
        )
        .when(
            mode == "url_list",
            P.config(
                type=F.lit("url_list"), max_pages=limit,
                page_urls=F.coalesce(paging["page_urls"], F.array().cast("array<string>")),
            ),
        )
        .when(
            mode == "url_param",
            P.config(
                type=F.lit("url_param"),
                param=F.coalesce(F.nullif(paging["param"], F.lit("")), F.lit("page")),
                step=F.coalesce(F.nullif(paging["step"], F.lit(0)), F.lit(1)),
                max_pages=limit,
                next_url=paging["next_url"],
            ),
        )
        .when(
            mode == "next_button",
            P.config(type=F.lit("click_next"), selector=F.coalesce(paging["next_selector"], every_next), max_pages=limit),
        )
        .when(
            (mode == "page_numbers") & (F.size(numbered_links) > 0),
            P.config(
                type=F.lit("numbered_links"), selector=F.lit(NUMBERED_LINK_SELECTOR), mode=F.lit("href"), max_pages=limit
            ),
        )
        .when(mode == "page_numbers", P.config(type=F.lit("click_next"), selector=every_next, max_pages=limit))
        .when(
            mode == "load_more",
            P.config(type=F.lit("click_append"), selector=F.lit(", ".join(LOAD_MORE_SELECTORS)), max_pages=limit),
        )
    )


ACTION_TYPE = (
    "struct<kind:string,selector:string,value:string,timeout_ms:int,optional:boolean,notes:string,"
    "max_iterations:int,wait_ms:int,scroll_step_px:int>"
)


def actions_for(actions: Column, paging: Column) -> Column:
    """Requested actions plus the one that a click or scroll pagination calls for."""
    kind = (
        F.when(paging["type"] == "click_append", F.lit("repeat_click_append"))
        .when(paging["type"] == "click_next", F.lit("repeat_click_until_stable"))
        .when(paging["type"] == "scroll", F.lit("scroll_until_stable"))
    )
    given = F.coalesce(actions, F.array().cast(f"array<{ACTION_TYPE}>"))
    extra = F.struct(
        kind.alias("kind"), paging["selector"].alias("selector"), F.lit(None).cast("string").alias("value"),
        F.lit(5000).alias("timeout_ms"), F.lit(True).alias("optional"), F.lit("").alias("notes"),
        paging["max_pages"].alias("max_iterations"), F.lit(2000).alias("wait_ms"), F.lit(800).alias("scroll_step_px"),
    ).cast(ACTION_TYPE)
    return F.when(kind.isNotNull(), F.array_append(given, extra)).otherwise(given)


def requested_pages(configured: Column, engine_max_pages: Column | int) -> Column:
    """Page limit of a pagination request: only the limit of an explicit configuration counts."""
    engine = F.lit(engine_max_pages) if isinstance(engine_max_pages, int) else engine_max_pages
    return F.when(configured.isNotNull(), configured["max_pages"]).otherwise(F.least(engine, F.lit(DEFAULT_MAX_PAGES)))


def listed_page_urls(first_url: Column, page_urls: Column, max_pages: Column | int | None = None) -> Column:
    """URLs fetched after the first page of a URL list: all, or the first max_pages - 1; repeats skipped."""
    if max_pages is None:
        return F.filter(F.array_distinct(page_urls), lambda u: u != first_url)
    limit = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    cut = F.slice(page_urls, F.lit(1), F.greatest(limit - 1, F.lit(0)))
    return F.filter(F.array_distinct(cut), lambda u: u != first_url)


def numbered_page_urls(first_url: Column, links: Column, max_pages: Column | int) -> Column:
    """As `listed_page_urls`; a repeated link still uses up its position, so the order of the cut is the same."""
    return listed_page_urls(first_url, links, max_pages)


def stop_rule(
    sequence: DataFrame,
    key: str,
    index: str,
    text: Column,
    success: Column | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """Pages of each stored sequence that a URL pagination run would return.

    `index` is the page's 0-based place. A run ends with (and includes) a failed page, a page
    with under 200 characters of text, or one that repeats the page before it. A page limit,
    if there is one, is applied before the shuffle, and only hashes and flags are shuffled, not text.
    """
    ok = F.coalesce(success, F.lit(True)) if success is not None else F.lit(True)
    flags = sequence if max_pages is None else sequence.filter(F.col(index) < max(1, max_pages))
    flags = flags.select(
        key, index, U.content_hash(text).alias("hash"), (~ok).alias("__failed"), P.is_effectively_empty(text).alias("__thin")
    )
    order = W.partitionBy(key).orderBy(index)
    flags = flags.withColumn("__same", F.coalesce(F.lag("hash").over(order) == F.col("hash"), F.lit(False)))
    flags = flags.withColumn("__gap", F.col(index) != F.row_number().over(order) - 1)
    stops = (F.col("__failed") | F.col("__thin") | F.col("__same")).cast("int")
    ended = F.max(stops).over(order.rowsBetween(W.unboundedPreceding, -1))
    reason = (
        F.when(F.col("__failed"), F.lit("failed"))
        .when(F.col("__thin"), F.lit("empty"))
        .when(F.col("__same"), F.lit("repeated"))
        .otherwise(F.lit("continue"))
    )
    kept = flags.withColumn("__ended", F.coalesce(ended, F.lit(0))).filter((F.col("__ended") == 0) & ~F.col("__gap"))
    return kept.select(key, index, "hash", reason.alias("outcome"))


def url_sequence(first_url: Column, paging: Column, max_pages: Column) -> Column:
    """URLs of a URL-driven run, in order: they follow from the first URL alone.

    The sequence ends where there is no next URL or it repeats an earlier one.
    """

    def extend(urls: Column, _: Column) -> Column:
        return let(
            P.next_page_url(F.element_at(urls, -1), paging),
            lambda u: F.when(u.isNull() | F.array_contains(urls, u), urls).otherwise(F.array_append(urls, u)),
        )

    steps = F.when(max_pages > 1, F.sequence(F.lit(2), max_pages)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(first_url), extend)


def plan_pagination(first_pages: DataFrame, max_pages: int | None, run: str = "seed") -> DataFrame:
    """What a pagination run would fetch: run, seed, urls (first page included), rule.

    `first_pages`: run, seed, html, clean_text, success of each start URL and optionally its own
    max_pages, which goes before the argument; a run needs one of the two, as URLs that count up have no end. html is NULL where
    the snapshot has no such page. rule is 'chain' (runs until a stop condition, from the first
    page), 'tail' (the same, but the first page is kept anyway) or 'list' (all URLs).
    """
    own = F.col("max_pages") if "max_pages" in first_pages.columns else F.lit(None)
    seed, limit = F.col("seed"), F.coalesce(own.cast("int"), F.lit(max_pages).cast("int"), F.raise_error(F.lit("a pagination run needs max_pages")).cast("int"))
    pages = with_page_pagination(first_pages, url="seed")
    pages = pages.withColumn("__by_url", P.infer_from_url(seed))
    pages = pages.withColumn(
        "__config", config_from_page(F.col("paging"), F.col("numbered_links"), F.col("clean_text"), limit)
    )
    config, by_url, ok = F.col("__config"), F.col("__by_url"), F.coalesce(F.col("success"), F.lit(False))
    # One sequence expression serves both rules: URL-driven runs start at the first page, others
    # at the next URL the page names (or at the one that follows from the parameter).
    named = F.nullif(config["next_url"], F.lit(""))
    pages = pages.withColumns(
        {
            "__driver": F.coalesce(by_url, config),
            "__start": F.when(by_url.isNotNull() | named.isNull(), seed).otherwise(named),
        }
    )
    steps = limit - F.when(F.col("__start") == seed, 0).otherwise(1)
    pages = pages.withColumn("__sequence", F.when(
        by_url.isNotNull() | (ok & (config["type"] == "url_param")), url_sequence(F.col("__start"), F.col("__driver"), steps)
    ))
    tail = F.filter("__sequence", lambda u: u != seed)
    urls = (
        F.when(by_url.isNotNull(), F.col("__sequence"))
        .when(~ok, F.array(seed))
        .when(
            config["type"] == "url_list",
            F.concat(F.array(seed), listed_page_urls(seed, config["page_urls"], limit)),
        )
        .when(
            config["type"] == "numbered_links",
            F.concat(F.array(seed), numbered_page_urls(seed, F.col("numbered_links"), limit)),
        )
        .when(
            (config["type"] == "url_param") & (limit > 1), F.concat(F.array(seed), tail)
        )
        .otherwise(F.array(seed))
    )
    rule = (
        F.when(by_url.isNotNull(), F.lit("chain")).when(ok & (config["type"] == "url_param"), F.lit("tail")).otherwise(F.lit("list"))
    )
    return pages.select(*dict.fromkeys([run, "seed"]), urls.alias("urls"), rule.alias("rule"))


def run_pagination(seeds: DataFrame, pages: DataFrame, max_pages: int | None, run: str = "seed") -> DataFrame:
    """Pages that a pagination run from each seed returns: run, seed, pos, url, depth, success.

    `run` is the column of `seeds` that tells runs apart. `pages`: url, html, clean_text, success. All URLs of a run are known beforehand, so one join
    replaces the fetch loop; stop rules are then applied to hashes of the joined pages.
    """
    limits = ["max_pages"] if "max_pages" in seeds.columns else []
    keys = list(dict.fromkeys([run, "seed"]))
    seeds = materialize(seeds, "seeds")
    # Only the pages that a run asks for are moved and hashed.
    facts = pages.join(seeds.select(F.col("seed").alias("url")).distinct(), "url", "left_semi")
    facts = facts.select(F.col("url").alias("seed"), "html", "clean_text", "success")
    first = seeds.select(*keys, *limits).dropDuplicates([run]).join(facts, "seed", "left")
    plan = plan_pagination(first, max_pages, run)
    wanted = materialize(plan.select(*keys, "rule", F.posexplode_outer("urls").alias("pos", "url")), "wanted")
    content = F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.col("html"))
    facts = pages.join(wanted.select("url").distinct(), "url", "left_semi").select(
        "url", "success", U.content_hash(content).alias("__hash"), P.is_effectively_empty(F.col("clean_text")).alias("__thin")
    )
    fetched = wanted.join(facts, "url", "left").withColumn("success", F.coalesce("success", F.lit(False)))
    order = W.partitionBy(run).orderBy("pos")
    same = F.coalesce(F.lag("__hash").over(order) == F.col("__hash"), F.lit(False))
    fetched = fetched.withColumn("__same", same)
    thin = F.col("__thin") & ((F.col("rule") == "chain") | (F.col("pos") > 0))
    stop = (F.col("rule") != "list") & (~F.col("success") | F.coalesce(thin, F.lit(False)) | F.col("__same"))
    ended = F.max(stop.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = fetched.withColumn("__ended", F.coalesce(ended, F.lit(0))).filter("__ended = 0")
    return kept.select(*keys, "pos", "url", F.col("pos").alias("depth"), "success")


def crawl_with_pagination(
    seeds: DataFrame,
    pages: DataFrame,
    edges: Edges,
    max_pages: int | None,
    max_depth: int | None,
    pagination_pages: int | None,
    run: str = "seed",
) -> DataFrame:
    """Pagination pages of each run followed by a crawl that starts from their links: run, seed, url, depth, stage, position.

    `seeds` may carry their own `max_pages`, `max_depth` and `pagination_pages`, which go before the arguments.
    """
    own = F.col("pagination_pages") if "pagination_pages" in seeds.columns else F.lit(pagination_pages).cast("int")
    keys = list(dict.fromkeys([run, "seed"]))
    paged = materialize(run_pagination(seeds.select(*keys, own.alias("max_pages")), pages, pagination_pages, run), "paged")
    rest = crawl(seeds, edges, pages.select("url", "success"), max_pages, max_depth, initial=paged, run=run)
    return (
        paged.select(*keys, "url", "depth", F.lit("pagination").alias("stage"), F.col("pos").alias("position"))
        .unionByName(rest.select(*keys, "url", "depth", F.lit("crawl").alias("stage"), "position"))
    )
