from pyspark.sql import functions as F

from pagewright.operators import pagination as G

JOBS = "https://shop.example/offers"


def configs(spark, cases, max_pages=10):
    """Configuration and findings of each (html, url, text)."""
    df = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, html string, url string, text string")
    found = G.with_page_pagination(df)
    rows = found.select(
        "i", "paging", "numbered_links", G.config_from_page(F.col("paging"), F.col("numbered_links"), F.col("text"), max_pages).alias("c")
    ).collect()
    return [(r.c, r) for r in sorted(rows, key=lambda r: r.i)]


# A control for each selector of the "next" table that no earlier selector finds.
CONTROLS = {
    "[aria-label='Next']": '<i aria-label="Next"></i>',
    "[aria-label='Next page']": '<i aria-label="Next page"></i>',
    "button[aria-label*='Next']": '<button aria-label="To the Next shelf"></button>',
    "a[aria-label*='Next']": '<a aria-label="Next shelf" href="/shelf"></a>',
    ".mat-paginator-navigation-next": '<i class="big mat-paginator-navigation-next"></i>',
    "[class*='pagination'][class*='next']": '<b class="shelf-pagination go-next-one"></b>',
    "[class*='pager'][class*='next']": '<b class="pager nextish"></b>',
    "[data-testid*='next']": '<b data-testid="the-next-one"></b>',
    "[data-cy*='next']": '<b data-cy="nextish"></b>',
    ".next-page": '<b class="next-page"></b>',
    "a.next": '<a class="next">&gt;</a>',
    "li.next > a": '<li class="x next"><a>&gt;</a></li>',
    ".paginate_button.next": '<b class="next paginate_button"></b>',
}


TEXT = "All offers of this week"


def test_next_selectors_in_their_order(spark):
    order = [s for s in G.NEXT_SELECTORS if s in CONTROLS]
    assert order == list(CONTROLS)
    both = [CONTROLS[second] + CONTROLS[first] for first, second in zip(order, order[1:])]
    found = configs(spark, [(html, JOBS, TEXT) for html in [*CONTROLS.values(), *both]])
    assert [(r.paging.mode, r.paging.next_selector) for _, r in found] == [("next_button", s) for s in [*order, *order[:-1]]]


def test_words_of_load_more_buttons(spark):
    pages = [f"<div><button><i></i> {word.upper()} </button></div>" for word in G.LOAD_MORE_WORDS]
    *found, (_, plain) = configs(spark, [(html, JOBS, TEXT) for html in [*pages, "<p>load more</p>"]])
    assert [(c.type, r.paging.mode, r.paging.confidence) for c, r in found] == [("click_append", "load_more", 8)] * len(pages)
    assert plain.paging.mode == "none"  # only controls count


def test_named_next_page(spark):
    (far, row), (near, _) = configs(spark, [
        ('<p>shelf eight</p><a rel="next" href="nine">on</a>', "https://library.example/shelves/eight", TEXT),
        ('<link rel="next" href="?p=5">', "https://library.example/shelves?p=4", TEXT),
    ])
    assert far.next_url == "https://library.example/shelves/nine" and (row.paging.mode, row.paging.confidence) == ("url_param", 10)
    assert (near.type, near.param, near.next_url) == ("url_param", "p", "https://library.example/shelves?p=5")


def test_lists_are_in_the_order_of_their_parameter(spark):
    def page(param, numbers):
        return '<div class="pagination">' + "".join(f'<a href="{JOBS}?{param}={n}">{n}</a>' for n in numbers) + "</div>"

    # A single link is no list.
    cases = [(page(param, (300, 20, 1000)), JOBS, TEXT) for param in G.ORDER_PARAMS] + [(page("start", (20,)), JOBS, TEXT)]
    *found, (_, single) = configs(spark, cases)
    for param, (c, row) in zip(G.ORDER_PARAMS, found):
        assert (c.type, row.paging.confidence, c.page_urls) == ("url_list", 10, [f"{JOBS}?{param}={n}" for n in (20, 300, 1000)])
    assert single.paging.mode != "url_list"


def test_material_range(spark):
    # A range in words makes the page number a parameter; without one the element alone says nothing of the kind.
    shown = '<section class="mat-paginator">1 until 30 of 77</section>'
    (c, row), (_, other) = configs(spark, [(shown, JOBS, TEXT), (shown.replace("1 until 30 of 77", "all"), JOBS, TEXT)])
    assert (c.type, c.param, c.step, row.paging.confidence) == ("url_param", "page", 1, 9) and other.paging.mode != "url_param"


def test_child_selector_and_disabled(spark):
    (_, child), (_, deeper) = configs(spark, [
        ('<button aria-label="Next" disabled></button><ul><li class="next"><a href="/2">x</a></li></ul>', JOBS, TEXT),
        ('<li class="next"><b><a href="/2">x</a></b></li>', JOBS, TEXT),
    ])
    assert child.paging.next_selector == "li.next > a" and deeper.paging.mode == "none"


def test_scroll_and_nothing(spark):
    (long, _), (short, _) = configs(spark, [("<p>x</p>", JOBS, "word " * 151), ("<p>x</p>", JOBS, "word " * 150)])
    assert long.type == "scroll" and short is None


def test_action_for_click(spark):
    ((c, _),) = configs(spark, [('<a class="next" href="/n">more</a>', JOBS, TEXT)])
    df = spark.createDataFrame([(1,)], "i int").select(
        G.actions_for(F.lit(None), F.struct(F.lit(c.type).alias("type"), F.lit(c.selector).alias("selector"), F.lit(7).alias("max_pages"))).alias("a")
    )
    (action,) = df.first().a
    assert (action.kind, action.selector, action.max_iterations, action.wait_ms, action.optional) == (
        "repeat_click_until_stable", "a.next", 7, 2000, True,
    )


def page(url, text, ok=True, html=None):
    return (url, html or f"<p>{text}</p>", text, ok)


def run(spark, seeds, pages, max_pages=20):
    table = spark.createDataFrame(pages, "url string, html string, clean_text string, success boolean")
    rows = G.run_pagination(spark.createDataFrame([(s,) for s in seeds], "seed string"), table, max_pages).collect()
    return sorted((r.seed, r.pos, r.url) for r in rows)


def test_runs_stop_where_they_should(spark):
    long = "text " * 60
    u = lambda i: f"{JOBS}?page={i}"
    pages = [page(u(1), long + "1"), page(u(2), long + "2"), page(u(3), long + "2"), page(u(4), long + "4")]
    assert [p for *_, p in run(spark, [u(1)], pages)] == [u(1), u(2), u(3)]  # 3 repeats 2
    assert [p for *_, p in run(spark, [u(1)], pages, max_pages=2)] == [u(1), u(2)]
    assert [p for *_, p in run(spark, [u(4)], pages)] == [u(4), u(5)]  # 5 is missing, hence failed
    pages[1] = page(u(2), "short")
    assert [p for *_, p in run(spark, [u(1)], pages)] == [u(1), u(2)]


def test_run_from_page_content(spark):
    long = "text " * 60
    listing = '<ul class="pagination"><li><a href="?from=20">3</a></li><li><a href="?from=10">2</a></li></ul>'
    pages = [page(JOBS, "short", html=listing), page(JOBS + "?from=10", long), page(JOBS + "?from=20", long)]
    assert [p for *_, p in run(spark, [JOBS], pages)] == [JOBS, JOBS + "?from=10", JOBS + "?from=20"]
    following = '<link rel="next" href="/offers?start=10">'
    pages = [page(JOBS, "short", html=following), page(JOBS + "?start=10", long + "a"), page(JOBS + "?start=20", long + "b")]
    assert [p for *_, p in run(spark, [JOBS], pages)] == [JOBS, JOBS + "?start=10", JOBS + "?start=20", JOBS + "?start=30"]
    assert [p for *_, p in run(spark, [JOBS], pages, max_pages=2)] == [JOBS, JOBS + "?start=10"]


def test_explicit_type_is_ignored(spark):
    from pagewright.sources.requests import flow, scrape_request

    payload = '{"url": "https://shop.example/offers", "pagination_mode": true, "pagination": {"type": "click_append", "max_pages": 7}}'
    df = spark.createDataFrame([(payload,)], "p string").select(scrape_request(F.col("p")).alias("r"))
    row = df.select(G.requested_pages(F.col("r.pagination"), F.col("r.max_pages")).alias("n"), flow(F.col("r")).alias("f")).first()
    assert (row.n, row.f) == (7, "pagination")
