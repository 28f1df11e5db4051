"""Queries on pagination."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import paging as P
from pagewright.operators import pagination as G
from pagewright.plans import sql_parts as Q
from pagewright.plans.registry import query

# Each page URL gets one of ten listing forms appended, chosen by page id.
_FORMS = [
    "", "&page=7", "&p=3&q=a%20b", "&pg=x", "&start=20", "&offset=50&limit=25", "&offset=10", "&from=30&size=5",
    "/page/4", "/p9/",
]


def _listing(t):
    bare = F.regexp_replace("url", "[?#].*$", "")
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("page_id") % len(_FORMS) + 1).cast("int"))
    glue = F.when(F.startswith(form, F.lit("&")), F.lit("?k=v")).otherwise(F.lit(""))
    return t.pages.select("page_id", F.concat(bare, glue, form).alias("listing"))


_LISTING_SQL = f"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE WHEN starts_with(f, '&') THEN '?k=v' ELSE '' END || f AS listing
FROM (SELECT *, [{", ".join(Q.quote(f) for f in _FORMS)}][(page_id % {len(_FORMS)} + 1)::INT] AS f FROM pages)"""


def _param(name: str) -> str:
    return f"regexp_extract(listing, '[?&]{name}=([^&]*)', 1)"


def _present(name: str) -> str:
    return f"regexp_matches(listing, '[?&]{name}(=|&|$)')"


_PATH = "regexp_extract(listing, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_INFER_SQL = f"""SELECT page_id, listing, CASE WHEN {_present('offset')} AND {_present('limit')} AND NOT {_present('page')} THEN 'offset_limit'
  WHEN {" OR ".join(_present(p) for p in P.PAGE_PARAMS)} THEN 'url_param'
  WHEN regexp_matches({_PATH}, '/page/[0-9]+/?$|/p[0-9]+/?$|-[0-9]+/?$') THEN 'url_path' END AS type,
  CASE WHEN {_present('offset')} AND {_present('limit')} THEN NULL {" ".join(f"WHEN {_present(p)} THEN '{p}'" for p in P.PAGE_PARAMS)} END AS param,
  CASE WHEN {_present('start')} OR {_present('from')} THEN 10 ELSE 1 END AS step FROM ({_LISTING_SQL})"""


@query("pagination_from_url", f"SELECT page_id, listing, type, param, CASE WHEN type IS NOT NULL THEN step END AS step FROM ({_INFER_SQL})")
def pagination_from_url(t):
    found = _listing(t).withColumn("c", P.infer_from_url(F.col("listing")))
    return found.select("page_id", "listing", "c.type", "c.param", "c.step")


@query(
    "next_page_url",
    f"""SELECT page_id, CASE type
  WHEN 'offset_limit' THEN regexp_replace(listing, 'offset=[0-9]+', 'offset=' || ({_param('offset')}::INT + {_param('limit')}::INT))
  WHEN 'url_param' THEN replace(regexp_replace(listing, '([?&]' || param || '=)[^&]*', '\\1' || (coalesce(try_cast(regexp_extract(listing, '[?&]' || param || '=([^&]*)', 1) AS INT), 0) + step)), '%20', '+')
  WHEN 'url_path' THEN CASE WHEN regexp_matches({_PATH}, '/page/[0-9]+/?$') THEN regexp_replace(listing, '/page/[0-9]+', '/page/' || (regexp_extract({_PATH}, '/page/([0-9]+)/?$', 1)::INT + 1))
    WHEN regexp_matches({_PATH}, '/p[0-9]+/?$') THEN regexp_replace(listing, '/p[0-9]+(/?)$', '/p' || (regexp_extract({_PATH}, '/p([0-9]+)/?$', 1)::INT + 1) || '\\1')
    ELSE regexp_replace(listing, '-[0-9]+(/?)$', '-' || (regexp_extract({_PATH}, '-([0-9]+)/?$', 1)::INT + 1) || '\\1') END END AS next_url
FROM ({_INFER_SQL})""",
)
def next_page_url(t):
    listing = _listing(t)
    return listing.select(
        "page_id", P.next_page_url(F.col("listing"), P.infer_from_url(F.col("listing"))).alias("next_url")
    )


@query(
    "set_limit_param",
    f"""SELECT page_id, CASE WHEN {_present('size')} THEN regexp_replace(listing, 'size=[^&]*', 'size=100')
  ELSE replace(listing, '%20', '+') || CASE WHEN contains(listing, '?') THEN '&' ELSE '?' END || 'size=100' END AS url FROM ({_LISTING_SQL})""",
)
def set_limit_param(t):
    url = P.set_query_param(F.col("listing"), F.lit("size"), F.lit(100))
    return _listing(t).select("page_id", url.alias("url"))


# Paging controls in every form the detector knows, one per page by page id. `{n}` is the page id.
_CONTROLS = [
    "",
    '<div class="pagination"><a href="?start=300">third</a><a href="?start=20">first</a><a href="?start=1000">last</a></div>',
    '<p>shelf eight</p><a rel="next" href="/shelves/nine">on</a>',
    '<section class="mat-paginator">1 until 30 of 77</section>',
    '<a class="next" href="/n">more</a>',
    '<button class="x disabled" aria-label="Next"></button><li class="next"><a href="/2">go</a></li>',
    '<button aria-label="Go to next results page"></button>',
    '<nav aria-label="pagination"><a href="/l/2">2</a><a href="/l/3">3</a></nav>',
    '<button data-testid="load-more">x</button>',
    "<button>Load <b>More</b></button>",
    "<a>see more</a>",
    '<span class="paginate_button">1</span><span class="paginate_button">2</span><i aria-label="previous" disabled></i>',
    "<p>total jobs</p>",
]
# mode, confidence and selector that the control above leads to (before the URL's own score).
_EXPECTED = [
    None, ("url_list", 10, None), ("url_param", 10, None), ("url_param", 9, None), ("next_button", 9, "a.next"),
    ("next_button", 9, "li.next > a"), ("next_button", 9, "button[aria-label='Go to next results page']"),
    None, ("load_more", 8, "[data-testid*='load-more']"), ("load_more", 8, "button:contains('Load More')"),
    ("load_more", 8, ", ".join(G.LOAD_MORE_SELECTORS)), None, None,
]
_SCORES = {7: 4, 11: 5, 12: 2}


def controlled_pages(t):
    control = F.element_at(F.array(*[F.lit(c) for c in _CONTROLS]), (F.col("page_id") % len(_CONTROLS) + 1).cast("int"))
    return t.pages.select("page_id", "url", F.concat("html", control).alias("html"))


_URL_SCORE = "CASE WHEN regexp_matches(url, '[?&](page|p|pg|start|offset|from)=') THEN 3 ELSE 0 END"
_OWN_SCORE = (
    "CASE page_id % 13 WHEN 7 THEN 4 WHEN 11 THEN 5 ELSE 0 END + "
    "CASE WHEN page_id % 13 IN (3, 12) OR contains(lower(html), ' of ') THEN 2 ELSE 0 END"
)


def _case(i: int) -> str:
    return "CASE page_id % 13 " + " ".join(
        f"WHEN {k} THEN {Q.quote(str(e[i])) if isinstance(e[i], str) else ('NULL' if e[i] is None else e[i])}"
        for k, e in enumerate(_EXPECTED)
        if e
    )


@query(
    "page_pagination_struct",
    f"""SELECT page_id, {_case(0)} ELSE CASE WHEN s >= 4 THEN CASE WHEN page_id % 13 IN (7, 11) THEN 'page_numbers' ELSE 'load_more' END ELSE 'none' END END AS mode,
  {_case(1)} ELSE CASE WHEN s >= 4 THEN least(s + 2, 9) ELSE greatest(1, 10 - s) END END AS confidence,
  {_case(2)} END AS next_selector
FROM (SELECT *, {_URL_SCORE} + {_OWN_SCORE} AS s FROM pages)""",
)
def page_pagination_struct(t):
    return G.with_page_pagination(controlled_pages(t)).select("page_id", "paging.mode", "paging.confidence", "paging.next_selector")


@query(
    "page_pagination_urls",
    f"""SELECT page_id, CASE page_id % 13 WHEN 1 THEN b || '?start=20 ' || b || '?start=300 ' || b || '?start=1000' WHEN 2 THEN o || '/shelves/nine' END AS urls,
  CASE page_id % 13 WHEN 7 THEN o || '/l/2 ' || o || '/l/3' ELSE '' END AS numbered
FROM (SELECT page_id, {Q.origin('url')} AS o, regexp_replace(url, '[?#].*$', '') AS b FROM pages)""",
)
def page_pagination_urls(t):
    found = G.with_page_pagination(controlled_pages(t))
    urls = F.coalesce(F.array_join("paging.page_urls", " "), F.col("paging.next_url"))
    return found.select("page_id", urls.alias("urls"), F.array_join("numbered_links", " ").alias("numbered"))


@query("page_pagination_config")
def page_pagination_config(t):
    """Configuration and follow-up action of every page."""
    found = G.with_page_pagination(controlled_pages(t))
    text = F.regexp_replace("html", "<[^>]+>", " ")
    config = G.config_from_page(F.col("paging"), F.col("numbered_links"), text)
    found = found.select("page_id", config.alias("c"))
    return found.select(
        "page_id", "c.type", "c.param", "c.selector", "c.max_pages",
        F.to_json(G.actions_for(F.lit(None), F.col("c"))).alias("actions"),
    )


@query(
    "pagination_stop_rule",
    f"""WITH f AS (SELECT conv_id, turn, sha256(text) AS hash, length({Q.strip('text')}) < 200 AS thin,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations),
g AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY conv_id ORDER BY turn) = hash, false) AS same FROM f),
h AS (SELECT *, coalesce(max((thin OR same)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g)
SELECT conv_id, turn, hash, CASE WHEN thin THEN 'empty' WHEN same THEN 'repeated' ELSE 'continue' END AS outcome
FROM h WHERE ended = 0 AND rn = turn""",
)
def pagination_stop_rule(t):
    return G.stop_rule(t.conversations, "conv_id", "turn", F.col("text"))


@query(
    "listed_page_urls",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, 'https://shop.example/s/' || l_suppkey AS u FROM lineitem),
r AS (SELECT k, u, n, row_number() OVER (PARTITION BY k ORDER BY n, u) AS p FROM l),
f AS (SELECT k, u AS first_url FROM r WHERE p = 1),
c AS (SELECT k, u, min(p) AS p FROM r GROUP BY 1, 2)
SELECT f.k AS l_orderkey, coalesce(string_agg(c.u, ' ' ORDER BY c.p), '') AS urls FROM f LEFT JOIN c ON f.k = c.k AND c.u <> f.first_url GROUP BY 1""",
)
def listed_page_urls(t):
    """Each order's supplier pages as a URL list."""
    url = F.concat(F.lit("https://shop.example/s/"), "l_suppkey")
    orders = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), url.alias("u")))).alias("lines")
    )
    urls = F.transform("lines", lambda x: x["u"])
    rest = G.listed_page_urls(F.element_at(urls, 1), urls)
    return orders.select("l_orderkey", F.array_join(rest, " ").alias("urls"))
