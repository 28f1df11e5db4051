"""Queries on URLs, hashes and links."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import links as L
from pagewright.plans import sql_parts as Q
from pagewright.plans.registry import query

_EXT = "|".join(e.replace(".", r"\.") for e in U.SKIP_EXTENSIONS)
_HREFS = f"regexp_extract_all(html, {Q.quote(L.HREF_PATTERN.replace('(?i)', ''))}, 1, 'i')"
_EDGES = f"SELECT url, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) - 1 AS pos FROM pages"


@query(
    "url_base_domain",
    f"SELECT url, {Q.base_domain('url')} AS base_domain, "
    f"regexp_replace(lower(regexp_extract(url, '{Q.AUTHORITY}', 1)), '^www\\.', '') AS strict_domain FROM pages",
)
def url_base_domain(t):
    url = F.col("url")
    return t.pages.select(
        "url", U.base_domain(url).alias("base_domain"), U.base_domain(url, strict_www=True).alias("strict_domain")
    )


@query(
    "url_folder_id",
    "SELECT url, replace(split_part(list_extract(string_split(url, '//'), -1), '/', 1), '.', '_') || '_' || "
    "substr(md5(url), 1, 8) AS folder FROM pages",
)
def url_folder_id(t):
    return t.pages.select("url", U.url_folder(F.col("url")).alias("folder"))


@query(
    "crawl_folder_name",
    "SELECT event_id, 'www_example_org_crawl_' || strftime(ts, '%Y%m%d_%H%M%S') AS folder FROM events",
)
def crawl_folder_name(t):
    return t.events.select(
        "event_id", U.crawl_folder(F.lit("https://www.example.org/start"), F.col("ts")).alias("folder")
    )


@query("url_strip_fragment", "SELECT url, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?$', '') AS clean_url FROM pages")
def url_strip_fragment(t):
    return t.pages.select("url", U.drop_fragment(F.col("url")).alias("clean_url"))


@query(
    "url_extension_filter",
    f"""SELECT p_partkey, link, regexp_matches(split_part(split_part(link, '#', 1), '?', 1), '({_EXT})$', 'i') AS skipped
FROM (SELECT p_partkey, 'https://shop.example/' || p_partkey || [{", ".join(Q.quote(e) for e in U.SKIP_EXTENSIONS)},
  '.html', '', '/page', '.PDF'][(p_partkey % {len(U.SKIP_EXTENSIONS) + 4} + 1)::INT] || '?v=' || p_size AS link FROM part)""",
)
def url_extension_filter(t):
    endings = [*U.SKIP_EXTENSIONS, ".html", "", "/page", ".PDF"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("p_partkey") % len(endings) + 1).cast("int"))
    link = F.concat(F.lit("https://shop.example/"), "p_partkey", ending, F.lit("?v="), "p_size")
    return t.part.select("p_partkey", link.alias("link")).withColumn("skipped", U.has_skip_extension(F.col("link")))


@query(
    "href_regex_links",
    f"SELECT url, len({_HREFS}) AS n, array_to_string({_HREFS}, ' ') AS hrefs FROM pages",
)
def href_regex_links(t):
    hrefs = L.hrefs_by_pattern(F.col("html"))
    return t.pages.select("url", F.size(hrefs).alias("n"), F.array_join(hrefs, " ").alias("hrefs"))


# Every href of every page is rewritten to one of ten reference forms, by its position.
_FORMS = [
    ("concat('mailto:me@x.example', h)", None),
    ("concat('#', h)", None),
    ("h", "o || h"),
    ("concat('https://other.example', h)", None),
    ("concat('https://sub.', a, h, '#top')", "'https://sub.' || a || h"),
    ("concat('//', a, h)", "split_part(o, ':', 1) || '://' || a || h"),
    ("concat('?page=', i)", "o || regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || '?page=' || i"),
    ("concat('.', h)", "o || regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*/)[^/?#]*', 1) || substr(h, 2)"),
    ("concat('..', h)", "o || coalesce(nullif(regexp_extract(u, '^[A-Za-z]+://[^/?#]*(/[^?#]*/)[^/?#]+/[^/?#]*(?:[?#].*)?$', 1), ''), '/') || substr(h, 2)"),
    ("concat(h, '.pdf')", None),
]
_REF_SQL = " ".join(
    f"WHEN {i} THEN {f}" for i, (f, _) in enumerate(_FORMS)
)
_ABS_SQL = " ".join(f"WHEN {i} THEN {e or 'NULL'}" for i, (_, e) in enumerate(_FORMS))


_REFS_CTE = f"""WITH e AS ({_EDGES}),
x AS (SELECT url AS u, pos AS i, href AS h, {Q.origin('url')} AS o, ltrim(regexp_extract(url, '{Q.AUTHORITY}', 1), 'w.') AS a FROM e),
refs AS (SELECT *, (i + length(h)) % {len(_FORMS)} AS form,
  CASE (i + length(h)) % {len(_FORMS)} {_REF_SQL} END AS ref FROM x)"""


def _references(t):
    edges = t.pages.select(
        F.col("url").alias("u"),
        U.drop_www_chars(U.netloc(F.col("url"))).alias("a"),
        F.posexplode(L.hrefs_by_pattern(F.col("html"))).alias("i", "h"),
    ).withColumn("__form", (F.col("i") + F.char_length("h")) % len(_FORMS))
    return edges.select(
        F.col("u").alias("url"), F.col("i").alias("pos"), F.expr("CASE __form " + _REF_SQL + " END").alias("ref")
    )


@query(
    "link_resolve_abs",
    f"{_REFS_CTE} SELECT u AS url, i AS pos, ref, CASE form {_ABS_SQL} END AS link FROM refs",
)
def link_resolve_abs(t):
    """Filter, resolve and same-domain-check every reference form."""
    refs = _references(t)
    link = U.normalize_href(F.col("ref"), F.col("url"))
    linked = refs.withColumn("link", F.when(U.is_valid_href(F.col("ref")), link))
    inside = U.same_domain(U.base_domain(F.col("link")), U.base_domain(F.col("url")))
    return linked.withColumn("link", F.when(inside, F.col("link")))


@query(
    "link_filter_valid",
    f"""{_REFS_CTE} SELECT u AS url, i AS pos, ref FROM refs
WHERE ref <> '' AND NOT starts_with(ref, '#')
  AND lower(split_part(ref, ':', 1)) NOT IN ({", ".join(Q.quote(s) for s in U.SKIP_SCHEMES)})""",
)
def link_filter_valid(t):
    return _references(t).filter(U.is_valid_href(F.col("ref")))


@query(
    "link_dedup_cap",
    f"""WITH e AS ({_EDGES}), r AS (SELECT url, {Q.origin('url')} || href AS dst, pos FROM e
  WHERE NOT regexp_matches(split_part(href, '?', 1), '({_EXT})$', 'i')),
d AS (SELECT url, dst, min(pos) AS p FROM r GROUP BY 1, 2),
k AS (SELECT url, dst, row_number() OVER (PARTITION BY url ORDER BY p) - 1 AS pos FROM d)
SELECT url AS src, pos, dst FROM k""",
)
def link_dedup_cap(t):
    """The link extractor as an edge table. Pages of one URL share its links; equal places are taken in the order of the link."""
    place = F.row_number().over(W.partitionBy("src").orderBy("pos", "dst")) - 1
    return L.url_edges(t.pages).select("src", place.alias("pos"), "dst")


@query(
    "same_domain_pairs",
    f"""WITH h AS (SELECT {Q.base_domain('url')} AS host, count(*) AS n FROM pages GROUP BY 1)
SELECT a.host AS host, b.host AS base_host, a.n AS n FROM h a JOIN h b
  ON a.host = b.host OR ends_with(a.host, '.' || b.host)""",
)
def same_domain_pairs(t):
    hosts = t.pages.groupBy(U.base_domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return L.subdomain_pairs(hosts).select("host", "base_host", "n")


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", U.content_hash(F.col("text")).alias("hash"))


@query(
    "session_key_default",
    "SELECT c_custkey, coalesce(k, replace(d, '.', '_')) AS session_key, viewport FROM (SELECT c_custkey, "
    "CASE WHEN c_acctbal > 0 THEN c_name END AS k, lower(c_mktsegment) || '.example.com' AS d, "
    "CASE WHEN c_nationkey % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS viewport FROM customer)",
)
def session_key_default(t):
    domain = F.concat(F.lower("c_mktsegment"), F.lit(".example.com"))
    return t.customer.select(
        "c_custkey",
        U.session_key_of(F.when(F.col("c_acctbal") > 0, F.col("c_name")), domain).alias("session_key"),
        U.viewport_family(F.col("c_nationkey") % 2 == 0).alias("viewport"),
    )


@query(
    "http_status_flags",
    "SELECT event_id, s BETWEEN 200 AND 299 AND event_type <> 'error' AS ok, s IN (403, 429, 503) AS blocked FROM "
    "(SELECT event_id, event_type, [200, 204, 301, 403, 404, 429, 500, 503][(event_id % 8 + 1)::INT] AS s FROM events)",
)
def http_status_flags(t):
    status = F.element_at(
        F.array(*[F.lit(s) for s in (200, 204, 301, 403, 404, 429, 500, 503)]), (F.col("event_id") % 8 + 1).cast("int")
    )
    error = F.when(F.col("event_type") == "error", F.lit("failed"))
    return t.events.select(
        "event_id", U.status_ok(status, error).alias("ok"), U.status_blocked(status).alias("blocked")
    )
