"""Queries on page content."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import extract as X
from pagewright.operators import links as L
from pagewright.operators import nodes as N
from pagewright.plans import sql_parts as Q
from pagewright.plans.registry import query

# The supplied pages are flat enough for SQL to say what extraction keeps: no nav, footer,
# script or style; tags separate texts; and leaf blocks of one tag and size class that occur
# four times or more, with under 120 characters, are dropped.
_STRIPPED = (
    "regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|"
    "<!DOCTYPE[^>]*>', '', 'gis')"
)
_UNESCAPED = "{0}"
for _name, _char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '&{_name};?', '{_char}', 'g')"
CLEAN_TEXT_SQL = f"""
raw AS (SELECT page_id, unnest(string_split(regexp_replace({_STRIPPED}, '<(/?[a-z0-9]+)[^>]*>', chr(1) || '<\\1>' || chr(2), 'g'), chr(1))) AS piece,
  generate_subscripts(string_split(regexp_replace({_STRIPPED}, '<(/?[a-z0-9]+)[^>]*>', chr(1) || '<\\1>' || chr(2), 'g'), chr(1)), 1) AS pos FROM pages),
cut AS (SELECT page_id, pos, split_part(piece, chr(2), 1) AS tag, {Q.strip(_UNESCAPED.format("split_part(piece, chr(2), 2)"))} AS txt FROM raw),
look AS (SELECT *, lead(tag) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM cut),
leaf AS (SELECT *, count(*) FILTER (WHERE tag IN ('<p>') AND nxt = '</p>') OVER (PARTITION BY page_id, tag, nxt, least(length(txt) // 20, 6)) AS twins FROM look),
kept AS (SELECT page_id, pos, txt FROM leaf WHERE txt <> '' AND NOT (tag = '<p>' AND nxt = '</p>' AND twins >= 4 AND length(txt) < 120)),
clean AS (SELECT p.page_id, coalesce(string_agg(txt, chr(10) ORDER BY pos), '') AS clean_text FROM pages p LEFT JOIN kept k ON p.page_id = k.page_id GROUP BY 1)"""


@query("html_clean_text", f"WITH {CLEAN_TEXT_SQL} SELECT page_id, clean_text FROM clean")
def html_clean_text(t):
    return X.clean_html_to_text(t.pages)


# Normalized HTML and Markdown of these pages. Every `<b>` stays open up to the end of its article, as does the `<p>` around it;
# line breaks are repeated blocks themselves where a page has four or more. Some pages leave out the last two end tags.
_BARE = "regexp_replace(html, '<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', '', 'gis')"
_PIECES = f"string_split(regexp_replace({_BARE}, '(</?[a-z0-9]+[^>]*>)', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
_PLAIN = _UNESCAPED.format("split_part(piece, chr(2), 2)")
_LEAF_SIZE = f"""least(length({Q.strip('txt')}) // 20, 6)"""
RENDERED_SQL = f"""
bits AS (SELECT page_id, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS pos FROM pages),
parts AS (SELECT page_id, pos, split_part(piece, chr(2), 1) AS tag, {_PLAIN} AS txt, lead(split_part(piece, chr(2), 1)) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM bits),
sized AS (SELECT *, tag = '<p>' AND nxt = '</p>' AS is_leaf, count(*) FILTER (WHERE tag = '<br>') OVER (PARTITION BY page_id) AS breaks,
  count(*) FILTER (WHERE tag = '<b>') OVER (PARTITION BY page_id) AS bolds,
  count(*) FILTER (WHERE tag = '<p>' AND nxt = '</p>') OVER (PARTITION BY page_id, tag, nxt, {_LEAF_SIZE}) AS alike FROM parts),
marked AS (SELECT *, is_leaf AND alike >= 4 AND length({Q.strip('txt')}) < 120 AS twin FROM sized),
placed AS (SELECT *, twin OR (tag = '<br>' AND breaks >= 4) OR coalesce(lag(twin) OVER (PARTITION BY page_id ORDER BY pos), false) AS no_tag FROM marked),
tokens AS (SELECT page_id, pos,
  CASE WHEN no_tag THEN '' WHEN tag IN ('<br>', '<meta charset="utf-8">') THEN replace(tag, '>', '/>') WHEN tag = '<!DOCTYPE html>' THEN tag || chr(10)
    WHEN tag = '</article>' THEN repeat('</b></p>', bolds) || tag ELSE tag END
  || CASE WHEN twin THEN '' ELSE regexp_replace(replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;!--(.*?)--&gt;', '<!--\\1-->', 'g') END AS html,
  CASE WHEN no_tag THEN '' WHEN tag IN ('<title>', '<article>', '<p>', '<body>') OR tag LIKE '<div%' THEN chr(3) WHEN tag = '<h1>' THEN chr(3) || '# '
    WHEN tag = '<b>' THEN '**' WHEN tag = '</article>' THEN repeat('**', bolds) || chr(3) WHEN tag = '<br>' THEN '  ' || chr(10) ELSE '' END
  || CASE WHEN twin THEN '' ELSE regexp_replace(regexp_replace(txt, '<!--.*?-->', '', 'g'), '[\\t \\r\\n]+', ' ', 'g') END AS md FROM placed),
normal AS (SELECT p.page_id, coalesce(string_agg(t.html, '' ORDER BY pos), '')
    || CASE WHEN any_value(p.html) LIKE '%<body>%' AND NOT any_value(p.html) LIKE '%</body>%' THEN '</body></html>' ELSE '' END AS normalized_html,
  list_filter(list_transform(string_split(coalesce(string_agg(md, '' ORDER BY pos), ''), chr(3)),
    lambda b: regexp_replace({Q.strip('b')}, '\\n[ \\t]+', chr(10), 'g')), lambda b: b <> '') AS blocks
  FROM pages p LEFT JOIN tokens t ON p.page_id = t.page_id GROUP BY 1),
rendered AS (SELECT page_id, normalized_html, array_to_string(blocks, chr(10) || chr(10)) AS markdown FROM normal)"""


@query("html_markdown", f"WITH {RENDERED_SQL} SELECT page_id, markdown FROM rendered")
def html_markdown(t):
    return X.extract_content(t.pages).select("page_id", "markdown")


@query("html_normalized", f"WITH {RENDERED_SQL} SELECT page_id, normalized_html FROM rendered")
def html_normalized(t):
    return X.normalize_html(t.pages)


@query(
    "html_metrics",
    f"""WITH {CLEAN_TEXT_SQL}, {RENDERED_SQL}
SELECT c.page_id, 'balanced' AS mode, length(clean_text) AS text_length, length(markdown) AS markdown_length,
  length(normalized_html) AS normalized_html_length FROM clean c JOIN rendered r ON c.page_id = r.page_id""",
)
def html_metrics(t):
    return X.extract_content(t.pages).select("page_id", "metrics.*")


@query(
    "product_hint",
    "SELECT p_partkey, ("
    + " + ".join(f"contains(lower(txt), '{h}')::INT" for h in X.PRODUCT_HINTS)
    + ") >= 2 AS product FROM (SELECT p_partkey, p_name || ' ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' Buy now, add to cart' "
    "WHEN p_size % 3 = 1 THEN ' price on request' ELSE '' END AS txt FROM part)",
)
def product_hint(t):
    offer = (
        F.when(F.col("p_size") % 3 == 0, F.lit(" Buy now, add to cart"))
        .when(F.col("p_size") % 3 == 1, F.lit(" price on request"))
        .otherwise(F.lit(""))
    )
    text = F.concat("p_name", F.lit(" "), "p_type", offer)
    return t.part.select("p_partkey", X.looks_like_product(text).alias("product"))


@query(
    "dom_links",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS hs FROM pages)
SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM a""",
)
def dom_links(t):
    return N.with_nodes(t.pages).select("page_id", F.posexplode(N.dom_hrefs(F.col("nodes"))).alias("pos", "href"))


@query(
    "dom_page_links",
    f"""WITH a AS (SELECT url, {Q.origin('url')} AS o, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS hs FROM pages),
e AS (SELECT url, o || unnest(hs) AS link, generate_subscripts(hs, 1) AS pos FROM a),
d AS (SELECT url, link, min(pos) AS p FROM e GROUP BY 1, 2)
SELECT url, string_agg(link, ' ' ORDER BY p) AS links, count(*) AS n FROM d GROUP BY 1""",
)
def dom_page_links(t):
    """Links of each URL; pages of one URL share them, equal places are taken in the order of the link."""
    placed = L.url_edges(t.pages).groupBy(F.col("src").alias("url")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("links"))
    return placed.select("url", F.array_join("links.dst", " ").alias("links"), F.size("links").alias("n"))


@query(
    "node_kinds",
    r"""WITH s AS (SELECT regexp_replace(html, '<script.*?</script>', '<script>', 'gis') AS h FROM pages)
SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
  regexp_replace(h, '<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM s) GROUP BY 1""",
)
def node_kinds(t):
    """Elements by tag name over all pages."""
    return N.with_nodes(t.pages).select(F.inline("nodes")).filter("kind = 'e'").groupBy("tag").agg(F.count("*").alias("n"))
