"""Pagination by URL: inference and next-page construction, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.functions.text import let, nvl, strip, try_int

# Query parameters that page through a listing, in order of preference.
PAGE_PARAMS = ["page", "p", "pg", "start", "offset", "from"]
LIMIT_PARAMS = ["limit", "size", "take"]
PATH_TEMPLATES = [(r"/page/\d+/?$", "/page/{page}"), (r"/p\d+/?$", "/p{page}"), (r"-\d+/?$", "-{page}")]
DEFAULT_LIMIT = 25
MIN_PAGE_TEXT_CHARS = 200

CONFIG_TYPE = (
    "struct<type:string,param:string,step:int,max_pages:int,next_url:string,page_urls:array<string>,"
    "pattern:string,offset_param:string,limit_param:string,limit_value:int,selector:string,mode:string,"
    "concurrent:boolean,max_workers:int>"
)


def config(**fields: Column) -> Column:
    """A pagination configuration struct; fields that are not given take their defaults."""
    null = F.lit(None)
    defaults = {
        "type": F.lit(""), "param": null, "step": F.lit(1), "max_pages": F.lit(20), "next_url": null,
        "page_urls": F.array().cast("array<string>"), "pattern": null, "offset_param": null, "limit_param": null,
        "limit_value": null, "selector": null, "mode": null, "concurrent": F.lit(False), "max_workers": F.lit(3),
    }
    defaults.update(fields)
    return F.struct(*[c.alias(n) for n, c in defaults.items()]).cast(CONFIG_TYPE)


def _decoded(text: Column) -> Column:
    """Percent-decoding; text with a malformed escape is kept, with `+` read as a space."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def query_pairs(query: Column) -> Column:
    """array<struct<k, v>> of a query string; names without a value keep an empty one."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def query_keys(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["k"]))


def values_of(pairs: Column, key: Column | str) -> Column:
    wanted = F.lit(key) if isinstance(key, str) else key
    return F.transform(F.filter(pairs, lambda p: p["k"] == wanted), lambda p: p["v"])


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _encode_query(pairs: Column) -> Column:
    """Encode pairs, the values of one name side by side at the name's first position."""
    grouped = F.flatten(F.transform(query_keys(pairs), lambda k: F.filter(pairs, lambda p: p["k"] == k)))
    return F.array_join(F.transform(grouped, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _with_value(pairs: Column, param: Column, value: Column) -> Column:
    """Pairs with one value for `param`, at its first position or at the end if it is new."""
    entry = F.array(F.struct(param.alias("k"), value.alias("v")))
    return F.when(
        F.array_contains(query_keys(pairs), param),
        F.flatten(
            F.transform(
                query_keys(pairs),
                lambda k: F.when(k == param, entry).otherwise(F.filter(pairs, lambda p: p["k"] == k)),
            )
        ),
    ).otherwise(F.concat(pairs, entry))


def _replace_part(parts: Column, name: str, value: Column) -> Column:
    return F.struct(*[(value if n == name else parts[n]).alias(n) for n in ("scheme", "host", "path", "query", "fragment")])


def _set_in(parts: Column, param: Column, value: Column) -> Column:
    query = let(query_pairs(parts["query"]), lambda q: let(_with_value(q, param, value), _encode_query))
    return _replace_part(parts, "query", query)


def _update_in(parts: Column, param: Column, step: Column) -> Column:
    start = F.when(F.lower(param).isin("page", "p", "pg"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    current = let(
        values_of(query_pairs(parts["query"]), param),
        lambda v: F.when(F.size(v) == 0, start).otherwise(
            F.coalesce(try_int(F.try_element_at(v, F.lit(-1))), F.lit(0).cast("bigint"))
        ),
    )
    return _set_in(parts, param, (current + step).cast("string"))


def set_query_param(url: Column, param: Column, value: Column) -> Column:
    return let(U.split_url(url), lambda u: let(_set_in(u, param, value.cast("string")), U.unsplit))


def update_query_param(url: Column, param: Column, step: Column) -> Column:
    """Add `step` to a numeric query parameter. Missing page numbers count from 1, offsets from 0."""
    return let(U.split_url(url), lambda u: let(_update_in(u, param, step), U.unsplit))


def _bumped(path: Column, pattern: str) -> Column:
    number = F.regexp_extract(path, pattern, 2).try_cast("decimal(38,0)") + 1
    return F.when(
        path.rlike(pattern),
        F.concat(
            F.regexp_extract(path, pattern, 1),
            number.cast("decimal(38,0)").cast("string"),
            F.regexp_extract(path, pattern, 3),
        ),
    )


def _next_path(path: Column, pattern: Column) -> Column:
    return F.coalesce(
        _bumped(path, r"(?s)^(.*/page/)(\d+)(/?)$"),
        _bumped(path, r"(?s)^(.*/p)(\d+)(/?)$"),
        _bumped(path, r"(?s)^(.*-)(\d+)(/?)$"),
        F.when(F.contains(nvl(pattern), F.lit("{page}")), _bumped(path, r"(?s)^(.*?)(\d+)(\D*)$")),
    )


def increment_path(url: Column, pattern: Column) -> Column:
    """Next page of a URL that carries its page number in the path; NULL if it carries none."""

    def advance(u: Column) -> Column:
        return let(
            _next_path(u["path"], pattern), lambda p: F.when(p.isNotNull(), let(_replace_part(u, "path", p), U.unsplit))
        )

    return let(U.split_url(url), advance)


def _infer(path: Column, pairs: Column, keys: Column) -> Column:
    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    limit_param = F.coalesce(*[F.when(has(n), F.lit(n)) for n in LIMIT_PARAMS])
    limit_value = F.coalesce(
        try_int(F.try_element_at(values_of(pairs, limit_param), F.lit(-1))).cast("int"), F.lit(DEFAULT_LIMIT)
    )
    # The rules pick a small code first; the wide configuration struct is built once.
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in PAGE_PARAMS:
        if name == "offset":
            rule = rule.when(has(name) & limit_param.isNotNull(), F.lit("offset+limit"))
        rule = rule.when(has(name), F.lit(name))
    for regex, template in PATH_TEMPLATES:
        rule = rule.when(path.rlike(regex), F.lit(template))

    def build(r: Column) -> Column:
        paired = r == "offset+limit"
        by_path = F.startswith(r, F.lit("/")) | F.startswith(r, F.lit("-"))
        single = ~paired & ~by_path
        return F.when(
            r.isNotNull(),
            config(
                type=F.when(paired, F.lit("offset_limit")).when(by_path, F.lit("url_path")).otherwise(F.lit("url_param")),
                param=F.when(single, r),
                step=F.when(r.isin("start", "from"), F.lit(10)).otherwise(F.lit(1)),
                pattern=F.when(by_path, r),
                offset_param=F.when(paired, F.lit("offset")),
                limit_param=F.when(paired, limit_param),
                limit_value=F.when(paired, limit_value),
            ),
        )

    return let(rule, build)


def infer_from_url(url: Column) -> Column:
    """Pagination that the URL itself shows (a `config` struct), or NULL."""
    return let(
        U.split_url(url),
        lambda u: let(
            query_pairs(u["query"]), lambda pairs: let(query_keys(pairs), lambda keys: _infer(u["path"], pairs, keys))
        ),
    )


def next_page_url(url: Column, paging: Column) -> Column:
    """URL of the following page under a pagination configuration, or NULL."""
    return let(paging, lambda p: _next_url(url, p))


def _next_url(url: Column, paging: Column) -> Column:
    kind = F.lower(F.trim(paging["type"]))
    limit_step = F.coalesce(F.nullif(paging["limit_value"], F.lit(0)), F.nullif(paging["step"], F.lit(0)), F.lit(1))
    paired = kind == "offset_limit"
    # Both query kinds add a step to one parameter, so they share one expression.
    param = F.when(paired, paging["offset_param"]).when(kind == "url_param", paging["param"])
    step = F.when(paired, limit_step).otherwise(paging["step"])

    def by_query(u: Column) -> Column:
        return let(
            _update_in(u, param, step),
            lambda a: F.when(
                paired & (nvl(paging["limit_param"]) != "") & paging["limit_value"].isNotNull(),
                _set_in(a, paging["limit_param"], paging["limit_value"].cast("string")),
            ).otherwise(a),
        )

    def by_path(u: Column) -> Column:
        return let(_next_path(u["path"], paging["pattern"]), lambda p: F.when(p.isNotNull(), _replace_part(u, "path", p)))

    def advance(u: Column) -> Column:
        moved = F.when(nvl(param) != "", by_query(u)).when(kind == "url_path", by_path(u))
        return let(moved, lambda m: F.when(m.isNotNull(), U.unsplit(m)))

    return let(U.split_url(url), advance)


def is_effectively_empty(clean_text: Column) -> Column:
    return F.char_length(strip(nvl(clean_text))) < MIN_PAGE_TEXT_CHARS
