"""URL, hash and path functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import let, nvl, strip

# URI schemes that never lead to a page.
SKIP_SCHEMES = ["mailto", "tel", "javascript", "data", "ftp", "sftp", "blob"]

# Path endings that never lead to a page.
SKIP_EXTENSIONS = [
    ".pdf", ".zip", ".gz", ".tar", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico",
    ".mp4", ".mp3", ".avi", ".mov", ".webm",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".css", ".js", ".json", ".xml", ".rss", ".atom",
    ".woff", ".woff2", ".ttf", ".eot",
]

# Schemes under which a reference may be relative / may carry a host.
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
HOST_SCHEMES = [s for s in RELATIVE_SCHEMES if s]

_TAIL = ["host", "path", "query", "fragment"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_HOST = _AFTER_SCHEME + r"//([^/?#]*)"
_PATH = r"(?s)" + _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_PARAMS = ";[^/]*$"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"
_EXTENSION = "(?i)(" + "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS) + ")$"


def clean(url: Column) -> Column:
    """Drop leading control characters and embedded tabs/newlines, as URL parsers do."""
    return F.when(
        url.rlike(r"^[\x00-\x20]|[\t\r\n]"),
        F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""),
    ).otherwise(url)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _FRAGMENT, 1)


def drop_www_chars(host: Column) -> Column:
    """Strip leading `w` and `.` characters (a character set, not a prefix)."""
    return F.regexp_replace(host, r"^[w.]+", "")


def base_domain(url: Column, strict_www: bool = False) -> Column:
    """Lower-case host without its leading www characters; '' where the URL has no valid host.

    `strict_www` removes only a literal `www.` prefix.
    """


    def bare(host: Column) -> Column:
        unbalanced = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
        name = F.regexp_replace(host, r"^www\.", "") if strict_www else drop_www_chars(host)
        return F.when(unbalanced, F.lit("")).otherwise(name)

    return let(F.lower(netloc(clean(nvl(url)))), bare)


def _host_as_written(url: Column) -> Column:
    return F.split_part(F.element_at(F.split(url, "//"), -1), F.lit("/"), F.lit(1))


def url_folder(url: Column) -> Column:
    """Folder name of one page: host with underscores and the first 8 digits of the URL's MD5."""
    return F.concat_ws("_", F.replace(_host_as_written(url), F.lit("."), F.lit("_")), F.substr(F.md5(url), F.lit(1), F.lit(8)))


def crawl_folder(seed_url: Column, started_at: Column) -> Column:
    """Folder name of one crawl session."""
    host = F.replace(_host_as_written(seed_url), F.lit("."), F.lit("_"))
    return F.concat(host, F.lit("_crawl_"), F.date_format(started_at, "yyyyMMdd_HHmmss"))


def is_valid_href(href: Column) -> Column:
    return (
        href.isNotNull()
        & (F.char_length(href) > 0)
        & ~F.lower(F.split_part(href, F.lit(":"), F.lit(1))).isin(SKIP_SCHEMES)
        & ~F.startswith(href, F.lit("#"))
    )


def has_skip_extension(url: Column) -> Column:
    """True where the path, without `;params` of its last segment, ends in a skipped extension."""
    return F.regexp_replace(path(url), _PARAMS, "").rlike(_EXTENSION)


def drop_fragment(url: Column) -> Column:
    """The URL without `#...`, and without a `?` that has nothing behind it."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"\?$", "")


def split_url(url: Column) -> Column:
    """struct<scheme, host, path, query, fragment> of a URL; missing parts are empty."""
    return let(
        clean(nvl(url)),
        lambda u: F.struct(
            scheme(u).alias("scheme"),
            netloc(u).alias("host"),
            path(u).alias("path"),
            query(u).alias("query"),
            fragment(u).alias("fragment"),
        ),
    )


def unsplit(parts: Column) -> Column:
    """Put the parts of `split_url` together again, leaving out empty ones."""
    p = parts["path"]
    rooted = F.startswith(p, F.lit("/"))
    body = (
        F.when(
            parts["host"] != "",
            F.concat(F.lit("//"), parts["host"], F.when((p != "") & ~rooted, F.lit("/")).otherwise(F.lit("")), p),
        )
        .when(
            F.startswith(p, F.lit("//")) | (parts["scheme"].isin(HOST_SCHEMES) & ((p == "") | rooted)),
            F.concat(F.lit("//"), p),
        )
        .otherwise(p)
    )
    return F.concat(
        F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(F.lit("")),
        F.when(parts["fragment"] != "", F.concat(F.lit("#"), parts["fragment"])).otherwise(F.lit("")),
    )


def _without_dots(segments: Column) -> Column:
    """Apply `.` and `..` to a list of path segments and join them."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    closed = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))
    ).otherwise(kept)
    return F.array_join(closed, "/")


def _rooted(path_: Column) -> Column:
    return F.when(path_ == "", F.lit("/")).otherwise(path_)


def base_parts(base_url: Column) -> Column:
    """The pieces of a base URL that reference resolution needs."""
    return let(
        F.struct(split_url(base_url).alias("url"), nvl(base_url).alias("raw")),
        lambda b: F.struct(
            b["url"].alias("url"),
            b["raw"].alias("raw"),
            F.when(b["url"]["path"] == "", F.lit("/"))
            .otherwise(F.regexp_replace(b["url"]["path"], r"[^/]+$", ""))
            .alias("dir"),
        ),
    )


def _with_path(parts: Column, base: Column, path_: Column, query_: Column) -> Column:
    return F.struct(
        base["url"]["scheme"].alias("scheme"),
        base["url"]["host"].alias("host"),
        path_.alias("path"),
        query_.alias("query"),
        parts["fragment"].alias("fragment"),
    )


def resolve_all(hrefs: Column, base: Column) -> Column:
    """Resolve every reference of an array against one base (a `base_parts` struct).

    Written as chained `transform` steps so that each piece is computed once per
    reference; dot segments take the slower fold only where they occur.
    """
    pieces = F.transform(hrefs, lambda h: F.struct(h.alias("raw"), split_url(h).alias("url")))

    def target_path(p: Column) -> Column:
        # Empty segments inside a joined path collapse; a rooted path keeps them.
        return F.when(F.startswith(p["path"], F.lit("/")), p["path"]).otherwise(
            F.regexp_replace(F.concat(base["dir"], p["path"]), "/{2,}", "/")
        )

    def joined(p: Column) -> Column:
        flat = let(
            target_path(p),
            # `;params` of the last segment take no part in dot removal.
            lambda t: F.when(
                t.rlike(r"(^|/)\.\.?([/;]|$)"),
                F.concat(
                    let(_without_dots(F.split(F.regexp_replace(t, _PARAMS, ""), "/")), _rooted),
                    F.regexp_extract(t, _PARAMS, 0),
                ),
            ).otherwise(t),
        )
        new_path = let(flat, _rooted)
        return F.when(
            p["path"] == "",
            _with_path(
                p,
                base,
                base["url"]["path"],
                F.when(p["query"] == "", base["url"]["query"]).otherwise(p["query"]),
            ),
        ).otherwise(_with_path(p, base, new_path, p["query"]))

    def one(piece: Column) -> Column:
        p, scheme_ = piece["url"], base["url"]["scheme"]
        foreign = (p["scheme"] != "") & (p["scheme"] != scheme_)
        return (
            F.when(base["raw"] == "", piece["raw"])
            .when(piece["raw"] == "", base["raw"])
            .when(foreign | ~scheme_.isin(RELATIVE_SCHEMES), piece["raw"])
            .otherwise(
                let(
                    F.when(p["host"] != "", F.struct(scheme_.alias("scheme"), *[p[n].alias(n) for n in _TAIL])).otherwise(
                        joined(p)
                    ),
                    unsplit,
                )
            )
        )

    return F.transform(pieces, one)


def resolve(href: Column, base_url: Column) -> Column:
    """Resolve one reference against its base URL."""
    resolved = let(base_parts(base_url), lambda b: F.element_at(resolve_all(F.array(href), b), 1))
    return F.when(href.isNotNull(), resolved)


def page_url(absolute: Column) -> Column:
    """A crawlable http(s) URL without fragment, or NULL."""
    return let(
        clean(absolute),
        lambda u: F.when(
            scheme(u).isin("http", "https") & ~has_skip_extension(u),
            F.concat(scheme(u), F.regexp_replace(drop_fragment(u), r"^[^:/?#]*", "")),
        ),
    )


def normalize_href(href: Column, base_url: Column) -> Column:
    return page_url(resolve(strip(href), base_url))


def same_domain(url_host: Column, base_host: Column) -> Column:
    """Equal hosts, or `url_host` is a subdomain of `base_host` (both from `base_domain`)."""
    return (url_host == base_host) | F.endswith(url_host, F.concat(F.lit("."), base_host))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, so that a suffix match becomes an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(nvl(text), 256)


def result_url(url: Column, href: Column) -> Column:
    """URL of a search hit, or NULL where it is not an http link."""
    chosen = F.coalesce(F.nullif(url, F.lit("")), href)
    return F.when(F.startswith(chosen, F.lit("http")), chosen)


def viewport_family(is_mobile: Column) -> Column:
    return F.when(F.coalesce(is_mobile, F.lit(False)), F.lit("mobile")).otherwise(F.lit("desktop"))


def session_key_of(session_key: Column, domain: Column) -> Column:
    return F.coalesce(F.nullif(session_key, F.lit("")), F.replace(domain, F.lit("."), F.lit("_")))


def status_ok(status_code: Column, error: Column | None = None) -> Column:
    """2xx and no transport error."""
    ok = status_code.between(200, 299)
    return ok & error.isNull() if error is not None else ok


def status_blocked(status_code: Column) -> Column:
    return status_code.isin(403, 429, 503)
