import random
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from pagewright.functions import paging as P
from pagewright.functions import urls as U
from pagewright.operators.links import extract_links, subdomain_pairs

BASES = [
    "http://h.com/a/b/c?x=1#f", "https://www.h.com", "http://h.com/", "http://h.com/a//b/", "https://h.com/a;p?q", "http://h.com?x",
]


def test_resolution_equals_the_standard_library(spark):
    rng = random.Random(1)
    parts = ["a", "b", "..", ".", "/", "//", "?", "#", "x=1", "http:", "https://", "c.d", ";p", "HTTP://", "www.h.com", ":", "&", "", " "]
    rows = []
    for base in BASES:
        for _ in range(400):
            ref = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
            rows.append((base, ref, urljoin(base, ref)))
    df = spark.createDataFrame(rows, "base string, ref string, want string")
    bad = df.withColumn("got", U.resolve(F.col("ref"), F.col("base"))).filter("not (got <=> want)").collect()
    assert not bad


def test_query_update_equals_the_standard_library(spark):
    def by_hand(url, param, step):
        parsed = urlparse(url)
        query = parse_qs(parsed.query, keep_blank_values=True)
        value = 1 if param in ("page", "p", "pg") and param not in query else 0
        if query.get(param):
            try:
                value = int(query[param][-1])
            except ValueError:
                value = 0
        query[param] = [str(value + step)]
        return urlunparse(parsed._replace(query=urlencode(query, doseq=True)))

    urls = [
        "http://h/?page=2", "http://h/x?q=a+b&page=2&q=c", "http://h/?page=x&z", "http://h/", "http://h?~=*&page=", "http://h/#f",
        "http://h/?a=%C3%A9&page=9&page=11", "http://h/?&&start=5", "http://h/p?q=%zz",
    ]
    rows = [(u, p, by_hand(u, p, 3)) for u in urls for p in ("page", "start", "q")]
    df = spark.createDataFrame(rows, "url string, param string, want string")
    got = df.withColumn("got", P.update_query_param(F.col("url"), F.col("param"), F.lit(3)))
    assert not got.filter("not (got <=> want)").collect()


def test_listing_urls(spark):
    cases = [
        ("https://example.com/jobs?page=2", "https://example.com/jobs?page=3"),
        ("https://example.com/jobs?offset=25&limit=25", "https://example.com/jobs?offset=50&limit=25"),
        ("https://example.com/jobs/page/3", "https://example.com/jobs/page/4"),
        ("https://example.com/jobs/p09/", "https://example.com/jobs/p10/"),
        ("https://example.com/jobs-7", "https://example.com/jobs-8"),
        ("https://example.com/jobs?from=10", "https://example.com/jobs?from=20"),
        ("https://example.com/jobs", None),
    ]
    df = spark.createDataFrame(cases, "url string, want string")
    got = df.withColumn("got", P.next_page_url(F.col("url"), P.infer_from_url(F.col("url"))))
    assert not got.filter("not (got <=> want)").collect()


def test_path_template_uses_the_last_number(spark):
    df = spark.createDataFrame([("http://h/a1/b22c/",)], "url string")
    urls = df.select(P.increment_path(F.col("url"), F.lit("/{page}")).alias("a"), P.increment_path(F.col("url"), F.lit(None)).alias("b"))
    assert tuple(urls.first()) == ("http://h/a1/b23c/", None)


def test_domains(spark):
    rows = [("https://www.Wired.com:80/x", "ired.com:80", "wired.com:80"), ("http://web.de", "eb.de", "web.de"), ("x", "", ""), ("http://[::1", "", "")]
    df = spark.createDataFrame(rows, "url string, want string, strict string")
    got = df.select(U.base_domain(F.col("url")), F.col("want"), U.base_domain(F.col("url"), True), F.col("strict")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_link_extraction(spark):
    html = """<a href="/a">1</a> <a href='b/../c?x#y'>2</a> <a href="/a">again</a> <a href="MAILTO:x@y">m</a>
    <link href="/style.css"> <a href="//sub.example.com/z">s</a> <a href="https://other.org/">o</a> <a href="#top">t</a>"""
    df = spark.createDataFrame([("https://example.com/d/e", html)], "url string, html string")
    assert extract_links(df).first().links == [
        "https://example.com/a", "https://example.com/d/c?x", "https://sub.example.com/z",
    ]
    assert extract_links(df, same_domain_only=False).first().links[-1] == "https://other.org/"
    assert len(extract_links(df, max_links=1).first().links) == 1


def test_subdomain_pairs_equal_all_pairs(spark):
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "com", "z.org"]
    got = subdomain_pairs(spark.createDataFrame([(h, 1) for h in hosts], "host string, n int")).collect()
    want = {(h, b) for h in hosts for b in hosts if h == b or h.endswith("." + b)}
    assert {(r.host, r.base_host) for r in got} == want
