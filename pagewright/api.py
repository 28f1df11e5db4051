"""Library calls for requests and searches over a page snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.detection import is_success, with_detection
from pagewright.functions.policy import with_protection
from pagewright.functions.text import nvl
from pagewright.operators import links as L
from pagewright.operators.crawl import crawl
from pagewright.operators.extract import extract_content
from pagewright.operators.pagination import crawl_with_pagination, requested_pages, run_pagination
from pagewright.operators.search import extract_urls, run_search, scraped_results
from pagewright.session import materialize
from pagewright.sources.requests import flow, scrape_request


def prepare_snapshot(pages: DataFrame, key: str = "page_id", mode: str = "balanced") -> DataFrame:
    """Process a snapshot once: url, html, detection, success, protection, clean_text, markdown, links, metrics.

    Meant to be written as a table that all later requests read. Where few of its pages will be asked for, `run_requests` also takes
    the snapshot as it is.
    """
    found = L.extract_links(with_protection(with_detection(pages)))
    found = found.withColumn("success", is_success(F.col("html"), F.col("detection")))
    return found.join(extract_content(pages, key, mode=mode), key, "left")


def run_requests(requests: DataFrame, snapshot: DataFrame, key: str | None = None) -> DataFrame:
    """Pages that each request returns: key, seed, url, depth, position, success, detection, clean_text, error.

    `requests`: `payload` (JSON), and with `key` a column of its own that tells requests apart. Without it every row is a request of
    its own. Requests are split by the kind of run they ask for; each kind is one set-oriented plan, however many
    requests there are. A payload without a URL gives one row with an error, and so does a page that the snapshot does not have.
    Budgets are those of the request, or the documented defaults of a request. Without columns `links` and `detection` in the
    snapshot (url, html, clean_text, success) both are made for the pages that the requests reach.
    """
    own = F.col(key) if key else F.monotonically_increasing_id()
    typed = requests.select(own.alias("run"), scrape_request(F.col("payload")).alias("r")).withColumn("flow", flow(F.col("r")))
    typed = materialize(
        typed.select(
            "run", F.col("r.url").alias("seed"), "flow", F.col("r.max_pages").alias("max_pages"), F.col("r.max_depth").alias("max_depth"),
            requested_pages(F.col("r.pagination"), F.col("r.max_pages")).alias("pagination_pages"),
        ),
        "requests",
    )
    facts = snapshot.select("url", "html", "clean_text", "success")
    first = [F.lit(0).alias("depth"), F.lit(0).alias("position")]
    results = typed.filter(nvl(F.col("seed")) == "").select("run", "seed", F.lit(None).cast("string").alias("url"), *first)
    typed = typed.filter(nvl(F.col("seed")) != "")
    kinds = {r["flow"] for r in typed.select("flow").distinct().collect()}

    def of(kind: str) -> DataFrame:
        return typed.filter(F.col("flow") == kind).drop("flow")

    if "single" in kinds:
        results = results.unionByName(of("single").select("run", "seed", F.col("seed").alias("url"), *first))
    if "pagination" in kinds:
        seeds = of("pagination").select("run", "seed", F.col("pagination_pages").alias("max_pages"))
        paged = run_pagination(seeds, facts, None, run="run")
        results = results.unionByName(paged.select("run", "seed", "url", "depth", F.col("pos").alias("position")))
    if kinds & {"crawl", "crawl_with_pagination"}:
        edges = materialize(L.link_edges(snapshot), "edges") if "links" in snapshot.columns else L.edges_of(snapshot)
    if "crawl" in kinds:
        seeds = of("crawl").drop("pagination_pages")
        results = results.unionByName(crawl(seeds, edges, facts.select("url", "success"), None, None, run="run"))
    if "crawl_with_pagination" in kinds:
        both = crawl_with_pagination(of("crawl_with_pagination"), facts, edges, None, None, None, run="run")
        # Crawled pages are counted on after those of the pagination.
        paged_pages = F.count_if(F.col("stage") == "pagination").over(W.partitionBy("run"))
        position = F.col("position") + F.when(F.col("stage") == "crawl", paged_pages).otherwise(0)
        results = results.unionByName(both.withColumn("position", position.cast("int")).drop("stage"))
    results = materialize(results, "results")
    reached = snapshot.join(results.select("url").distinct(), "url", "left_semi")
    reached = reached if "detection" in snapshot.columns else with_detection(reached)
    found = reached.select("url", "success", "detection", "clean_text", F.lit(True).alias("__stored"))
    error = F.when(F.col("url").isNull(), F.lit("malformed request")).when(F.col("__stored").isNull(), F.lit("page not in the snapshot"))
    return results.join(found, "url", "left").select(
        *([F.col("run").alias(key)] if key else []), "seed", "url", "depth", "position", "success", "detection", "clean_text", error.alias("error")
    )


def search_and_scrape(results: DataFrame, snapshot: DataFrame, mode: str = "text", top_k: int = 20) -> DataFrame:
    """The first hits of each query with their processed page; hits outside the snapshot carry an error."""
    return scraped_results(extract_urls(run_search(results, mode, top_k)), snapshot)
