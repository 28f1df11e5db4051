"""Queries on jobs, requests, search results and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import search as R
from pagewright.plans import crawl_queries as K
from pagewright.plans import sql_parts as Q
from pagewright.plans.detection_queries import _MARKED_PROTECTED, _marked
from pagewright.plans.registry import query
from pagewright.functions.policy import with_protection
from pagewright.sources import jobs as J
from pagewright.sources import requests as P
from pagewright.sources import sinks
from pagewright.session import checkpoint_root, materialize
from pagewright.streaming import jobs as S

_LOG_SQL = """SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, ts FROM events"""


def _log(t):
    status = (
        F.when(F.col("event_type") == "view", F.lit("pending"))
        .when(F.col("event_type") == "click", F.lit("processing"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("done"))
    )
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id"))
    return t.events.select(
        F.col("user_id").alias("id"), status.alias("status"), error.alias("error"), F.col("ts").alias("changed_at")
    )


@query(
    "jobs_latest_status",
    f"WITH l AS ({_LOG_SQL}) SELECT id, arg_max(status, ts) AS status, arg_max(coalesce(error, ''), ts) AS error, "
    "epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us FROM l GROUP BY 1",
)
def jobs_latest_status(t):
    s = J.latest_status(_log(t))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select(
        "id", "status", F.coalesce("error", F.lit("")).alias("error"), micros("created_at").alias("created_us"),
        micros("updated_at").alias("updated_us"),
    )


@query(
    "jobs_recovery_order",
    f"WITH l AS ({_LOG_SQL}), s AS (SELECT id, arg_max(status, ts) AS status FROM l GROUP BY 1) "
    "SELECT id, status FROM s WHERE status IN ('pending', 'processing') ORDER BY id",
)
def jobs_recovery_order(t):
    return J.unfinished(_log(t)).select("id", "status")


@query(
    "search_topk_normalized",
    """WITH r AS (SELECT 'q' || (page_id % 7) AS query, page_id AS rank, CASE WHEN page_id % 5 = 0 THEN 'ftp:' || url ELSE url END AS href FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM r)
SELECT query, rank, href AS url, place FROM k WHERE place <= 20 AND starts_with(href, 'http')""",
)
def search_topk_normalized(t):
    hits = t.pages.select(
        F.concat(F.lit("q"), F.col("page_id") % 7).alias("query"),
        F.col("page_id").alias("rank"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("href"),
    )
    return R.extract_urls(R.run_search(hits, "text", 20)).select("query", "rank", "url", "place")


@query(
    "search_scrape_counts",
    """WITH h AS (SELECT 'q' || (page_id % 7) AS query, CASE WHEN page_id % 4 = 1 THEN url || 'x' ELSE url END AS url FROM pages)
SELECT query, count(*) AS urls_found, count(p.url) AS scraped_results_count FROM h LEFT JOIN pages p ON h.url = p.url GROUP BY 1""",
)
def search_scrape_counts(t):
    hits = t.pages.select(
        F.concat(F.lit("q"), F.col("page_id") % 7).alias("query"),
        F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("url"),
    )
    return R.search_summary(R.scraped_results(hits, t.pages.select("url")))


@query(
    "request_defaults",
    """SELECT o_orderkey, 'https://shop.example/o/' || o_orderkey AS url, o_orderkey % 2 = 0 AS crawl, coalesce(o_orderkey % 3 = 0, false) AS pagination_mode,
  true AS allow_http_probe, 'unlock_first' AS unlock_strategy, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE NULL END AS page_limit,
  1 AS n_actions, CASE WHEN o_orderkey % 2 = 0 THEN 900 ELSE 1500 END AS wait_ms,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'crawl_with_pagination' WHEN o_orderkey % 3 = 0 THEN 'pagination'
    WHEN o_orderkey % 2 = 0 THEN 'crawl' ELSE 'single' END AS flow FROM orders""",
)
def request_defaults(t):
    """Orders as request payloads."""
    payload = F.concat(
        F.lit('{"url": "https://shop.example/o/'), "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.lit('", "crawl": true, "actions": [{"kind": " click ", "timeout_ms": 900}]')).otherwise(
            F.lit('", "actions": [{"kind": "wait"}]')
        ),
        F.when(
            F.col("o_orderkey") % 3 == 0, F.lit(', "pagination_mode": true, "pagination": {"type": "click_append", "max_pages": 5}}')
        ).otherwise(F.lit("}")),
    )
    r = t.orders.select("o_orderkey", P.scrape_request(payload).alias("r"))
    return r.select(
        "o_orderkey", "r.url", "r.crawl", "r.pagination_mode", "r.allow_http_probe", "r.unlock_strategy",
        F.col("r.pagination.max_pages").alias("page_limit"), F.size("r.actions").alias("n_actions"),
        F.element_at("r.actions", 1)["wait_ms"].alias("wait_ms"), P.flow(F.col("r")).alias("flow"),
    )


_TEXT = Q.visible("html", " ")


@query(
    "page_metadata",
    f"""{_MARKED_PROTECTED} SELECT page_id, is_blocked AS was_blocked, page_type AS detection_type, score AS detection_score, length(html) AS html_size_bytes,
  len(regexp_extract_all({_TEXT}, '[^{Q.WS}]+')) AS word_count, kind AS protection_type FROM protected""",
)
def page_metadata(t):
    pages = with_protection(_marked(t)).withColumn("clean_text", F.regexp_replace("html", "<[^>]+>", " "))
    pages = pages.withColumn("markdown", F.col("clean_text")).withColumn("protection_type", F.col("protection.kind"))
    meta = sinks.page_metadata(pages.withColumn("session_key", F.col("page_id").cast("string")))
    return meta.select(
        F.col("session_key").cast("bigint").alias("page_id"), "was_blocked", "detection_type", "detection_score",
        "html_size_bytes", "word_count", "protection_type",
    )


@query(
    "markdown_documents",
    """SELECT conv_id, string_agg('### URL: ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS document
FROM conversations GROUP BY 1""",
)
def markdown_documents(t):
    pages = t.conversations.select("conv_id", "turn", F.col("role").alias("url"), F.col("text").alias("markdown"))
    return sinks.markdown_document(pages, "conv_id", "turn")


@query(
    "regression_report",
    f"""{_MARKED_PROTECTED} SELECT page_id, kind NOT IN ('HARD_BLOCK') AS expected_unlock, length(html) AS html_size_bytes,
  page_type AS detection_type, score AS detection_score, NOT is_blocked AS success, kind AS protection_type FROM protected""",
)
def regression_report(t):
    found = with_protection(_marked(t)).withColumn("protection_type", F.col("protection.kind"))
    found = found.select(
        "url", "html", "detection", "protection_type", F.col("page_id").cast("string").alias("session_key"),
        F.lit(None).cast("string").alias("clean_text"), F.lit("snapshot").alias("driver_used"), F.lit(0.0).alias("elapsed"),
    )
    sites = found.select("session_key", "url", F.lit("page").alias("category"), (F.col("protection_type") != "HARD_BLOCK").alias("expected_unlock"))
    report = sinks.regression_report(sites, found, "session_key")
    return report.select(
        F.col("session_key").cast("bigint").alias("page_id"), "expected_unlock", "html_size_bytes", "detection_type",
        "detection_score", "success", "protection_type",
    )


# One job for every nation; what it asks for follows from the nation's number. Nation 24 sends no URL.
_JOBS_SQL = f"""{K.SHOP_SQL}, jobs AS (SELECT nation, nation % 4 AS kind, s, '{K._HOST}/s/' || s || '?page=1' AS seed FROM firsts),
{K.paged_then_crawled_sql("SELECT nation AS run, s, seed FROM jobs WHERE kind = 3", 2, 12, 2)},
alone AS (SELECT nation AS run, s, seed FROM jobs WHERE kind = 2),
start2 AS (SELECT run, seed, [seed] AS q, [0] AS d, CAST([] AS VARCHAR[]) AS seen, 15 AS budget, 2 AS deepest FROM alone),
{K._walk_sql("true").replace("walk", "walk2").replace("FROM start", "FROM start2")},
pages AS (
  SELECT nation AS id, seed, seed AS url, 0 AS depth, 0 AS position FROM jobs WHERE kind = 0 AND nation <> 24
  UNION ALL SELECT nation, seed, '{K._HOST}/s/' || s || '?page=' || (k + 1), k, k FROM (
    SELECT jobs.*, unnest(range(least(4, (n + {K.PER_PAGE - 1}) // {K.PER_PAGE}))) AS k FROM jobs JOIN sizes ON jobs.s = sizes.s WHERE kind = 1)
  UNION ALL SELECT run, seed, url, depth, position FROM walk2 WHERE url IS NOT NULL
  UNION ALL SELECT run, seed, url, pos, pos FROM paged
  UNION ALL SELECT walk.run, seed, url, depth, position + n FROM walk JOIN (SELECT run, count(*) AS n FROM paged GROUP BY run) c ON walk.run = c.run WHERE url IS NOT NULL
  UNION ALL SELECT 24, NULL, NULL, 0, 0 FROM jobs WHERE nation = 24)"""


def _payloads(t):
    limits = {
        0: "", 1: ', "pagination_mode": true, "pagination": {"type": "url_param", "max_pages": 4}', 2: ', "crawl": true, "max_pages": 15, "max_depth": 2',
        3: ', "crawl": true, "pagination_mode": true, "max_pages": 12, "max_depth": 2, "pagination": {"type": "url_param", "max_pages": 2}',
    }
    asked = F.element_at(F.array(*[F.lit(x) for x in limits.values()]), (F.col("nation") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"url": "'), "seed", F.lit('"'), asked, F.lit("}"))
    sent = F.when(F.col("nation") == 24, F.lit("no request")).otherwise(body)
    return K.shop_seeds(t).select(F.col("nation").cast("long").alias("id"), sent.alias("payload"))


def _worked(t, batches, again: DataFrame | None = None):
    """Runs the worker over batches of jobs, and `again` once more as the last one; the folders of its log and its results."""
    folder = f"{checkpoint_root(t.spark)}/jobs/{uuid.uuid4().hex}"
    snapshot = K.shop(t)
    places = [f"{folder}/{name}" for name in ("log", "results")]
    for part in batches:
        J.enqueue(part, f"{folder}/inbox")
        S.start_worker(t.spark, f"{folder}/inbox", snapshot, *places, f"{folder}/checkpoint").awaitTermination()
    if again is not None:
        S.run_batch(again, snapshot, *places, len(batches) - 1)
    return places


@query("job_results", f"WITH RECURSIVE {_JOBS_SQL} SELECT id, seed, url, depth, position FROM pages")
def job_results(t):
    """All four kinds of requests through the job worker."""
    return S.job_results(t.spark, _worked(t, [_payloads(t)])[1]).select("id", "seed", "url", "depth", "position")


@query(
    "job_outcomes",
    "SELECT s_nationkey AS id, CASE WHEN s_nationkey = 24 THEN 'failed' ELSE 'done' END AS status, "
    "CASE WHEN s_nationkey = 24 THEN 'malformed request' END AS error FROM supplier WHERE s_nationkey % 4 = 0 GROUP BY 1",
)
def job_outcomes(t):
    """How the jobs for single pages ended, folded from the log of a worker that did its last batch twice."""
    jobs = materialize(_payloads(t).filter("id % 4 = 0"), "jobs")
    late = jobs.filter("id >= 10")
    log = _worked(t, [jobs.filter("id < 10"), late], late)[0]
    return J.latest_status(J.read_log(t.spark, log)).select("id", "status", "error")
