"""Queries on session look-up, proxies, what counts as a failure, attempt logs, and links as a table function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.functions import policy as P
from pagewright.functions import signals as S
from pagewright.functions.policy import with_protection
from pagewright.operators import folds as D
from pagewright.operators.links import PageHrefs
from pagewright.plans.derived import ATTEMPTS_SQL, attempts
from pagewright.plans.detection_queries import _MARKED_PROTECTED, _marked
from pagewright.plans.registry import query
from pagewright.plans.sql_parts import quote
from pagewright.sources import sinks


@query(
    "session_lookup",
    f"""WITH a AS ({ATTEMPTS_SQL}), s AS (SELECT user_id, count(*) AS attempt_count, count(*) FILTER (WHERE success) AS success_count,
  count(*) FILTER (WHERE blocked) AS failure_count FROM a GROUP BY 1), u AS (SELECT * FROM s WHERE failure_count % 3 <> 0)
SELECT c_custkey AS user_id, coalesce(attempt_count, 0) AS attempt_count, coalesce(success_count, 0) AS success_count,
  coalesce(failure_count, 0) AS failure_count, false AS burned, u.user_id IS NULL AS is_new_session FROM customer LEFT JOIN u ON c_custkey = u.user_id""",
)
def session_lookup(t):
    """Every customer's session; sessions with a multiple of three failures are burned and replaced by fresh ones."""
    blocked = F.col("blocked")
    states = attempts(t.events).groupBy("user_id").agg(
        F.count("*").alias("attempt_count"), F.count_if(~blocked).alias("success_count"), F.count_if(blocked).alias("failure_count")
    )
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"))
    return D.with_session(wanted, states.withColumn("burned", F.col("failure_count") % 3 == 0), "user_id")


@query(
    "proxy_affinity",
    """WITH k AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS proxy, max(o_orderkey) AS changed FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN changed IS NOT NULL THEN proxy ELSE 'none' END AS proxy_affinity, coalesce(changed, 0) AS updated_at
FROM customer LEFT JOIN k ON c_custkey = o_custkey""",
)
def proxy_affinity(t):
    """Customers as sessions, every third order as a change of their proxy."""
    sessions = t.customer.select("c_custkey", F.lit("none").alias("proxy_affinity"), F.lit(0).cast("long").alias("updated_at"))
    changes = t.orders.filter("o_orderkey % 3 = 0").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("proxy_id"), F.col("o_orderkey").cast("long").alias("at")
    )
    return D.set_proxy_affinity(sessions, changes, "c_custkey")


def _listed(kinds) -> str:
    return ", ".join(quote(k) for k in kinds)


@query(
    "failure_kinds",
    f"""{_MARKED_PROTECTED} SELECT page_id, kind, kind IN ({_listed(S.FAILURE_KINDS)}) AS is_failure,
  CASE WHEN kind IN ({_listed(S.FAILURE_KINDS)}) AND kind <> 'RATE_LIMIT' THEN false END AS browser_trust,
  CASE WHEN kind IN ({_listed(S.DISTRUST_KINDS)}) THEN false END AS probe_trust FROM protected""",
)
def failure_kinds(t):
    """Which pages count as failures of their domain, and what they say about plain requests to it."""
    kind = F.col("protection.kind")
    return with_protection(_marked(t)).select(
        "page_id", kind.alias("kind"), P.counts_as_failure(kind).alias("is_failure"), P.browser_http_trust(kind).alias("browser_trust"),
        P.probe_http_trust(kind).alias("probe_trust"),
    )


@query(
    "attempt_log",
    f"""WITH a AS ({ATTEMPTS_SQL}) SELECT 'u' || user_id AS domain, driver, path, session_key, blocked, attempt_id * 7 AS html_size,
  attempt_id / 8 AS elapsed, CASE WHEN blocked THEN coalesce(vendor, '') ELSE 'none' END AS protection, attempt_id % 3 AS action_count FROM a""",
)
def attempt_log(t):
    """Events as fetch attempts, as they are logged."""
    rows = attempts(t.events).select(
        F.concat(F.lit("u"), "user_id").alias("domain"), F.col("driver").alias("driver_name"), "path", "session_key", "blocked",
        (F.col("attempt_id") * 7).alias("html_size"), (F.col("attempt_id") / 8).alias("elapsed"),
        F.when(F.col("blocked"), F.coalesce("vendor", F.lit(""))).otherwise(F.lit("none")).alias("protection_signal"),
        (F.col("attempt_id") % 3).alias("action_count"),
    )
    return sinks.attempt_log(rows)


@query(
    "result_lines",
    f"""{_MARKED_PROTECTED} SELECT protected.page_id, 'PageResult(' || CASE WHEN NOT is_blocked THEN 'OK' ELSE 'FAIL' END || ' depth=' || (protected.page_id % 4) || ' driver=d' || (protected.page_id % 3) ||
  ' size=' || length(protected.html) || ' url=' || substring(pages.url, 1, 60) || ')' AS line FROM protected JOIN pages ON protected.page_id = pages.page_id""",
)
def result_lines(t):
    """One line per page result."""
    pages = _marked(t).withColumn("depth", (F.col("page_id") % 4).cast("int")).withColumn("driver_used", F.concat(F.lit("d"), F.col("page_id") % 3))
    return pages.select("page_id", sinks.result_line().alias("line"))


@query(
    "links_lateral",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS hs FROM pages)
SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM a""",
)
def links_lateral(t):
    """Links by a table function in SQL."""
    view = f"pages_{uuid.uuid4().hex}"
    t.spark.udtf.register("page_hrefs", PageHrefs)
    t.pages.createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT page_id, href, pos FROM {view}, LATERAL page_hrefs(html)")
