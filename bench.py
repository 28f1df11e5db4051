"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Each query is built, planned and run in full (all columns of all rows are computed and
discarded by the sink). One small untimed run before the measurements starts the JVM and
the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewright.plans.registry import all_queries
from pagewright.session import build_session

HEADLINE = [
    "domain_detection_rollup",
    "rule_reasons",
    "protection_signal",
    "document_detection",
    "link_dedup_cap",
    "dom_page_links",
    "html_clean_text",
    "html_markdown",
    "page_pagination_struct",
    "next_page_url",
    "pagination_stop_rule",
    "tfidf_feature_string",
    "tfidf_weights",
    "tfidf_lr_predict",
    "domain_profile_state",
    "session_trust_fold",
    "route_decision",
    "bfs_crawl_order",
    "jobs_latest_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g", "spark.pagewright.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
