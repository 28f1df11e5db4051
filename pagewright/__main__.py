"""Command line: process, crawl or search a stored snapshot.

    python -m pagewright --snapshot pages.parquet --site https://example.com --crawl --output out
    python -m pagewright --snapshot pages.parquet --results hits.parquet --search_text "a query" --output out
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from pagewright.api import prepare_snapshot, search_and_scrape
from pagewright.functions.urls import crawl_folder, url_folder
from pagewright.operators import links as L
from pagewright.operators.crawl import crawl
from pagewright.session import build_session, materialize
from pagewright.sources.sinks import crawl_summary, write_pages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    p.add_argument("--snapshot", required=True, help="parquet table of pages (page_id, url, html)")
    p.add_argument("--site", help="URL to look up or to crawl from")
    p.add_argument("--search_text", help="query whose stored web results are processed")
    p.add_argument("--search_news", help="query whose stored news results are processed")
    p.add_argument("--search_topk", type=int, default=20)
    p.add_argument("--results", help="parquet table of search results (query, rank, ...)")
    p.add_argument("--crawl", action="store_true")
    p.add_argument("--max-pages", type=int, default=100)
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--output", default="storage/extracted")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    query = args.search_text or args.search_news
    if not args.site and not query:
        print("Error: provide --site, --search_text, or --search_news")
        return 1
    spark = build_session()
    snapshot = materialize(prepare_snapshot(spark.read.parquet(args.snapshot)), "snapshot")
    output = args.output
    if query:
        if not args.results:
            print("Error: searching needs --results")
            return 1
        hits = spark.read.parquet(args.results).filter(F.col("query") == query)
        mode = "text" if args.search_text else "news"
        pages = search_and_scrape(hits.select([c for c in hits.columns if c != "page_id"]), snapshot, mode, args.search_topk)
        pages = pages.filter(F.col("error").isNull())
    elif args.crawl:
        seeds = spark.createDataFrame([(args.site,)], "seed string")
        order = crawl(seeds, L.link_edges(snapshot), snapshot.select("url", "success"), args.max_pages, args.max_depth)
        pages = order.join(snapshot, "url")
        output += "/" + seeds.select(crawl_folder(F.col("seed"), F.current_timestamp())).first()[0]
    else:
        pages = snapshot.filter(F.col("url") == args.site)
    pages = materialize(pages.withColumn("folder", url_folder(F.col("url"))), "result")
    write_pages(pages, output)
    total, succeeded, size = crawl_summary(pages).first()
    print(f"Done - {succeeded}/{total} pages successfully extracted; output: {output}; mean page size: {size or 0:,.0f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
