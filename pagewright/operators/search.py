"""Normalisation of stored search results and their join with page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.urls import result_url

TEXT_SCHEMA = "query string, rank int, title string, href string, body string"
NEWS_SCHEMA = "query string, rank int, date string, title string, body string, url string, image string, source string"
MODES = ("text", "news")


def run_search(results: DataFrame, mode: str, top_k: int = 20) -> DataFrame:
    """The first `top_k` results of each query with a `url` column.

    `results` is a stored result table (TEXT_SCHEMA or NEWS_SCHEMA). The rank filter is
    applied per task before the shuffle as well, so a query with very many rows is cheap.
    """
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"Unknown search mode '{mode}'. Use 'text' or 'news'.")
    if mode == "text" and "url" not in results.columns:
        results = results.withColumn("url", F.col("href"))
    order = W.partitionBy("query").orderBy("rank")
    return results.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k)


def extract_urls(results: DataFrame) -> DataFrame:
    """Results that lead to an http URL, with that URL in `url`."""
    href = F.col("href") if "href" in results.columns else F.lit("")
    url = F.col("url") if "url" in results.columns else F.lit(None).cast("string")
    return results.withColumn("url", result_url(url, href)).filter(F.col("url").isNotNull())


def scraped_results(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Search hits with their snapshot; a URL that is not in it carries an error instead of failing the run."""
    joined = urls.join(pages.withColumn("__hit", F.lit(True)), "url", "left")
    return joined.withColumn("error", F.when(F.col("__hit").isNull(), F.lit("not in snapshot"))).drop("__hit")


def search_summary(scraped: DataFrame) -> DataFrame:
    """Per query: URLs found, pages scraped."""
    return scraped.groupBy("query").agg(
        F.count("*").alias("urls_found"), F.count_if(F.col("error").isNull()).alias("scraped_results_count")
    )
