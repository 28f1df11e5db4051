"""Result tables, documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.detection import is_success, with_detection
from pagewright.functions.policy import with_protection
from pagewright.functions.text import nvl, word_count
from pagewright.functions.urls import base_domain, url_folder
from pagewright.operators.extract import extract_content


def crawl_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, successful pages, mean size of the successful ones."""
    ok = is_success(F.col("html"), F.col("detection"))
    return pages.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.round(F.avg(F.when(ok, F.char_length("html"))), 6).alias("avg_size"),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """One metadata record per page (17 fields), built from a page-result table.

    Expected columns: url, html, detection, clean_text, markdown; optional ones that are absent
    come out as NULL: driver_used, depth, elapsed, error, session_key, protection_type,
    engine_decision, attempt_trace, metrics, extracted_at.
    """

    def given(name: str, default=None):
        return F.col(name) if name in pages.columns else F.lit(default)

    d = F.col("detection")
    return pages.select(
        F.col("url").alias("target_url"),
        F.coalesce(given("extracted_at"), F.current_timestamp()).alias("extracted_at"),
        given("driver_used").cast("string").alias("driver_used"),
        given("depth", 0).cast("int").alias("crawl_depth"),
        F.coalesce(d["is_blocked"], F.lit(False)).alias("was_blocked"),
        F.coalesce(d["page_type"], F.lit("UNKNOWN")).alias("detection_type"),
        F.coalesce(d["score"], F.lit(0)).alias("detection_score"),
        given("elapsed").cast("double").alias("elapsed_seconds"),
        F.char_length(nvl(F.col("html"))).alias("html_size_bytes"),
        word_count(nvl(F.col("clean_text"))).alias("word_count"),
        F.char_length(nvl(F.col("markdown"))).alias("markdown_length"),
        given("error").cast("string").alias("error"),
        given("session_key").cast("string").alias("session_key"),
        given("protection_type").cast("string").alias("protection_type"),
        (F.to_json("engine_decision") if "engine_decision" in pages.columns else F.lit(None).cast("string")).alias("engine_decision"),
        (F.to_json("attempt_trace") if "attempt_trace" in pages.columns else F.lit(None).cast("string")).alias("attempt_trace"),
        (F.to_json("metrics") if "metrics" in pages.columns else F.lit("{}")).alias("extraction_metrics"),
    )


def page_results(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Fully processed pages: detection, protection, clean text, Markdown, folder."""
    found = with_protection(with_detection(pages))
    content = extract_content(pages, key)
    joined = found.join(content, key, "left")
    return joined.withColumn("protection_type", F.col("protection.kind")).withColumn("folder", url_folder(F.col("url")))


def release_payload(pages: DataFrame, stream_mode: bool) -> DataFrame:
    """Stream mode keeps results but no page sources."""
    return pages.drop("html", "normalized_html") if stream_mode else pages


def write_pages(pages: DataFrame, path: str, layout: str = "table") -> None:
    """Store page results.

    layout 'table': parquet tables `pages` and `metadata`, range-partitioned by (domain, url).
    Domains are neighbours in few files, so a filter on domain reads little, and a domain that
    holds a third of the pages is still spread over many files.
    layout 'files': one folder per page with raw.html, clean.txt and markdown.md parts. This
    makes several files per page and is meant for small exports.
    """
    if layout == "files":
        for column, name in (("html", "raw_html"), ("clean_text", "clean_txt"), ("markdown", "markdown_md")):
            if column in pages.columns:
                pages.select("folder", F.col(column).alias("value")).write.mode("overwrite").partitionBy("folder").text(
                    f"{path}/{name}"
                )
        meta = page_metadata(pages).withColumn("folder", url_folder(F.col("target_url")))
        meta.write.mode("overwrite").partitionBy("folder").json(f"{path}/metadata_json")
        return
    placed = pages.withColumn("domain", base_domain(F.col("url"))).repartitionByRange("domain", "url")
    placed.sortWithinPartitions("domain", "url").write.mode("overwrite").parquet(f"{path}/pages")
    page_metadata(pages).write.mode("overwrite").parquet(f"{path}/metadata")


def markdown_document(pages: DataFrame, job: str, order: str) -> DataFrame:
    """All pages of a job as one document. A job's pages are bounded by its page budget."""
    part = F.concat(F.lit("### URL: "), "url", F.lit("\n\n"), nvl(F.col("markdown")))
    parts = pages.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))).alias("parts"))
    return parts.select(job, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("document"))


def regression_report(sites: DataFrame, results: DataFrame, key: str = "url") -> DataFrame:
    """Expected against found, one row per listed site (12 fields).

    `results` has one row per `key`: driver_used, html, elapsed, detection, clean_text,
    protection_type, session_key. Where a URL is listed several times, both tables have to have another key.
    """
    joined = sites.join(results if key == "url" else results.drop("url"), key, "left")
    return joined.select(
        "url", "category", "expected_unlock", "driver_used",
        F.char_length(nvl(F.col("html"))).alias("html_size_bytes"),
        F.col("elapsed").alias("elapsed_seconds"),
        F.col("detection.page_type").alias("detection_type"),
        F.col("detection.score").alias("detection_score"),
        is_success(F.col("html"), F.col("detection")).alias("success"),
        F.char_length(nvl(F.col("clean_text"))).alias("usable_text_length"),
        "protection_type", "session_key",
    )


def attempt_log(attempts: DataFrame) -> DataFrame:
    """Log record of each attempt, ready to append: driver, path, protection, sizes, times."""
    return attempts.select(
        "domain", F.col("driver_name").alias("driver"), "path", "session_key", "blocked", "html_size", "elapsed",
        F.col("protection_signal").alias("protection"), "action_count",
    )


def result_line(url: str = "url", html: str = "html", detection: str = "detection"):
    """Short description of a page result."""
    status = F.when(is_success(F.col(html), F.col(detection)), F.lit("OK")).otherwise(F.lit("FAIL"))
    return F.format_string(
        "PageResult(%s depth=%d driver=%s size=%d url=%s)",
        status, F.col("depth"), F.col("driver_used"), F.char_length(nvl(F.col(html))), F.substr(F.col(url), F.lit(1), F.lit(60)),
    )
