"""Training data and site lists stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.signals import LABEL_MAP
from pagewright.functions.text import nvl, strip

TRAINING_SCHEMA = "train_html array<struct<label:string,vendor:string,html:string>>"


def mapped_label(label):
    """Class of a raw label, NULL for an unknown one. Four fixed rows: a literal map, not a join."""
    table = F.create_map(*[F.lit(x) for pair in LABEL_MAP.items() for x in pair])
    return F.try_element_at(table, F.lower(strip(nvl(label))))


def labelled_pages(rows: DataFrame, include_neutral: bool = True) -> DataFrame:
    """Usable training rows: html trimmed, label mapped; empty and unknown rows are left out."""
    mapped = rows.select(strip(nvl(F.col("html"))).alias("html"), mapped_label(F.col("label")).alias("label"))
    kept = mapped.filter((F.col("html") != "") & F.col("label").isNotNull())
    return kept if include_neutral else kept.filter("label <> 'NEUTRAL'")


def skipped_labels(rows: DataFrame) -> DataFrame:
    """Unknown labels with their frequency."""
    unknown = rows.filter((strip(nvl(F.col("label"))) != "") & mapped_label(F.col("label")).isNull())
    return unknown.groupBy(F.lower(strip(F.col("label"))).alias("label")).agg(F.count("*").alias("n"))


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def read_training(spark: SparkSession, path: str, include_neutral: bool = True) -> DataFrame:
    """Training rows of `{"train_html": [{label, vendor, html}, ...]}` files."""
    files = spark.read.schema(TRAINING_SCHEMA).json(path, multiLine=True)
    return labelled_pages(files.select(F.inline("train_html")), include_neutral)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sites with their category and expectation."""
    return spark.read.schema("url string, category string, expected_unlock boolean, notes string").json(path, multiLine=True)
