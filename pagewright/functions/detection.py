"""Rule-based page classification as one array expression per page: no UDF, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.functions.text import fold_case, nvl, strip, visible_text


def _needle(pattern: str) -> str:
    """The literal that every match of `pattern` contains, lower-cased.

    It is a cheap substring guard; only signals that are more than a literal go on to
    a regular expression.
    """
    literal = re.sub(r"<title\[\^>\]\*>|\\b", "", pattern)
    literal = literal.split(".?")[0]
    return re.sub(r"\\(.)", r"\1", literal).lower()


def _is_literal(pattern: str) -> bool:
    return re.sub(r"\\([^\w])", "", pattern) == re.sub(r"[\\\[\]^*?]", "", re.sub(r"\\([^\w])", "", pattern))


def _hits(folded: Column, rows: list[tuple[str, str, int, str]]) -> Column:
    """Entries of the signals that occur, in table order; each pattern is a constant of the plan."""
    found = []
    for pattern, kind, weight, label in rows:
        hit = F.contains(folded, F.lit(_needle(pattern)))
        if not _is_literal(pattern):
            hit = hit & F.rlike(folded, F.lit("(?U)" + pattern.lower()))
        found.append(F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(weight).alias("weight"), F.lit(label).alias("label"))))
    return F.array_compact(F.array(*found))


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0), lambda acc, e: acc + e["weight"])


def _entry(condition: Column, page_type: str, weight: int, label: Column) -> Column:
    row = F.array(F.struct(F.lit(page_type).alias("type"), F.lit(weight).alias("weight"), label.alias("label")))
    return F.when(condition, row).otherwise(F.filter(row, lambda _: F.lit(False)))


def tag_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("<"))


def script_count(html: Column) -> Column:
    return F.regexp_count(F.lower(html), F.lit("<script"))


def visible_chars(html: Column) -> Column:
    return F.char_length(strip(visible_text(html)))


def strongest(entries: Column, value: str = "type") -> Column:
    """The value with the largest weight; of equals, the one that came first."""
    values = F.array_distinct(F.transform(entries, lambda e: e[value]))
    ranked = F.transform(
        values,
        lambda v, i: F.struct(
            _total(F.filter(entries, lambda e: e[value] == v)).alias("weight"), (-i).alias("order"), v.alias("value")
        ),
    )
    return F.array_max(ranked)["value"]


def with_detection(df: DataFrame, html: str = "html", out: str = "detection") -> DataFrame:
    """Add `out`: struct<is_blocked, page_type, confidence, reasons, score>.

    The steps are separate projections on purpose: each feeds several later
    expressions, and Catalyst keeps a projection apart when its result is used more
    than once.
    """
    size = F.char_length(F.col("__html"))
    step = (
        df.withColumn("__html", nvl(F.col(html)))
        .withColumn("__folded", fold_case(F.col("__html")))
        .withColumn("__hard", _hits(F.col("__folded"), S.HARD_SIGNALS))
        .withColumn(
            "__small",
            _entry(
                size < S.MIN_REAL_PAGE_CHARS,
                "BLOCKED",
                S.SMALL_PAGE_WEIGHT,
                F.concat(F.lit("HTML very small ("), size, F.lit(" bytes)")),
            ),
        )
        .withColumn(
            "__soft",
            F.when(
                _total(F.col("__hard")) + _total(F.col("__small")) >= S.SOFT_GATE_SCORE,
                _hits(F.col("__folded"), S.SOFT_SIGNALS),
            ).otherwise(F.filter(F.col("__small"), lambda _: F.lit(False))),
        )
        .withColumn("__tags", tag_count(F.col("__html")))
        .withColumn("__scripts", script_count(F.col("__html")))
        # Visible text is measured only on script-heavy pages.
        .withColumn("__visible", F.when(F.col("__scripts") > 3, visible_chars(F.col("__html"))))
    )
    sparse = _entry(
        (F.col("__tags") < 20) & (size < S.LARGE_PAGE_CHARS),
        "BLOCKED",
        S.SPARSE_DOM_WEIGHT,
        F.concat(F.lit("Sparse DOM (~"), F.col("__tags"), F.lit(" tags)")),
    )
    scripted = _entry(
        (F.col("__scripts") > 3) & (F.col("__visible") < 200),
        "CLOUDFLARE",
        S.SCRIPT_HEAVY_WEIGHT,
        F.concat(
            F.lit("High script/text ratio ("), F.col("__scripts"), F.lit(" scripts, "), F.col("__visible"), F.lit(" chars)")
        ),
    )
    empty_reasons = F.array(F.lit(f"HTML < {S.EMPTY_PAGE_CHARS} bytes (empty)"))
    step = (
        step.withColumn("__entries", F.concat(F.col("__small"), F.col("__hard"), F.col("__soft"), sparse, scripted))
        .withColumn("__score", _total(F.col("__entries")))
        .withColumn("__empty", size < S.EMPTY_PAGE_CHARS)
        .withColumn(
            "__type",
            F.when(F.col("__empty"), F.lit("EMPTY"))
            .when(F.col("__score") >= S.BLOCK_SCORE, strongest(F.col("__entries")))
            .when(F.col("__score") >= S.SUSPICIOUS_SCORE, F.lit("SUSPICIOUS"))
            .otherwise(F.lit("NORMAL")),
        )
    )
    score = F.when(F.col("__empty"), F.lit(100)).otherwise(F.col("__score"))
    detection = F.struct(
        (~F.col("__type").isin("NORMAL", "SUSPICIOUS")).alias("is_blocked"),
        F.col("__type").alias("page_type"),
        F.round(F.least(score / F.lit(100.0), F.lit(1.0)), 3).alias("confidence"),
        F.when(F.col("__empty"), empty_reasons)
        .otherwise(F.transform(F.col("__entries"), lambda e: e["label"]))
        .alias("reasons"),
        score.alias("score"),
    )
    scratch = [c for c in step.columns if c.startswith("__") and c not in df.columns]
    return step.withColumn(out, detection).drop(*scratch)


def is_success(html: Column, detection: Column) -> Column:
    """A page counts as fetched when it has HTML and was not classified as blocked."""
    return (F.char_length(nvl(html)) > 0) & ~F.coalesce(detection["is_blocked"], F.lit(True))
