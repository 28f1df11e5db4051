"""String helpers that follow Python's notion of whitespace and letter case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as space,
# as the body of a Java character class under (?U).
SPACE = r"\s\x1c-\x1f"

# Letters outside ASCII that match an ASCII letter when case is ignored.
CASE_TWINS = "\u0130\u0131\u017f\u212a"
CASE_TWINS_ASCII = "iisk"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a name inside one expression.

    Columns are trees, so using a Python variable twice copies its whole expression;
    a one-element transform evaluates it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def nvl(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (SQL trim removes spaces only)."""
    return F.regexp_replace(col, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(col: Column) -> Column:
    return F.coalesce(col.rlike(rf"(?U)\A[{SPACE}]*\z"), F.lit(True))


def collapse_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"(?U)[{SPACE}]+", " "))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(col, F.lit(f"(?U)[^{SPACE}]+"))


def fold_case(col: Column) -> Column:
    """Lower-case so that a plain substring test equals a case-insensitive search.

    The four letters that only meet ASCII through case folding are rewritten first;
    the rewrite runs only on rows that hold one of them.
    """
    has_twin = F.lit(False)
    for letter in CASE_TWINS:
        has_twin = has_twin | F.contains(col, F.lit(letter))
    return F.lower(F.when(has_twin, F.translate(col, CASE_TWINS, CASE_TWINS_ASCII)).otherwise(col))


def visible_text(html: Column, filler: str = "") -> Column:
    """Drop everything that looks like a tag."""
    return F.regexp_replace(html, "<[^>]+>", filler)


def try_int(col: Column) -> Column:
    """Integer value of a string, or NULL where Python's int() would raise."""
    text = strip(col)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
