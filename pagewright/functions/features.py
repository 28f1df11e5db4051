"""Text features that the page classifiers read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.detection import script_count, tag_count
from pagewright.functions.text import collapse_spaces, fold_case, nvl, strip, visible_text

# Fragments whose presence becomes a HAS_* token, in output order.
STRUCTURAL_TOKENS = [
    "cf_chl_", "challenge-platform", "cf-browser-verification",
    "g-recaptcha", "h-captcha", "data-sitekey", "jschl-answer",
    "_perimeterx", "akamai-abck", "datadome", "px-captcha",
    "verify you are human", "access denied", "too many requests",
    "login required", "sign in to continue", "enable javascript",
    "DDoS protection", "Attention Required", "unusual traffic",
    "automated queries", "bot detected",
]

# Fixed value: fragments kept as they stand in the word-vector feature string.
RAW_TOKENS = (
    r"(cf_chl_\w*|challenge-platform|cf-browser-verification|"
    r"g-recaptcha|hcaptcha|data-sitekey|jschl-answer|cf-ray|"
    r"akamai-abck|_perimeterx|datadome|px-captcha|__cf_bm|"
    r"cf-turnstile-response)"
)

TITLE_PATTERN = r"(?iUs)<title[^>]*>(.*?)</title>"


def has_title(html: Column) -> Column:
    return html.rlike(TITLE_PATTERN)


def title(html: Column) -> Column:
    """Trimmed content of the first title element; '' where there is none."""
    return strip(F.regexp_extract(html, TITLE_PATTERN, 1))


def visible(html: Column) -> Column:
    return collapse_spaces(visible_text(html, " "))


def _head(text: Column, n: int | None) -> Column:
    return text if n is None else F.substr(text, F.lit(1), F.lit(n))


def size_token(html: Column) -> Column:
    size = F.char_length(html)
    return F.when(size < 5000, F.lit("SIZE_TINY")).when(size < 20000, F.lit("SIZE_SMALL")).otherwise(F.lit("SIZE_LARGE"))


def tfidf_text(html: Column, title_chars: int | None = None, visible_chars: int | None = None) -> Column:
    """Feature string of the TF-IDF classifier, of the whole page unless limits are given."""
    page = nvl(html)
    folded = fold_case(page)
    seen = _head(visible(page), visible_chars)
    flags = [
        F.when(F.contains(folded, F.lit(t.lower())), F.lit("HAS_" + re.sub(r"[^a-zA-Z0-9]", "_", t).upper()))
        for t in STRUCTURAL_TOKENS
    ]
    return F.concat_ws(
        " ",
        F.when(has_title(page), F.concat(F.lit("TITLE_"), _head(title(page), title_chars))),
        seen,
        *flags,
        size_token(page),
        F.when(tag_count(page) < 20, F.lit("DOM_SPARSE")),
        F.when((script_count(page) > 5) & (F.char_length(seen) < 200), F.lit("SCRIPT_HEAVY_LOW_TEXT")),
    )


def word_vector_text(html: Column, title_chars: int | None = None, visible_chars: int | None = None) -> Column:
    """Feature string of the word-vector classifier (lower case), of the whole page unless limits are given."""
    page = nvl(html)
    return F.lower(
        F.concat_ws(
            " ",
            F.when(has_title(page), _head(title(page), title_chars)),
            _head(visible(page), visible_chars),
            F.regexp_extract_all(page, F.lit("(?iU)" + RAW_TOKENS), F.lit(1)),
            size_token(page),
        )
    )


def sentence_text(html: Column, chars: int | None = None) -> Column:
    """Input of the sentence encoder: the title twice, then visible text; `chars` is for encoders that read no more."""
    page = nvl(html)
    head = title(page)
    return _head(F.concat_ws(" ", head, head, visible(page)), chars)
