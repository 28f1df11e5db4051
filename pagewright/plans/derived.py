"""Inputs that Spark derives from the supplied tables, with the same derivation in SQL.

The supplied pages contain no challenge markers, so `marked_pages` gives every page one
marker (chosen by its id; no page is left out) and thereby reaches all classifier rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.plans.sql_parts import quote

SCRIPTS = "<script src=a></script>" * 5


def _example(pattern: str) -> str:
    text = pattern.replace("<title[^>]*>", "<title>").replace(r"\b", " ").replace(".?", "-")
    return re.sub(r"\\(.)", r"\1", text)


MARKERS = [""] + [_example(p) for p, *_ in S.HARD_SIGNALS + S.SOFT_SIGNALS]
# Besides the markers, three page shapes: nearly empty, tags removed, scripts without text.
N_FORMS = len(MARKERS) + 3


def marked_pages(pages: DataFrame) -> DataFrame:
    form = F.col("page_id") % N_FORMS
    marker = F.try_element_at(F.array(*[F.lit(m) for m in MARKERS]), (form + 1).cast("int"))
    html = (
        F.when(form == len(MARKERS), F.concat(F.lit("<p>"), F.col("page_id"), F.lit("</p>")))
        .when(form == len(MARKERS) + 1, F.regexp_replace("html", "<[^>]+>", ""))
        .when(form == len(MARKERS) + 2, F.concat(F.lit(SCRIPTS), F.repeat(F.lit("<i></i>"), 700)))
        .otherwise(F.concat(F.col("html"), F.coalesce(marker, F.lit(""))))
    )
    return pages.select("page_id", "url", html.alias("html"))


MARKED_PAGES_SQL = f"""
SELECT page_id, url, CASE
  WHEN page_id % {N_FORMS} = {len(MARKERS)} THEN '<p>' || page_id || '</p>'
  WHEN page_id % {N_FORMS} = {len(MARKERS) + 1} THEN regexp_replace(html, '<[^>]+>', '', 'g')
  WHEN page_id % {N_FORMS} = {len(MARKERS) + 2} THEN {quote(SCRIPTS)} || repeat('<i></i>', 700)
  ELSE html || [{", ".join(quote(m) for m in MARKERS)}][(page_id % {N_FORMS} + 1)::INT] END AS html
FROM pages"""


# Attempts: events as fetch attempts. Key = user, order = (time, id), blocked = an error event.
_DRIVERS = ["cloakbrowser", "seleniumbase", "http_probe", "nodriver"]
_VENDORS = [v for _, v in S.VENDORS]


def attempts(events: DataFrame) -> DataFrame:
    blocked = F.col("event_type") == "error"
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return events.select(
        "user_id",
        "ts",
        F.col("event_id").alias("attempt_id"),
        blocked.alias("blocked"),
        (~blocked).alias("success"),
        pick(_DRIVERS, F.col("event_id")).alias("driver"),
        F.concat(F.lit("s"), F.col("event_id") % 7).alias("session_key"),
        F.when(F.col("event_id") % 4 == 2, F.lit("http_probe")).otherwise(F.lit("browser")).alias("path"),
        F.when(blocked, pick(_VENDORS, F.col("event_id"))).alias("vendor"),
        F.when(F.col("event_type") == "click", F.round(F.col("value") / 100, 4)).alias("similarity"),
        F.when(F.col("event_type") == "view", F.col("event_id") % 2 == 0).alias("http_trust"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("reference "), F.col("props"))).alias("reference_text"),
    )


ATTEMPTS_SQL = f"""SELECT user_id, ts, event_id AS attempt_id, event_type = 'error' AS blocked, event_type <> 'error' AS success,
  [{", ".join(quote(d) for d in _DRIVERS)}][(event_id % {len(_DRIVERS)} + 1)::INT] AS driver, 's' || (event_id % 7) AS session_key,
  CASE WHEN event_id % 4 = 2 THEN 'http_probe' ELSE 'browser' END AS path,
  CASE WHEN event_type = 'error' THEN [{", ".join(quote(v) for v in _VENDORS)}][(event_id % {len(_VENDORS)} + 1)::INT] END AS vendor,
  CASE WHEN event_type = 'click' THEN round(value / 100, 4) END AS similarity,
  CASE WHEN event_type = 'view' THEN event_id % 2 = 0 END AS http_trust,
  CASE WHEN event_type = 'view' THEN 'reference ' || props END AS reference_text FROM events"""
