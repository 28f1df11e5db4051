"""Protection policy, routing and probe rules as CASE cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.functions.text import is_blank, nvl, strip


def _contains_any(text: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(text, F.lit(token))
    return found


def vendor_of(text: Column) -> Column:
    """First vendor whose name fragment occurs in lower-cased `text`."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, vendor in S.VENDORS:
        chain = chain.when(F.contains(text, F.lit(needle)), F.lit(vendor))
    return chain


def next_step(kind: Column) -> Column:
    """Recommended step of a protection kind. Nine fixed rows: a literal map, not a join."""
    table = F.create_map(*[F.lit(x) for pair in S.POLICY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("allow"))


def with_protection(
    df: DataFrame, html: str = "html", detection: str = "detection", out: str = "protection"
) -> DataFrame:
    """Add `out`: struct<kind, vendor, confidence, reasons, recommended_next_step>."""
    d = F.col(detection)
    page = nvl(F.col(html))
    reasons = F.coalesce(d["reasons"], F.array().cast("array<string>"))
    step = (
        df.withColumn("__type", F.upper(F.coalesce(F.nullif(d["page_type"], F.lit("")), F.lit("NORMAL"))))
        .withColumn("__why", F.lower(F.array_join(reasons, " ")))
        .withColumn(
            "__hint", F.concat_ws(" ", F.lower(F.col("__type")), F.col("__why"), F.lower(page))
        )
    )
    blocked = F.coalesce(d["is_blocked"], F.lit(False))
    page_type, why = F.col("__type"), F.col("__why")
    kind = (
        F.when(is_blank(page), F.lit("EMPTY"))
        .when(page_type.isin("NORMAL", "SUSPICIOUS") & ~blocked, F.lit("ALLOW"))
        .when((page_type == "ERROR") & _contains_any(why, S.PROXY_FAULT_TOKENS), F.lit("BROKEN_PROXY"))
        .when(page_type == "RATE_LIMIT", F.lit("RATE_LIMIT"))
        .when(page_type == "LOGIN", F.lit("LOGIN_WALL"))
        .when(page_type == "JS_REQUIRED", F.lit("JS_REQUIRED"))
        .when(
            page_type.isin("CLOUDFLARE", "CAPTCHA"),
            F.when(_contains_any(why, S.INTERACTIVE_TOKENS), F.lit("INTERACTIVE_CHALLENGE")).otherwise(
                F.lit("SOFT_CHALLENGE_WAIT")
            ),
        )
        .when(blocked, F.lit("HARD_BLOCK"))
        .otherwise(F.lit("ALLOW"))
    )
    step = step.withColumn("__kind", kind)
    signal = F.struct(
        F.col("__kind").alias("kind"),
        vendor_of(F.col("__hint")).alias("vendor"),
        F.coalesce(d["confidence"], F.lit(0.0)).alias("confidence"),
        reasons.alias("reasons"),
        next_step(F.col("__kind")).alias("recommended_next_step"),
    )
    return step.withColumn(out, signal).drop("__type", "__why", "__hint", "__kind")


def counts_as_failure(kind: Column) -> Column:
    """Browser attempts whose protection kind is booked as a failure of the domain."""
    return kind.isin(S.FAILURE_KINDS)


def browser_http_trust(kind: Column) -> Column:
    """Trust written with a booked browser failure: false, or NULL to leave it as it is."""
    return F.when(kind.isin(S.FAILURE_KINDS) & (kind != "RATE_LIMIT"), F.lit(False))


def probe_http_trust(kind: Column) -> Column:
    """Trust written with a rejected probe: false, or NULL to leave it as it is."""
    return F.when(kind.isin(S.DISTRUST_KINDS), F.lit(False))


def route(
    unlock_strategy: Column,
    allow_http_probe: Column,
    http_trust: Column,
    browser_success_count: Column,
    reference_text: Column,
    version: Column,
) -> Column:
    """Fetch route for a request on a domain: struct<path, reason, domain_state_version, ...>."""

    def decision(path: str, reason: str) -> Column:
        return F.struct(
            F.lit(path).alias("path"),
            F.lit(reason).alias("reason"),
            F.coalesce(version, F.lit(0)).alias("domain_state_version"),
            F.lit(None).cast("double").alias("similarity_score"),
            F.lit(None).cast("string").alias("escalated_from"),
        )

    proven = (F.coalesce(browser_success_count, F.lit(0)) >= S.MIN_BROWSER_SUCCESSES) & (nvl(reference_text) != "")
    return (
        F.when(
            F.coalesce(unlock_strategy, F.lit("unlock_first")) != "unlock_first",
            decision("browser", "unlock strategy override"),
        )
        .when(~F.coalesce(allow_http_probe, F.lit(True)), decision("browser", "HTTP probe disabled by request"))
        .when(F.coalesce(http_trust, F.lit(False)), decision("http_probe", "domain previously earned HTTP trust"))
        .when(proven, decision("http_probe_trial", "domain has repeated browser successes and can be trialed via HTTP"))
        .otherwise(decision("browser", "unknown or untrusted domain stays on browser waterfall"))
    )


def evaluate_probe(
    probe_text: Column, similarity: Column, is_blocked: Column, is_js_required: Column
) -> Column:
    """Accept or reject a plain-HTTP copy of a page: struct<accepted, reason, similarity, grant_http_trust>.

    `similarity` is NULL where there is no reference text.
    """

    def verdict(accepted: bool, reason: Column, sim: Column, trust: bool) -> Column:
        return F.struct(
            F.lit(accepted).alias("accepted"),
            reason.alias("reason"),
            sim.cast("double").alias("similarity"),
            F.lit(trust).alias("grant_http_trust"),
        )

    none = F.lit(None)
    shown = F.format_string("%.2f", similarity)
    return (
        F.when(F.coalesce(is_blocked, F.lit(False)), verdict(False, F.lit("HTTP probe was blocked"), none, False))
        .when(
            F.coalesce(is_js_required, F.lit(False)),
            verdict(False, F.lit("HTTP probe indicates JavaScript is required"), none, False),
        )
        .when(
            F.char_length(strip(nvl(probe_text))) < S.MIN_PROBE_TEXT_CHARS,
            verdict(False, F.lit("HTTP probe text too small to trust"), none, False),
        )
        .when(
            similarity.isNull(),
            verdict(True, F.lit("HTTP probe usable but there is no browser reference text yet"), none, False),
        )
        .when(
            similarity < S.MIN_SIMILARITY,
            verdict(
                False, F.concat(F.lit("HTTP probe diverged from browser reference ("), shown, F.lit(")")), similarity, False
            ),
        )
        .otherwise(
            verdict(
                True, F.concat(F.lit("HTTP probe matched browser reference ("), shown, F.lit(")")), similarity, True
            )
        )
    )
