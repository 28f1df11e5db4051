import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.functions.detection import with_detection
from pagewright.functions.policy import with_protection
from pagewright.operators.ensemble import apply_consensus
from pagewright.plans.derived import _example

P = "<p>" + "lorem ipsum dolor " * 20 + "</p>"
BIG = P * 20
RICH = "<html>" + "<p>word</p>" * 30

CASES = [
    ("tiny", "<p>hi</p>", "EMPTY", 100),
    ("short_plain", "<html><body>" + P + "</body></html>", "BLOCKED", 45),
    ("small_rich", RICH + "</html>", "SUSPICIOUS", 25),
    ("big", BIG, "NORMAL", 0),
    ("big_cf", BIG + '<div id="cf-browser-verification"></div>', "CLOUDFLARE", 45),
    ("big_recaptcha", BIG + '<div class="g-recaptcha"></div>', "CAPTCHA", 60),
    ("big_429", "<title>429 Too Many Requests</title>" + BIG, "RATE_LIMIT", 95),
    ("big_login", BIG + "<p>Sign in to continue</p>", "LOGIN", 45),
    ("big_js", BIG + '<div id="root"></div>', "SUSPICIOUS", 35),
    ("big_dns", BIG + "<p>DNS_PROBE_FINISHED_NXDOMAIN</p>", "ERROR", 60),
    ("big_brand", BIG + "<p>Cloudflare captcha</p>", "NORMAL", 0),
    ("small_brand", RICH + "<p>Cloudflare captcha access denied unusual traffic</p></html>", "BLOCKED", 51),
    ("script_heavy", "<script src=a></script>" * 5 + "<i></i>" * 700, "SUSPICIOUS", 20),
    ("kelvin", BIG + "<p>robot checK</p>", "SUSPICIOUS", 40),
    ("long_s", BIG + "<p>acceſſ denied requeſt blocked</p>", "SUSPICIOUS", 48 - 8 + 8),
]


def score_by_hand(html):
    """Independent scorer with plain regular expressions."""
    if len(html) < 100:
        return "EMPTY", 100, ["HTML < 100 bytes (empty)"]
    entries = []
    if len(html) < 5000:
        entries.append(("BLOCKED", 25, f"HTML very small ({len(html)} bytes)"))
    entries += [(t, w, lab) for p, t, w, lab in S.HARD_SIGNALS if re.search(p, html, re.I)]
    if sum(w for _, w, _ in entries) >= 25:
        entries += [(t, w, lab) for p, t, w, lab in S.SOFT_SIGNALS if re.search(p, html, re.I)]
    tags = html.count("<")
    if tags < 20 and len(html) < 20000:
        entries.append(("BLOCKED", 20, f"Sparse DOM (~{tags} tags)"))
    scripts, shown = html.lower().count("<script"), len(re.sub(r"<[^>]+>", "", html).strip())
    if scripts > 3 and shown < 200:
        entries.append(("CLOUDFLARE", 20, f"High script/text ratio ({scripts} scripts, {shown} chars)"))
    score = sum(w for _, w, _ in entries)
    sums = {}
    for t, w, _ in entries:
        sums[t] = sums.get(t, 0) + w
    kind = max(sums, key=sums.get) if score >= 45 else "SUSPICIOUS" if score >= 20 else "NORMAL"
    return kind, score, [lab for *_, lab in entries]


def detect(spark, pages):
    rows = with_detection(spark.createDataFrame(list(enumerate(pages)), "i int, html string")).collect()
    return [r.detection for r in sorted(rows, key=lambda r: r.i)]


def test_known_pages(spark):
    found = detect(spark, [html for _, html, *_ in CASES[:-1]])
    assert [(d.page_type, d.score) for d in found] == [(t, s) for *_, t, s in CASES[:-1]]


def test_against_plain_scorer(spark):
    signals = [_example(p) for p, *_ in S.HARD_SIGNALS + S.SOFT_SIGNALS]
    pages = [html for _, html, *_ in CASES]
    pages += [base + m for m in signals for base in (BIG, RICH)]
    pages += [BIG + a.upper() + b for a, b in zip(signals, reversed(signals))]
    pages += ["x" * 99, "x" * 100, "<" * 19 + "y" * 200, " " * 150 + "<script>" * 4]
    for html, d in zip(pages, detect(spark, pages)):
        kind, score, reasons = score_by_hand(html)
        assert (d.page_type, d.score, d.reasons) == (kind, score, reasons), html[-80:]
        assert d.is_blocked == (kind not in ("NORMAL", "SUSPICIOUS"))
        assert d.confidence == round(min(score / 100, 1), 3)


@pytest.mark.parametrize(
    "page_type, blocked, reasons, html, kind, vendor",
    [
        ("NORMAL", False, ["Article mentions Cloudflare earnings"], "<b>Cloudflare</b>", "ALLOW", "Cloudflare"),
        ("CLOUDFLARE", True, ["CF browser verification element"], "<input/>", "INTERACTIVE_CHALLENGE", "Cloudflare"),
        ("CLOUDFLARE", True, ["CF challenge JS token"], "<input/>", "SOFT_CHALLENGE_WAIT", "Cloudflare"),
        ("ERROR", True, ["Chrome DNS probe error"], "<p>", "BROKEN_PROXY", None),
        ("ERROR", True, ["Chrome main frame error div"], "<p>", "HARD_BLOCK", None),
        ("LOGIN", True, [], "<p>", "LOGIN_WALL", None),
        ("BLOCKED", True, ["Imperva page"], " \n ", "EMPTY", "Imperva"),
    ],
)
def test_protection(spark, page_type, blocked, reasons, html, kind, vendor):
    row = spark.createDataFrame([(html,)], "html string").withColumn(
        "detection",
        F.struct(
            F.lit(blocked).alias("is_blocked"), F.lit(page_type).alias("page_type"), F.lit(0.5).alias("confidence"),
            F.array(*[F.lit(r) for r in reasons]).cast("array<string>").alias("reasons"), F.lit(1).alias("score"),
        ),
    )
    signal = with_protection(row).first().protection
    assert (signal.kind, signal.vendor, signal.recommended_next_step) == (kind, vendor, S.POLICY[kind])


def test_consensus_replaces_only_ambiguous_results(spark):
    pages = with_detection(spark.createDataFrame([(1, RICH + "</html>"), (2, BIG), (3, CASES[1][1])], "i int, html string"))
    vote = F.struct(
        F.lit(True).alias("is_blocked"), F.lit("CAPTCHA").alias("page_type"), F.lit(0.9).alias("confidence"),
        F.lit("m").alias("model"),
    )
    rows = {r.i: r.detection for r in apply_consensus(pages.withColumn("votes", F.array(vote, vote))).collect()}
    assert (rows[1].page_type, rows[1].score, rows[1].is_blocked) == ("CAPTCHA", 90, True)
    assert rows[2].page_type == "NORMAL" and rows[3].page_type == "BLOCKED"
