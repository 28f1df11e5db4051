"""Spans against Python's expressions and plain checks."""

import hashlib
import random
import re
import time

import pytest

from pagewright.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def brute(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return [len(s) for s in found.values()], hashlib.sha256(joined.encode()).hexdigest()


TEXTS = [
    None, "", "mail me: a.b+c@ex-ample.co.uk, or @no or x@y", "a@b.c_d@e.f g@h..i@j.k", "é😀 1.2.3.4 and 1.2.3.4.5.6.7.8 999.1.1.1 001.0.0.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111", "+1 (555) 123-4567 +12 +1 2 +123456789012345678", "+1 (((((((",
    "x" * 50_000 + "@", "1" * 50_000, "1." * 30_000, "a@b" + ".c" * 20_000, "+1" + "(" * 30_000, ".".join(["12"] * 9), "5@6.7 " * 300,
]


def test_base_spans_equal_python(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("a1.@+-4 (_é%") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "1.1.1.1", "x"), (0, None, "x")], "doc_id long, text string, spans string")
    got = P.personal_data_digest(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            counts, digest = brute(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id][:80]
            assert r.base_sha256 == digest
    assert P.personal_data_digest(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    """Places and contexts across the stretches of a long list; the time does not grow with its square."""
    texts = ["+1 555 123 4567, " * 40_000, "12 " * 300_000, "5@6.7 10.0.0.1;" * 20_000 + "é" * 50 + "4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    started = time.time()
    for r in P.personal_data_digest(docs).collect():
        counts, digest = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
    assert time.time() - started < 90


def test_context_reaches_over_earlier_matches(spark):
    for many in (1, 3, 70, 200):
        text = "tel " + "+1 555 123 4567;" * many
        spans = P.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii_phone
        want = [0.6 + P.CONTEXT_BONUS * ("tel" in text[max(0, 4 + 16 * k - P.CONTEXT_CHARS) : 4 + 16 * k]) for k in range(many)]
        assert [s.score for s in spans] == pytest.approx(want)


@pytest.mark.parametrize(
    "text,spans",
    [
        ("pay to GB82WEST12345698765432 now", "iban:7:29"),
        ("DE89 3704 0044 0532 0130 00 AND more", "iban:0:27"),
        ("DE88 3704 0044 0532 0130 00", ""),
        ("XGB82WEST12345698765432", ""),
        ("my SSN is 123-45-6789.", "ssn:10:21"),
        ("part 123-45-6789 in stock", ""),
        ("ssn 000-45-6789", ""),
        ("ssn 123-45-6789x", ""),
        ("123-45-6789 ssn 123-45-6789", "ssn:16:27"),
    ],
)
def test_added_kinds(spark, text, spans):
    got = P.personal_data_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == spans and got.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_context_moves_the_score(spark):
    docs = spark.createDataFrame([(1, "call +1 555 123 4567"), (2, "size +1 555 123 4567")], "doc_id long, text string")
    score = {r.doc_id: r.pii_phone[0].score for r in P.personal_data(docs).collect()}
    assert score[1] == pytest.approx(score[2] + P.CONTEXT_BONUS)
    assert P.personal_data(docs).columns[:2] == docs.columns
