"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

DataFrame functions only. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import let

# Characters before a span in which context words count.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
# Matches whose sizes are added up in one go; longer lists are sums of such stretches.
STRETCH = 64
# Spans below this score are not reported; the base kinds start above it.
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    The patterns use possessive repeats and start a run of characters at its beginning only (or
    where the match before ended, `\\G`): the matches are those of the plain pattern, in linear time and
    constant stack on runs of any length.
    """

    name: str
    pattern: str
    score: float
    context: str
    base: bool = True


_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|master|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|fax|mobile"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", 0.8, "iban|account|bank", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, r"\bssn\b|social security", False),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """Remainder of an account number: first four characters last, letters as 10 to 35."""
    plain = F.replace(text, F.lit(" "))
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    return F.aggregate(
        chars, F.lit(0),
        lambda rest, c: F.when(c <= "9", (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )


def _confirmed(kind: Kind, span: Column, count: Column) -> Column:
    """Whether the check of its kind confirms a span; where its neighbour is a match, that is a letter or digit."""
    match, other = span["match"], "[A-Za-z0-9]"
    alone = F.when(span["tail"] != "", ~F.right(span["tail"], F.lit(1)).rlike(other)).otherwise(span["place"] == 0) & (
        F.when(span["ahead"] != "", ~span["ahead"].rlike(other)).otherwise(span["place"] == count - 1)
    )
    if kind.name == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.name == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind.name == "iban":
        return F.when(alone, mod97(match) == 1).otherwise(False)
    if kind.name == "ssn":
        return alone & ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _running(values: Column) -> Column:
    """Running sums of integers. Lists only grow within a stretch and over the stretches, so that long ones do not take quadratic time."""

    def sums(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))

        def step(state, value):
            at = state["at"] + value
            return F.struct(at.alias("at"), F.concat(state["sums"], F.array(at)).alias("sums"))

        return F.aggregate(part, zero, step, lambda s: s["sums"])

    def stretch(number):
        return F.slice(values, number * STRETCH + 1, STRETCH)

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int"))
    parts = F.transform(numbers, lambda i: sums(stretch(i)))
    return let(
        parts,
        lambda inner: let(
            sums(F.transform(inner, lambda p: F.element_at(p, -1))),
            lambda outer: F.flatten(
                F.transform(inner, lambda p, i: F.transform(p, lambda v: v + F.get(outer, i) - F.element_at(p, -1)))
            ),
        ),
    )


def _spans(kind: Kind, text: Column, matches: Column) -> Column:
    """The confirmed spans of a kind whose score suffices, in time linear in the text.

    The pieces between the matches give the distances. Each match is checked and scored by what stands next to it.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string,score:double>>")
    count = F.size(matches)

    def item(p):
        tail, ahead = F.right(p["piece"], F.lit(CONTEXT_CHARS)), F.left(p["next"], F.lit(1))
        return F.struct(F.length(p["piece"]).alias("gap"), F.length(p["match"]).alias("size"), tail.alias("tail"), ahead.alias("ahead"), p["match"].alias("match"))

    def placed(pieces):
        rows = F.arrays_zip(F.slice(pieces, 1, count).alias("piece"), matches.alias("match"), F.slice(pieces, 2, count).alias("next"))
        return F.transform(rows, item)

    def before(items, s):
        """The characters before a span; the matches before it, of one character at least, fill up a short piece."""
        last = F.slice(items, F.greatest(s["place"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(s["place"], F.lit(CONTEXT_CHARS)))
        filled = F.transform(last, lambda i: F.concat(i["tail"], F.right(i["match"], F.lit(CONTEXT_CHARS))))
        return F.when(F.length(s["tail"]) >= CONTEXT_CHARS, s["tail"]).otherwise(
            F.right(F.concat(F.array_join(filled, ""), s["tail"]), F.lit(CONTEXT_CHARS))
        )

    def scored(items, ends):
        placed_items = F.transform(items, lambda i, k: F.struct(
            (F.get(ends, k) - i["size"]).alias("start"), F.get(ends, k).alias("end"), i["match"].alias("match"),
            i["tail"].alias("tail"), i["ahead"].alias("ahead"), k.alias("place"),
        ))

        def with_score(s):
            bonus = F.when(F.lower(before(items, s)).rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), (F.lit(kind.score) + bonus).alias("score"))

        kept = F.filter(placed_items, lambda s: _confirmed(kind, s, count))
        return F.filter(F.transform(kept, with_score), lambda s: s["score"] >= MIN_SCORE)

    found = let(
        let(F.split(text, kind.pattern, -1), placed),
        lambda items: let(_running(F.transform(items, lambda i: i["gap"] + i["size"])), lambda ends: scored(items, ends)),
    )
    return F.when(count > 0, found).otherwise(empty)


def _listed(name: str) -> Column:
    return F.transform(
        F.col(f"pii_{name}"), lambda s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["end"].cast("string"))
    )


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with one column per kind, `pii_<kind>`: array of (start, end, match, score), by start.

    Candidates that fail their check (part above 255, Luhn, mod 97, number of digits) are dropped
    and not retried. The score of a kind grows by `CONTEXT_BONUS` where a context word stands in
    the `CONTEXT_CHARS` characters before the span; spans below `MIN_SCORE` are dropped, so number groups
    that have no checksum count in context only. Null texts have no spans. Columns of `docs` stay as they are, but for
    those that are named `pii_<kind>` already, which are replaced.
    """
    body = "__pii_text"
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"__{kind.name}", F.regexp_extract_all(F.col(body), F.lit(kind.pattern), 0))
    for kind in KINDS:
        out = out.withColumn(f"pii_{kind.name}", _spans(kind, F.col(body), F.col(f"__{kind.name}")))
    return out.drop(body, *[f"__{kind.name}" for kind in KINDS])


def span_list(kinds: list[str]) -> Column:
    """`kind:start:end` of all spans, kinds as listed and each by start, joined by commas."""
    return F.array_join(F.concat(*[_listed(k) for k in kinds]), ",")


def personal_data_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans per row of `docs`; base kinds are those with a fixed definition."""
    base = [k.name for k in KINDS if k.base]
    found = personal_data(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    found = found.withColumn("base_spans", span_list(base)).withColumn("spans", span_list([k.name for k in KINDS]))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("key").alias(key), *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
