"""SQL fragments shared by the oracle texts (DuckDB dialect)."""

from __future__ import annotations

from pagewright.functions import signals as S

AUTHORITY = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"

# Unicode whitespace, spelled out because RE2's \s is ASCII.
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def base_domain(url: str) -> str:
    return f"ltrim(lower(regexp_extract({url}, '{AUTHORITY}', 1)), 'w.')"


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(text: str) -> str:
    return strip(f"regexp_replace({text}, '[{WS}]+', ' ', 'g')")


def visible(html: str, filler: str = "") -> str:
    return f"regexp_replace({html}, '<[^>]+>', '{filler}', 'g')"


def count_of(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, {quote(needle)}, ''))) // {len(needle)})"


def _row(order: int, kind: str, weight: int, label: str, condition: str) -> str:
    return (
        f"{{'o': {order}, 't': {quote(kind)}, 'w': CASE WHEN {condition} THEN {weight} ELSE 0 END, 'l': {label}}}"
    )


def _signal_rows(rows: list[tuple[str, str, int, str]], start: int) -> str:
    return ",\n".join(
        _row(start + i, t, w, quote(label), f"regexp_matches(html, {quote(p)}, 'i')")
        for i, (p, t, w, label) in enumerate(rows)
    )


def detection_ctes(source: str, key: str) -> str:
    """CTEs ending in `detected(key, html, is_blocked, page_type, confidence, reasons, score)`.

    `source` is a SELECT that yields (key, html).
    """
    n_hard = len(S.HARD_SIGNALS)
    small = _row(
        0, "BLOCKED", S.SMALL_PAGE_WEIGHT,
        "'HTML very small (' || length(html) || ' bytes)'", f"length(html) < {S.MIN_REAL_PAGE_CHARS}",
    )
    tags = count_of("html", "<")
    scripts = count_of("lower(html)", "<script")
    shown = f"length({strip(visible('html'))})"
    sparse = _row(
        900, "BLOCKED", S.SPARSE_DOM_WEIGHT, f"'Sparse DOM (~' || {tags} || ' tags)'",
        f"{tags} < 20 AND length(html) < {S.LARGE_PAGE_CHARS}",
    )
    scripted = _row(
        901, "CLOUDFLARE", S.SCRIPT_HEAVY_WEIGHT,
        f"'High script/text ratio (' || {scripts} || ' scripts, ' || {shown} || ' chars)'",
        f"{scripts} > 3 AND {shown} < 200",
    )
    return f"""
src AS ({source}),
hard AS (
  SELECT {key}, html, list_filter([{small},
{_signal_rows(S.HARD_SIGNALS, 1)}], lambda x: x.w > 0) AS hits FROM src),
soft AS (
  SELECT {key}, html, hits, CASE WHEN coalesce(list_sum(list_transform(hits, lambda x: x.w)), 0) >= {S.SOFT_GATE_SCORE}
    THEN list_filter([{_signal_rows(S.SOFT_SIGNALS, n_hard + 1)}], lambda x: x.w > 0) ELSE [] END AS more FROM hard),
entries AS (
  SELECT {key}, html, list_concat(hits, more, list_filter([{sparse}, {scripted}], lambda x: x.w > 0)) AS es FROM soft),
flat AS (SELECT {key}, unnest(es) AS e FROM entries),
sums AS (SELECT {key}, e.t AS t, sum(e.w) AS w, min(e.o) AS o FROM flat GROUP BY 1, 2),
best AS (SELECT {key}, t FROM sums QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY w DESC, o) = 1),
scored AS (
  SELECT n.{key}, html, coalesce(list_sum(list_transform(es, lambda x: x.w)), 0)::INT AS s, es, t
  FROM entries n LEFT JOIN best b ON n.{key} = b.{key}),
typed AS (
  SELECT {key}, html, es, CASE WHEN length(html) < 100 THEN 100 ELSE s END AS score,
    CASE WHEN length(html) < 100 THEN 'EMPTY' WHEN s >= {S.BLOCK_SCORE} THEN t
         WHEN s >= {S.SUSPICIOUS_SCORE} THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS page_type FROM scored),
detected AS (
  SELECT {key}, html, page_type NOT IN ('NORMAL', 'SUSPICIOUS') AS is_blocked, page_type,
    round(least(score / 100.0, 1.0), 3)::DOUBLE AS confidence, score,
    CASE WHEN page_type = 'EMPTY' THEN 'HTML < 100 bytes (empty)'
         ELSE array_to_string(list_transform(es, lambda x: x.l), '|') END AS reasons FROM typed)"""


def _any(text: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in tokens) + ")"


def protection_cte(key: str) -> str:
    """CTE `protected`, on top of `detected`, with kind, vendor and next step."""
    hint = f"lower(page_type || ' ' || replace(reasons, '|', ' ') || ' ' || html)"
    why = "lower(replace(reasons, '|', ' '))"
    vendors = " ".join(f"WHEN contains(hint, {quote(n)}) THEN {quote(v)}" for n, v in S.VENDORS)
    steps = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in S.POLICY.items())
    return f"""
hinted AS (SELECT *, {hint} AS hint, {why} AS why FROM detected),
kinded AS (
  SELECT *, CASE
    WHEN regexp_full_match(html, '[{WS}]*') THEN 'EMPTY'
    WHEN page_type IN ('NORMAL', 'SUSPICIOUS') AND NOT is_blocked THEN 'ALLOW'
    WHEN page_type = 'ERROR' AND {_any('why', S.PROXY_FAULT_TOKENS)} THEN 'BROKEN_PROXY'
    WHEN page_type = 'RATE_LIMIT' THEN 'RATE_LIMIT'
    WHEN page_type = 'LOGIN' THEN 'LOGIN_WALL'
    WHEN page_type = 'JS_REQUIRED' THEN 'JS_REQUIRED'
    WHEN page_type IN ('CLOUDFLARE', 'CAPTCHA') THEN
      CASE WHEN {_any('why', S.INTERACTIVE_TOKENS)} THEN 'INTERACTIVE_CHALLENGE' ELSE 'SOFT_CHALLENGE_WAIT' END
    WHEN is_blocked THEN 'HARD_BLOCK' ELSE 'ALLOW' END AS kind,
    CASE {vendors} END AS vendor FROM hinted),
protected AS (SELECT *, CASE kind {steps} ELSE 'allow' END AS next_step FROM kinded)"""
