"""Registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.byte_pairs import byte_bpe_digest
from pagewright.llm.context_mixing import scored
from pagewright.llm.decontamination import contamination
from pagewright.llm.language import language_id
from pagewright.llm.main_text import main_text
from pagewright.llm.mixing import mixed
from pagewright.llm.neighbours import nearest
from pagewright.llm.pii import personal_data_digest
from pagewright.llm.simhash import simhash_components
from pagewright.llm.token_files import token_files
from pagewright.llm.variants import spelling_variants
from pagewright.llm.warc import archived
from pagewright.llm.whitening import whitened


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(_table(spark, folder, "documents"))


def op2_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document."""
    return scored(_table(spark, folder, "documents"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixed(_table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data_digest(_table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The record of every page, read back from normalised archives."""
    found = archived(_table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id(_table(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the files."""
    return token_files(_table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words and items of the benchmark in every document."""
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    rows = _table(spark, folder, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0).select("vec_id"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first eight principal components, each of variance one."""
    return whitened(_table(spark, folder, "embeddings"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    return byte_bpe_digest(_table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word's commonest variant and where the variants lead."""
    return spelling_variants(_table(spark, folder, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_context_mixing": op2_context_mixing,
    "op3_main_text": op3_main_text,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_neighbours": op10_neighbours,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_WORDS9 = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS9} AS w FROM documents),
b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (
  SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.rid = hit.rid LEFT JOIN ids ON d.rid = ids.rid"""

def _spans_sql(kind: str, pattern: str, check: str) -> str:
    """(start, end, match) of the confirmed matches of a kind; `m` in `check` is one of them."""
    pairs = f"""list_transform(range(1, len(found) + 1), lambda i: {{
      's': list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0),
      'm': found[i]}})"""
    return f"""{kind} AS (SELECT rid, list_filter(list_transform({pairs}, lambda x: {{
      's': CAST(x.s AS BIGINT), 'e': CAST(x.s + length(x.m) AS BIGINT), 'm': x.m,
      'before': CASE WHEN x.s > 0 THEN substring(text, CAST(x.s AS BIGINT), 1) ELSE '' END,
      'after': substring(text, CAST(x.s + length(x.m) + 1 AS BIGINT), 1),
      'context': lower(substring(text, CAST(greatest(x.s - 39, 1) AS BIGINT), CAST(least(x.s, 40) AS BIGINT)))}}), lambda x: {check}) AS spans
      FROM (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces FROM d))"""


_DIGITS5 = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS5}) + 1), lambda i: CASE
  WHEN (length({_DIGITS5}) - i) % 2 = 0 THEN CAST({_DIGITS5}[i] AS INT)
  WHEN CAST({_DIGITS5}[i] AS INT) > 4 THEN 2 * CAST({_DIGITS5}[i] AS INT) - 9 ELSE 2 * CAST({_DIGITS5}[i] AS INT) END)) % 10 = 0"""
_ACCOUNT = "replace(x.m, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split({_ACCOUNT}[5:] || {_ACCOUNT}[1:4], ''),
  lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"""
_ALONE = "NOT regexp_matches(x.before, '[A-Za-z0-9]') AND NOT regexp_matches(x.after, '[A-Za-z0-9]')"
_IBAN = "[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)"
_OCTET5 = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_KINDS5 = [
    _spans_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _spans_sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(x.m, '{_OCTET5}\.{_OCTET5}\.{_OCTET5}\.{_OCTET5}')"),
    _spans_sql("card", "[0-9]([ -]?[0-9])+", f"CASE WHEN length({_DIGITS5}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END"),
    _spans_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS5}) BETWEEN 8 AND 15"),
    _spans_sql("iban", _IBAN, f"CASE WHEN {_ALONE} THEN {_MOD97} ELSE false END"),
    _spans_sql("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"""{_ALONE} AND NOT regexp_matches(x.m, '^(000|666|9)|-00-|0000$')
      AND regexp_matches(x.context, '\\bssn\\b|social security')"""),
]
_NAMES5 = ["email", "ip", "card", "phone", "iban", "ssn"]


def _joined5(names: list[str]) -> str:
    parts = ", ".join(f"list_transform({k}.spans, lambda x: '{k}:' || x.s || ':' || x.e)" for k in names)
    return f"array_to_string(list_concat({parts}), ',')"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents), {", ".join(_KINDS5)}
SELECT doc_id, {", ".join(f"CAST(len({k}.spans) AS BIGINT) AS n_{k}" for k in _NAMES5[:4])},
  sha256({_joined5(_NAMES5[:4])}) AS base_sha256, {_joined5(_NAMES5)} AS spans
FROM d {" ".join(f"JOIN {k} USING (rid)" for k in _NAMES5)}"""

OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
  string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
    ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))),
  lambda a, b: xor(a // 256, step[xor(a, b) % 256 + 1]))) AS h FROM runs, crc),
cut AS (SELECT c, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
fewer AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM fewer a JOIN fewer b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM fewer WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM fewer WHERE rest IN (SELECT word FROM words)),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON near.other = o.word GROUP BY near.word),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
  CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (
  SELECT word, root FROM walk WHERE root IN (SELECT word FROM formed WHERE form IS NULL)) USING (word)"""

LLM_ORACLE_SQL: dict[str, str] = {
    "op5_pii": OP5_SQL,
    "op9_decontamination": OP9_SQL,
    "op13_spelling_variants": OP13_SQL,
}
