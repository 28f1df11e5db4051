"""Registered queries run; those with SQL equal it; the pipeline equals its parts done plainly."""

import os
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import decontamination, language
from pagewright.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES
from tests import oracle
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_near_copies import brute_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(LLM_ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ok, note = oracle.compare(spark, oracle.connect(FOLDER), SimpleNamespace(run=LLM_QUERIES[name], sql=LLM_ORACLE_SQL[name]), FOLDER)
    assert ok, note


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    from pagewright.llm import mixing, token_files

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    kept = {i for i, _ in brute_kept([(i, rows[i].text) for i in sorted(kept)])}
    kept = {i for i in kept if not brute_hits(rows[i].text, items)[4]}
    mix = mixing.mixed(docs.where(docs.doc_id.isin(sorted(kept))))
    times = {r.doc_id: r.taken // r.size for r in mix.collect() if r.taken}
    tokenizer = Tokenizer.from_file(token_files._default_tokenizer())
    at, want = 0, []
    for i in sorted(times):
        ids = [*tokenizer.encode(rows[i].text, add_special_tokens=False).ids, 2]
        for _ in range(times[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()), key=lambda r: r[1])
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words of a null key", "en", None, 3), (3, "some words here to keep", "en", "s", 9), (3, "some words here to keep", "en", "s", 9)]
    folder = f"{FOLDER}"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (rows, []):
            out = stage(spark, spark.createDataFrame(part, schema), folder)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert out.count() <= 3 * len(part)
    assert language.UNKNOWN and decontamination.WINDOW == 10
