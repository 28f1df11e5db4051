"""Held-out accuracy, the fast classifier against the plain one, and odd texts."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import language as L

DOCS = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def sample(spark, n=300):
    rng = random.Random(5)
    parts = {"aa": "kra tol min dor esh".split(), "bb": "ué lao vié oux çan".split(), "cc": "schn ung keit ver äch".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([8, 60, 400]))]
        rows.append((i, " ".join(words), lang, "s", 0.5, "clash"))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    odd = [(1000, None, "aa", None, None, None), (1001, "", None, None, None, None), (1002, "12 ... 34 \x00", "bb", None, None, None),
           (None, "kra tol", None, None, None, None), (1003, "漢字", None, "s", 0.0, ""), (1004, "schnung " * 20_000, None, "s", 0.0, "")]
    rows = sample(spark) + odd
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    assert len(got) == len(rows)
    held = [(r[2], got[r[0]].lang_pred) for r in rows[:300] if got[r[0]].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred in ("aa", "bb", "cc") and got[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    kept = L.identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in kept.where("doc_id < 300").select("lang_pred").distinct().collect()} == {"clash"}
    filled = {r.doc_id: r.lang for r in kept.collect()}
    assert filled[None] == got[None].lang_pred and filled[1004] == "cc" and all(filled[r[0]] == r[2] for r in rows[:300])
    only = {r.doc_id for r in L.identified(docs, languages=["cc"], least_score=0.5).select("doc_id").collect()}
    assert only == {i for i, r in got.items() if r.lang_pred == "cc" and r.score >= 0.5}


def test_predictions_do_not_use_labels(spark):
    rows = sample(spark)
    docs = spark.createDataFrame(rows, DOCS)
    net = L.fit(docs)
    hidden = spark.createDataFrame([(r[0] + 7, r[1], None, None, None, None) for r in rows], DOCS)
    names = {r.text: r.lang_pred for r in L.predicted(docs.select("text"), net).collect()}
    assert all(names[r.text] == r.lang_pred for r in L.predicted(hidden.select("text"), net).collect())


def test_fast_and_plain_responses_agree():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b"], [rng.normal(size=(w, 256, L.FILTERS)).astype("f4") for w in L.WIDTHS],
                    [rng.normal(size=L.FILTERS).astype("f4") for _ in L.WIDTHS], rng.normal(size=(len(L.WIDTHS) * L.FILTERS, 2)).astype("f4"), np.zeros(2, "f4"))
    windows = rng.integers(0, 256, (70, L.WINDOW)).astype(np.uint8)
    hidden, _ = L._responses(net, windows)
    assert np.allclose(L.Classifier(net).probabilities(windows), L._softmax(hidden @ net.weights + net.bias), atol=1e-4)


def test_whole_text_counts():
    data = b"x" * (L.WINDOW * 2 + 5)
    windows = L._windows_of(data)
    assert windows.shape == (3, L.WINDOW) and windows[2, 5] == ord(" ")


@pytest.mark.parametrize("rows", [[], [(1, None, "aa", None, None, None)], [(1, "abc", None, None, None, None)]])
def test_nothing_to_learn(spark, rows):
    got = L.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_texts_go_to_python_once(spark):
    """One column of text in the rows that the stage sends to Python, besides lang, source and lang_pred."""
    docs = spark.createDataFrame(sample(spark, 40), DOCS)
    node = L.identified(docs)._jdf.queryExecution().analyzed()
    while "MapInArrow" not in node.nodeName():
        node = node.children().apply(0)
    sent = node.children().apply(0).output()
    assert sorted(sent.apply(i).dataType().typeName() for i in range(sent.size())) == ["double", "long", "string", "string", "string", "string"]


def test_stage_names_the_language_of_every_text(spark):
    """A prediction was used only where no language was given, however sure it was."""
    truth = {r[0]: r[2] for r in sample(spark)}
    held_out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = {i: "aa" if truth[i] == "bb" else "bb" for i in held_out[:20]}
    rows = [(*r[:2], wrong.get(r[0], r[2]), *r[3:]) for r in sample(spark)]
    rows = [*rows, (1000, "12 34", "aa", "s", 0.0, ""), (1001, "q", "bb", "s", 0.0, ""), (1002, "kra tol min dor esh " * 9, None, "s", 0.0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in L.language_id(docs).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert len(got) == len(rows) - 1 and 1000 not in got
    sure = [i for i in wrong if found[i].score > L.SURE]
    assert len(sure) > 4 and all(got[i].lang == truth[i] for i in sure)
    for i, text, lang, *rest in rows:
        if i != 1000:
            assert got[i].lang == (found[i].lang_pred if lang is None or found[i].score > L.SURE else lang)
            assert (got[i].text, got[i].source, got[i].score, got[i].lang_pred) == (text, *rest)
