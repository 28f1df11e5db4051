"""Ids against the library whose results are to be met, states against a plain walk, exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import byte_pairs as B

PARTS = [
    "'", "'", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", " ", " ", "\n", "\t", "\r\n", "12", "3", "é", "漢字", "😀", ".", "!", "　", "\u0085", "\x1c", "m", "d",
    "A", "\U00011380", " ", "́", "ab", "\x00", "½", "<|endoftext|>", "'S", "’s",
]
ODD = ["", None, " ", "'", "'s", " 's", "''s", "it's  a\r\n 's", "x" * 5000, " " * 4000, "\n \n x", "a b", "'re've'll", "'r'l", "naïve café", "1 23  456", "ab" * 30_000]


@pytest.fixture(scope="module")
def plain():
    with open(B.default_ranks(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


@pytest.fixture(scope="module")
def codec():
    with open(B.default_ranks(), "rb") as file:
        return B.Codec(file.read(), B.class_ranges())


def check(codec, plain, texts):
    counts, ids, starts = codec.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, begin, end in zip(texts, ends - counts, ends):
        own, data = ids[begin:end].tolist(), (text or "").encode()
        assert own == plain(text), text
        assert codec.decode(ids[begin:end]) == data
        pieces = [data[a:b] for a, b in zip(starts[begin:end], [*starts[begin + 1 : end], len(data)])]
        assert pieces == [codec.decode(np.array([i])) for i in own]


def test_ids_of_odd_texts(codec, plain):
    draw = random.Random(3)
    check(codec, plain, ODD + ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(4000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_ids_of_any_text(codec, plain, texts):
    check(codec, plain, texts)


def test_stretches_do_not_show(codec, plain, monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choices(PARTS, k=400)) for _ in range(30)]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(B, "SCAN_BYTES", size)
        check(codec, plain, texts)


def test_scan_equals_a_walk():
    rng = np.random.default_rng(0)
    for size in (0, 1, 255, 256, 257, 70_000):
        symbols = rng.integers(0, 2 * B.SYMBOLS, size).astype(np.uint8)
        want, state = [], B.DONE
        for s in symbols.tolist():
            want.append(state)
            state = int(B.GOES[state, s])
        got, last = B.states_before(symbols, B.DONE)
        assert got.tolist() == want and last == state


def test_cleared_cache(codec, plain, monkeypatch):
    monkeypatch.setattr(B, "KEPT_SLICES", 3)
    check(codec, plain, ["zqx zqv zqw zqy zqz zqx", "zqx zqv"])


def test_digest_of_rows(spark, plain):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(2, "twice", "c"), (2, "twice", "c"), (None, "no key", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(map(tuple, B.byte_bpe_digest(docs).collect()), key=repr)
    want = []
    for key, text, _ in rows:
        ids = plain(text)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert B.byte_bpe_digest(docs.limit(0)).count() == 0


def test_tables_of_ids(spark, plain):
    docs = spark.createDataFrame([(1, "a null's row"), (2, None)], "doc_id long, text string")
    coded = B.encoded(docs)
    assert {r.doc_id: (r.ids, r.starts) for r in coded.collect()} == {1: (plain("a null's row"), [0, 1, 6, 8]), 2: ([], [])}
    assert {r.doc_id: bytes(r.decoded) for r in B.decoded(coded).collect()} == {1: b"a null's row", 2: b""}
    made = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert B.decoded(made).first().decoded is None
