"""Ids against the tokenizer itself, exact round trips of blocks and files."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewright.llm import token_files as T

TEXTS = [
    "plain words, with commas. And a\nline feed", None, "", " ", "\n", "a  b", "x\n\ny", " lead", "trail ", "tab\there", "<|endoftext|>", " a <|endoftext|> b<|endoftext|>",
    "é b c d", "it's  a\r\ntest 's 12 3,4 we'll", "\x1c a", "ab" * 3000, "  \n \n q", " x  y　z", "w   v", "漢字 かな 😀 a😀b", "a\nb\nc", "\x00 \x01", "'s 't",
    "long text of words " * 20_000,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(T._default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_tokenizer(plain):
    counts, ids = T.Encoder(T._default_tokenizer()).encode(pa.array(TEXTS, pa.string()), 2)
    starts = np.cumsum(counts) - counts
    for text, a, n in zip(TEXTS, starts, counts):
        assert ids[a : a + n].tolist() == plain(text), text
    assert len(T.Encoder(T._default_tokenizer()).encode(pa.array([], pa.string()), 2)[1]) == 0


@pytest.mark.parametrize("kind", ["small", "outliers", "equal", "wide", "one"])
def test_blocks_round_trip(tmp_path, kind):
    rng = np.random.default_rng(0)
    ids = {
        "small": rng.integers(0, 100, 5000), "outliers": np.where(rng.random(300_000) < 0.02, rng.integers(0, 2**32, 300_000), rng.integers(50, 90, 300_000)),
        "equal": np.full(3000, 7), "wide": rng.integers(0, 2**32, 2048), "one": np.array([5]),
    }[kind].astype(np.uint32)
    counts = np.array([0, len(ids) // 3, 0, len(ids) - len(ids) // 3])
    writer = T.TokenFileWriter(str(tmp_path / "f"))
    writer.add([4, None], counts[:2], ids[: counts[1]])
    writer.add([-1, 9], counts[2:], ids[counts[1] :])
    writer.close()
    file = T.TokenFile(str(tmp_path / "f"))
    assert file.keys.to_pylist() == [4, None, -1, 9] and file.counts.tolist() == counts.tolist()
    assert (file.read(0, len(ids)) == ids).all() and (file.read(len(ids) // 2, len(ids) // 4) == ids[len(ids) // 2 :][: len(ids) // 4]).all()
    ends = np.cumsum(counts)
    assert file.checksums().tolist() == [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, counts)]
    if kind == "outliers":
        assert writer.at < len(ids) * 1.3


def test_files_hold_documents_in_order(spark, plain):
    rows = [(i * 3 % 50 - 5, t, "c") for i, t in enumerate(TEXTS)] + [(7, "same key", "c"), (7, "same key", "c"), (None, "null key", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = T.token_files(docs).collect()
    at, want = 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(text)
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    assert T.token_files(docs.limit(0)).count() == 0


def test_file_of_no_documents(tmp_path):
    writer = T.TokenFileWriter(str(tmp_path / "f"))
    writer.close()
    assert len(T.TokenFile(str(tmp_path / "f")).checksums()) == 0
