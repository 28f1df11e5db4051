"""Searches and results against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import variants as V


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made_words(draw, count, letters, least=5, most=9):
    return sorted({"".join(draw.choices(letters, k=draw.randint(least, most))) for _ in range(count)})


@pytest.mark.parametrize("letters", ["a", "ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿÀ÷"])
def test_search_equals_brute_force(letters):
    draw = random.Random(len(letters))
    words = made_words(draw, 200, letters)
    draw.shuffle(words)
    held, asked = words[: len(words) * 2 // 3 + 1], [*words[len(words) // 3 :], "qqqqq", "abcdeq", letters[0] * 300]
    index = V.TwoWayIndex(held)
    for right in (True, False):
        query, word = V.one_error(index, asked, right)
        got = list(zip([asked[i] for i in query], [held[i] for i in word]))
        want = {(a, b) for a in asked for b in held if one_apart(a, b) and (b.startswith(a[: len(a) // 2]) if right else b.endswith(a[len(a) // 2 :]))}
        assert len(got) == len(set(got)) and set(got) == want


def test_counts_in_sequences():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 13, 500)
    wavelet = V.Wavelet(values, 4)
    low, high = np.sort(rng.integers(0, 501, (2, 60)), axis=0)
    value = rng.integers(0, 16, 60)
    before, upto, less = wavelet.rank(value, low, high)
    for i in range(60):
        part = values[low[i] : high[i]]
        assert (before[i], upto[i]) == ((values[: low[i]] == value[i]).sum(), (values[: high[i]] == value[i]).sum()) and less[i] == (part < value[i]).sum()
    which, found, a, b = wavelet.distinct(low, high)
    assert sorted(zip(which, found, b - a)) == sorted((i, v, c) for i in range(60) for v, c in Counter(values[low[i] : high[i]].tolist()).items())


def sample(seed):
    draw = random.Random(seed)
    words = made_words(draw, 120, "abcé", 5, 7) + ["straße", "ÉTUDES", "aaaaa", "aaaaaa", "aaaaaaa", "x" * 3000, "x" * 3001, "abcdé", "abcdè"]
    rows = []
    for key in range(60):
        text = " ".join(draw.choice(words[: draw.choice([20, len(words)])]) + draw.choice(["", ",", "7", "\n"]) for _ in range(60))
        rows.append((key, text.upper() if key % 7 == 0 else text))
    return [*rows, rows[3], (None, rows[4][1]), (None, rows[4][1]), (99, None), (100, ""), (101, "7 - 7"), (102, ("x" * 3000 + " ") * 4 + ("x" * 3001 + " ") * 9),
            (103, "chainaa " * 4 + "chainab " * 9 + "chainbb " * 20)]


@pytest.mark.parametrize("shard_words", [20_000, 150, 6])
def test_variants_equal_brute_force(spark, shard_words):
    rows = sample(5)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(map(tuple, V.spelling_variants(docs, shard_words=shard_words).collect()))
    want = brute(rows)
    assert got == want and any(r[2] != r[1] and r[1] for r in want)


def test_chains_lead_to_their_end(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("side", "w069"), ("other", "end")]
    got = dict(map(tuple, V.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w070" for w, _ in chain[:-1]} | {"other": "end"}


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (3, "onceword")], "doc_id long, text string")
    assert V.spelling_variants(docs).count() == 0
    assert V.spelling_variants(docs.limit(0)).count() == 0
