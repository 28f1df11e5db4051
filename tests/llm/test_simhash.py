"""Fingerprints and components against brute force."""

import random
import re

import pytest
import xxhash

from pagewright.llm import simhash as S
from pagewright.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, component_id long"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest non-null key reachable over fingerprints of at most two different bits."""
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and group[j] > group[i]:
                    group[j] = group[i]
    return [min((k for (k, _), g in zip(rows, group) if g == group[i] and k is not None), default=None) for i in range(len(rows))]


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(300))
    words = base.split()
    rows = [(10, base), (4, base), (7, base.upper()), (7, base.upper()), (None, base), (1, None), (2, ""), (3, " \t\n"), (20, "one"), (21, "one two")]
    for i in range(30):
        changed = list(words)
        for _ in range(i % 6):
            changed[rng.randrange(300)] = f"new{i}"
        rows.append((100 + i, " ".join(changed)))
    rows += [(200, "É é ÀÀ a\x0bb\x1cc"), (201, "x" * 50_000), (202, "y " * 40_000), (None, "lonely text of a null key")]
    docs = spark.createDataFrame([(k, t, "clash", -1) for k, t in rows], DOCS)
    got = sorted(map(tuple, S.simhash_components(docs).collect()), key=str)
    want = sorted(((k, f"{brute_fingerprint(t):016x}", c) for (k, t), c in zip(rows, brute_components(rows))), key=str)
    assert got == want


@pytest.mark.parametrize("paired", [0, 2, 1000])
def test_links_of_crowded_blocks(spark, paired):
    """Few bits differ, so that every block is crowded; all ways to resolve it give the same components."""
    rng = random.Random(2)
    prints = {0, -1}
    for centre in (0, 0x0F0F0F0F0F0F0F0F, 1 << 62):
        for _ in range(40):
            value = centre
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(63)
            prints.add(value)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = S.linked_fingerprints(table, paired_block=paired)
    assert all(0 < ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    root = {r.node: r.root for r in connected_components(edges).collect()}
    group = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[b] > group[a]:
                    group[b], changed = group[a], True
    assert {p: root.get(p, p) for p in prints} == group


def test_empty_table_and_removal(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.simhash_components(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d", "", 0), (1, "a b c d", "", 0), (2, "other words here now", "", 0), (None, "null key", "", 0)], DOCS)
    kept = S.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, 6)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    root = {r.node: r.root for r in found.collect()}
    assert {root[i] for i in range(1, 61)} == {0} and {root[i] for i in range(1001, 1200)} == {1000}
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_rows_of_one_key_are_told_apart(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "a clean text of a null key"), (7, "a b c d"), (7, "a clean text of key seven")]
    kept = S.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
