"""Targets, flow and selection."""

import itertools

import pandas as pd
import pytest

from pagewright.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, taken string"


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(repeats * sizes[s]) for s in over}


def documents(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", ["b", "a", "c", None, "Z", "a"][i % 6], "x") for i in range(600)]
    rows += [(900, None, None, "a", None), (901, "", "en", "empty", None), (902, " \t\x0b", "en", None, None), (None, "null key here", "en", "b", None)]
    rows += [(5, "w " * 36, "en", None, "x"), (903, "long " * 30_000, "en", "a", None)]
    return spark.createDataFrame(rows, DOCS), rows


def test_mix(spark):
    docs, rows = documents(spark)
    got = M.mixed(docs).collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    taken = {}
    for key, text, _, source, _ in rows:
        if key != 5:
            r = by_id[key]
            assert (r.size, r.source_size) == (len((text or "").split()), sizes[source])
            assert r.target == pytest.approx(want[source])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(t - target) <= max(10, 0.03 * target) for (_, target), t in taken.items())
    assert sorted(map(str, M.mixed(docs).collect())) == sorted(map(str, got))


def test_repeated_rows_follow_the_mix(spark):
    docs, _ = documents(spark)
    docs = docs.where("doc_id <> 5")
    out = M.repeated(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.taken // r.size for r in M.mixed(docs).collect() if r.taken}
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(M.F.count("*").alias("n")).collect()} == want


def test_empty_and_single(spark):
    assert M.mixed(spark.createDataFrame([], DOCS)).count() == 0
    one = M.mixed(spark.createDataFrame([(1, "a b c", "en", None, "")], DOCS)).first()
    assert (one.size, one.source_size, one.target, one.taken) == (3, 3, 3.0, 3)
    none = M.mixed(spark.createDataFrame([(1, None, "en", "s", "")], DOCS)).first()
    assert (none.size, none.target, none.taken) == (0, 0.0, 0)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b", ["b"] if i % 10 == 1 else None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, also array<string>")
    got = M.mixed(docs, sources="also").collect()
    total = sum(r.taken for r in got)
    assert total == pytest.approx(1000, abs=20) and max(r.taken for r in got) <= 30


def cost(flow_by_pattern, sizes, repeats):
    """Convex cost of repetitions: r for each word of the r-th."""
    return sum(r * max(0, min(sizes[p], f - (r - 1) * sizes[p])) for p, f in flow_by_pattern.items() for r in range(1, repeats + 1))


def test_flow_is_a_cheapest_full_flow():
    """Against all flows of a small graph."""
    edges = pd.DataFrame(
        [("p", "x", 2, 3), ("q", "x", 1, 3), ("q", "y", 1, 4), ("r", "y", 2, 4)], columns=["pattern", "source", "size", "quota"]
    )
    sizes, quota = {"p": 2, "q": 1, "r": 2}, {"x": 3, "y": 4}
    best = None
    for f in itertools.product(range(7), repeat=4):
        used = dict(zip([("p", "x"), ("q", "x"), ("q", "y"), ("r", "y")], f))
        by_pattern = {p: sum(v for (a, _), v in used.items() if a == p) for p in sizes}
        by_source = {s: sum(v for (_, b), v in used.items() if b == s) for s in quota}
        if all(by_pattern[p] <= 3 * sizes[p] for p in sizes) and all(by_source[s] <= quota[s] for s in quota):
            key = (-sum(f), cost(by_pattern, sizes, 3))
            best = min(best or key, key)
    got = M._route(edges, 3)
    by_pattern = got.groupby("pattern")["flow"].sum().to_dict()
    assert (-got["flow"].sum(), cost(by_pattern, sizes, 3)) == best
    assert (got.groupby("source")["flow"].sum() <= pd.Series(quota)).all()


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_are_repeated_as_they_are_taken(spark, key):
    rows = [(key, " ".join(["w"] * (1 + i % 50)), "ab"[i % 2]) for i in range(200)] + [(1000 + i, "w w w", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = M.mixed(docs).where("taken > 0").select("doc_id", "size", "source_size", M.F.expr("taken DIV size").alias("n"))
    want = {}
    for r in mix.collect():
        want[r.doc_id, r.size, r.source_size] = want.get((r.doc_id, r.size, r.source_size), 0) + r.n
    sizes = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "ab"}
    got = {}
    for r in M.repeated(docs).collect():
        at = (r.doc_id, len(r.text.split()), sizes[r.source])
        got[at] = got.get(at, 0) + 1
    assert got == want and len(set(want.values())) > 1
