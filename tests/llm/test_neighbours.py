"""Neighbours against brute force: exact where few, recall where many."""

import math

import numpy as np
import pytest

from pagewright.llm import neighbours as N

ROWS = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1, 0.0) for i, v in rows], ROWS)


def brute(rows, queries, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, vector in good:
        if q in queries:
            scores = sorted((-float(np.dot(np.float64(np.float32(vector)), np.float64(np.float32(v)))), i) for i, v in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_small_tables_are_answered_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(25)]
    rows += [(30 + i, rows[3][1]) for i in range(30)] + [(70, (np.array(rows[4][1]) * 5).tolist()), (4, rows[4][1])]
    rows += [(None, rows[1][1]), (80, None), (81, [0.0] * 8), (82, [float("nan")] + [1.0] * 7), (83, [float("inf")] + [1.0] * 7), (84, [None] + [1.0] * 7), (85, [1.0] * 5), (86, [])]
    docs = table(spark, rows)
    got = answers(N.nearest(docs, docs.where("vec_id % 5 = 0").select("vec_id")))
    want = brute(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=8)).tolist()) for i in range(1500)]
    docs = table(spark, rows)
    got = answers(N.nearest(docs, docs.where("vec_id % 20 = 0").select("vec_id"), pivots=64, probes=28, reranked=0.3))
    want = brute(rows, set(range(0, 1500, 20)), 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9 and all(len(v) == 20 for v in got.values())


def test_shards_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 7)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    docs = table(spark, rows)
    assert answers(N.nearest(docs, docs.select("vec_id"), k=5, probes=128, reranked=1.0)).keys() == {i for i, _ in rows}
    got, want = answers(N.nearest(docs, docs.select("vec_id"), k=5, probes=128, reranked=1.0)), brute(rows, set(range(120)), 5)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


@pytest.mark.parametrize("rows", [[], [(0, [1.0] * 8)], [(0, None)], [(0, [0.0] * 8), (20, None)]])
def test_nothing_to_find(spark, rows):
    docs = table(spark, rows)
    assert N.nearest(docs, docs.select("vec_id")).count() == 0


def test_footrule_by_gains_equals_the_sum_over_all_pivots():
    rng = np.random.default_rng(3)
    pivots = N.Pivots(rng.normal(size=(60, 4)), 5.0)
    ranks, order = pivots.ranks(rng.normal(size=(10, 4)), False)
    steps, worst = np.arange(N.PREFIX + 1), N.PREFIX
    gain = np.abs(steps[:, None] - steps[None, :]) - (worst - steps)[None, :]
    base = worst * (worst + 1) // 2
    for a in range(10):
        for b in range(10):
            want = np.abs(ranks[a].astype(int) - ranks[b]).sum()
            assert base + sum(gain[ranks[a, p], ranks[b, p]] for p in range(60) if ranks[a, p] < worst) == want
    assert (np.sort(order, axis=1) == np.arange(60)).all()
