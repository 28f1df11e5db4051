"""Roots, updates and results against dense eigenproblems."""

import numpy as np
import pytest

from pagewright.llm import whitening as W


def dense(values, vectors, rho, v):
    return vectors @ np.diag(values) @ vectors.T + rho * np.outer(v, v)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_roots(size):
    rng = np.random.default_rng(size)
    for scale in (1.0, 1e-6, 1e6):
        poles, weights = np.sort(rng.random(size)) * scale, rng.random(size) ** 6 + 1e-12
        roots, delta = W.secular_roots(poles, weights, 2.5)
        want = np.linalg.eigvalsh(np.diag(poles) + 2.5 * np.outer(np.sqrt(weights), np.sqrt(weights)))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-13 * want[-1])
        assert np.allclose(delta, poles[:, None] - roots, atol=1e-13 * want[-1])


@pytest.mark.parametrize("case", ["plain", "equal", "pairs", "sparse", "none", "along", "tiny", "near"])
def test_one_update(case):
    rng = np.random.default_rng(5)
    size = 12
    vectors = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = np.sort(rng.random(size))
    v = rng.normal(size=size)
    if case == "equal":
        values[:] = 0.5
    if case == "pairs":
        values = np.repeat(values[::2], 2)
    if case == "near":
        values = 0.3 + np.arange(size) * 1e-15
    if case == "sparse":
        v = vectors[:, 2] + vectors[:, 7]
    if case == "along":
        v = vectors[:, 4] * 3
    if case == "none":
        v[:] = 0
    if case == "tiny":
        v *= 1e-200
    got, turned = W.updated(values, vectors, 1.7, v)
    assert np.allclose(turned.T @ turned, np.eye(size), atol=1e-14) and (np.diff(got) >= 0).all()
    assert np.allclose(turned @ np.diag(got) @ turned.T, dense(values, vectors, 1.7, v), atol=2e-14)


def test_spectra_join():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(700, 9)) @ rng.normal(size=(9, 9)) + 3
    data[100:140] = data[7]
    parts = []
    for own in (data[:300], data[300:301], data[301:], data[:0]):
        part = W.Spectrum(9)
        for row in own:
            part.add(row)
        parts.append(part)
    whole = parts[0]
    for part in parts[1:]:
        whole.join(part)
    away = data - data.mean(axis=0)
    assert whole.count == 700 and np.allclose(whole.mean, data.mean(axis=0))
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, away.T @ away, rtol=1e-10, atol=1e-8)


def brute(vectors):
    """Rows of the contract, with numpy's eigensolver; signs are free."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    away = (n * x - sums) / n
    values, turn = np.linalg.eigh(away.T @ away / n)
    values, turn = values[::-1], turn[:, ::-1]
    width = min(8, x.shape[1])
    real = values[:width] > values[0] * 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        white = np.where(real, away @ turn[:, :width] / np.sqrt(np.maximum(values[:width], 0)), np.nan)
    return ((n * x - sums) ** 2).sum(axis=1), white, values[:width] / values.sum(), n


def check(spark, rows, usable, schema="vec_id long, embedding array<float>, n string, component string", parts=5):
    got = {}
    for r in W.whitened(spark.createDataFrame([(*r, "c", "c") for r in rows], schema).repartition(parts, "vec_id")).collect():
        got[r.vec_id, r.component] = r
    deviation, white, explained, n = brute([v for _, v in usable])
    width = white.shape[1]
    assert len(got) == len({k for k, _ in usable}) * width
    for c in range(width):
        mine = np.array([np.nan if got[k, c + 1].whitened is None else got[k, c + 1].whitened for k, _ in usable])
        if np.isnan(white[:, c]).all():
            assert np.isnan(mine).all()
            continue
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-8
    for i, (k, _) in enumerate(usable):
        for c in range(width):
            r = got[k, c + 1]
            assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.explained - explained[c]) < 1e-9 and r.identity_error < 1e-9


def test_whitened_rows(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(20, 20)) * np.linspace(0.05, 1, 20)
    usable = [(i, v) for i, v in enumerate((rng.normal(size=(400, 20)) @ mix).astype(np.float32).tolist())]
    usable += [(500, usable[3][1]), (501, usable[3][1]), (-5, [0.0] * 20)]
    odd = [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1.0] * 7), (906, [1e30] + [0.0] * 19)]
    check(spark, usable + odd, usable)


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    usable = [(i, v) for i, v in enumerate(rng.normal(size=(150, 5)).astype(np.float32).tolist())]
    check(spark, usable, usable, parts=23)


@pytest.mark.parametrize("kind", ["few", "flat", "narrow"])
def test_little_variance(spark, kind):
    rng = np.random.default_rng(4)
    data = {"few": rng.normal(size=(4, 12)), "flat": rng.normal(size=(50, 2)) @ rng.normal(size=(2, 10)).round(1), "narrow": rng.normal(size=(30, 3))}[kind]
    if kind == "flat":  # whole multiples of 1/1024, so that the numbers have exactly two directions
        data = np.round(rng.normal(size=(50, 2)) * 1024) @ np.eye(2, 10) / 1024
    usable = [(i, v) for i, v in enumerate(data.astype(np.float32).tolist())]
    check(spark, usable, usable)


def test_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    got = W.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(3, 0, None, None, None)}
    assert W.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert W.whitened(spark.createDataFrame([], schema)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_numbers(spark):
    rows = [(1, [1e10, 0.0]), (2, [-1e10, 5.0]), (3, [3.0, 2.0])]
    got = {(r.vec_id, r.component): r for r in W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert [got[i + 1, 1].deviation for i in range(3)] == [w if w < 1 << 63 else None for w in want]
