"""Whitening of vectors by principal components from rank-one updates.

Each task keeps the spectrum (mean, eigenvalues, eigenvectors) of the scatter of the vectors it has seen. One more vector changes
the scatter by a rank-one term: its eigenvalues are the roots of a secular equation between the old ones, its eigenvectors follow
from them; where the new direction or two eigenvalues coincide, the term deflates to fewer dimensions. Spectra of tasks are
combined in a tree, each eigenpair of the one being a rank-one update of the other, and so is the distance of the means.

A last pass over all vectors projects them on that basis and adds up the small matrix whose eigenvectors turn the basis into the
components (Rayleigh-Ritz). The whole basis takes part, so that what the updates lost to rounding is regained.

What reaches the driver is bounded by the dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize, release

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Entries from this magnitude on count as not finite: their whole numbers could not be summed exactly.
TOO_LARGE = float(1 << 40)
# Partial results that one task combines.
FAN_IN = 16
# Entries worked on at once.
SLICE = 1 << 20
EPS = np.finfo(np.float64).eps
STEPS = 60


# ---- Spectra --------------------------------------------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(weights / (poles - x)), and the distances pole i - root j.

    `poles` ascend, `weights` and `rho` are positive. Root j lies between pole j and the next one, the last within rho * sum(weights)
    of the last pole. Roots are kept as distances from the nearer pole; steps interpolate with both neighbouring poles and fall back
    to halving the bracket.
    """
    count = len(poles)
    reach = np.append(np.diff(poles), rho * weights.sum())
    middle = 1 + rho * (weights[:, None] / (poles[:, None] - (poles + reach / 2))).sum(axis=0)
    right = (middle < 0) & (np.arange(count) < count - 1)
    origin = np.arange(count) + right
    apart = poles[:, None] - poles[origin]
    low, high = np.where(right, -reach / 2, 0.0), np.where(right, 0.0, reach / 2)
    high[-1] = reach[-1]
    shift = np.where(right, -reach, 0.0)  # of pole j from the origin; the next one lies `reach` further
    at = (low + high) / 2
    before = np.triu(np.ones((count, count)))
    scaled = (rho * weights)[:, None]
    for _ in range(STEPS):
        delta = apart - at
        terms = scaled / delta
        value = 1 + terms.sum(axis=0)
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        if (np.abs(value) <= 4 * EPS * (1 + np.abs(terms).sum(axis=0))).all():
            break
        slopes = terms / delta
        slope = slopes.sum(axis=0)
        own = np.einsum("ij,ij->j", slopes, before)
        left, next_ = shift - at, shift + reach - at
        c = value - left * own - next_ * (slope - own)
        a = (left + next_) * value - left * next_ * slope
        b = left * next_ * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            moved = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        inside = (moved > low) & (moved < high)
        following = np.where(inside, moved, (low + high) / 2)
        if (following == at).all():
            break
        at = following
    return poles[origin] + at, apart - at


def updated(values: np.ndarray, vectors: np.ndarray, rho: float, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending values, vectors as columns) after rho * direction direction^T has been added; rho is not negative."""
    z = direction @ vectors
    size = z @ z
    rho *= size
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(size)
    least = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    close = np.diff(values) <= least
    if close.any():
        # Within equal values any basis will do: one reflection leaves the last vector of each run alone with the direction.
        vectors, edges = vectors.copy(), np.diff(np.concatenate([[False], close, [False]]).astype(np.int8))
        for begin, end in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0] + 1):
            part = z[begin:end].copy()
            length = np.sqrt(part @ part)
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            square = mirror @ mirror
            if square > 0:
                block = vectors[:, begin:end]
                block -= np.outer(block @ mirror, mirror * (2 / square))
            z[begin:end] = 0
            z[end - 1] = -np.copysign(length, part[-1])
    active = rho * np.abs(z) > least
    if not active.any():
        return values, vectors
    poles, own = values[active], z[active]
    roots, delta = secular_roots(poles, own * own, rho)
    delta[delta == 0] = np.finfo(np.float64).tiny
    # The direction of which these roots are exact: vectors made of it are orthogonal to working precision.
    ratio = poles[:, None] - poles
    np.fill_diagonal(ratio, 1.0)
    exact = np.copysign(np.sqrt(np.abs(np.prod(delta / ratio, axis=1))), own)
    turn = exact[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(axis=0))
    made = vectors[:, active] @ turn
    if active.all():
        return roots, made
    values, vectors = np.concatenate([values[~active], roots]), np.hstack([vectors[:, ~active], made])
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean, and spectrum of the scatter (sum of squares about the mean) of vectors."""

    def __init__(self, size: int):
        self.count, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, vector: np.ndarray) -> None:
        away = vector - self.mean
        self.values, self.vectors = updated(self.values, self.vectors, self.count / (self.count + 1), away)
        self.count += 1
        self.mean = self.mean + away / self.count

    def join(self, other: Spectrum) -> None:
        total = self.count + other.count
        if not other.count:
            return
        away = other.mean - self.mean
        self.values, self.vectors = updated(self.values, self.vectors, self.count * other.count / total, away)
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = updated(self.values, self.vectors, max(value, 0.0), vector)
        self.mean = self.mean + away * (other.count / total)
        self.count = total


# ---- Passes over the vectors ----------------------------------------------------------------------------------------------


def _numbers(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Usable rows as `(key, x)`, x whole numbers, and their dimensions; 0 where there are none."""
    own = rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    usable = own.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False))) & (F.size("v") > 0))
    common = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 0
    whole = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    return usable.where(F.size("v") == size).select(key, whole.alias("x")), size


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and whole numbers of a batch, a bounded number at once."""
    step = max(1, SLICE // size)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, size)


def _combined(parts: DataFrame, join: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """`parts(part, ...)` combined, `FAN_IN` at once, until one row is left; no row if there is none. Every level is stored."""
    parts = materialize(parts, "parts")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        groups = parts.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int"))
        fewer = materialize(groups.groupBy("group").applyInPandas(join, parts.schema), "parts")
        release(parts)
        parts, last = fewer, last // FAN_IN
    return parts


def _part() -> int:
    return TaskContext.get().partitionId()


def _totals(numbers: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(size, object)
        for batch in batches:
            for _, x in _slices(batch, size):
                count += len(x)
                safe = int(np.abs(x).max()) * len(x) < 1 << 62
                total += x.sum(axis=0, dtype=np.int64 if safe else object).astype(object)
        if count:
            wide = pa.array([int(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(range(-1, size), pa.int32()), "total": pa.concat_arrays([pa.array([count], pa.decimal128(38, 0)), wide]),
            })

    whole = numbers.select("x").withColumn("key", F.lit(0)).select("key", "x").mapInArrow(sums, "place int, total decimal(38,0)")
    found = {r["place"]: int(r["total"]) for r in whole.groupBy("place").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), [found[i] for i in range(size)] if found else []


class _Centred:
    """Vectors less their mean, from whole numbers; kept small so that it travels with the plan."""

    def __init__(self, count: int, sums: list[int]):
        self.count, self.sums = count, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """count * x - sums, exactly; as Python numbers where 64 bits could overflow."""
        largest = max(int(np.abs(x).max(initial=0)) * self.count, max(map(abs, self.sums)))
        kind = np.int64 if largest < 1 << 61 else object
        return x.astype(kind) * self.count - np.array(self.sums, kind)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.count).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of `scaled` per vector; null where it does not fit into 64 bits."""
        own = self.scaled(x)
        if own.dtype == object or float(np.abs(own).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
            return [d if (d := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in own]
        return (own * own).sum(axis=1).tolist()


_SPECTRUM = "part int, count long, mean array<double>, values array<double>, vectors array<double>"


def _as_frame(part: int, spectrum: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({
        "part": [part], "count": [spectrum.count], "mean": [spectrum.mean], "values": [spectrum.values], "vectors": [spectrum.vectors.ravel()],
    })


def _joined_spectra(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    size = len(rows["mean"].iloc[0])
    whole = Spectrum(size)
    for count, mean, values, vectors in zip(rows["count"], rows["mean"], rows["values"], rows["vectors"]):
        own = Spectrum(size)
        own.count, own.mean, own.values, own.vectors = count, np.array(mean), np.array(values), np.array(vectors).reshape(size, size)
        if whole.count:
            whole.join(own)
        else:
            whole = own
    return _as_frame(rows["part"].iloc[0] // FAN_IN, whole)


def spectrum(numbers: DataFrame, size: int, centred: _Centred) -> np.ndarray:
    """Orthonormal basis (columns) from the tasks' spectra."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(size)
        for batch in batches:
            for _, x in _slices(batch, size):
                for vector in centred(x):
                    own.add(vector)
        if own.count:
            columns = {"mean": own.mean, "values": own.values, "vectors": own.vectors.ravel()}
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([_part()], pa.int32()), "count": pa.array([own.count], pa.int64()),
                **{name: pa.array([column], pa.list_(pa.float64())) for name, column in columns.items()},
            })

    row = _combined(numbers.mapInArrow(of, _SPECTRUM), _joined_spectra).first()
    return np.linalg.qr(np.array(row["vectors"]).reshape(size, size)[:, ::-1])[0]


_MOMENTS = "part int, count long, mean array<double>, products array<double>"


def _joined_moments(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    count, mean = 0, np.zeros(len(rows["mean"].iloc[0]))
    products = np.zeros((len(mean), len(mean)))
    for n, m, p in zip(rows["count"], rows["mean"], rows["products"]):
        away = np.array(m) - mean
        products += np.array(p).reshape(products.shape) + np.outer(away, away) * (count * n / (count + n))
        mean, count = mean + away * (n / (count + n)), count + n
    return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN_IN], "count": [count], "mean": [mean], "products": [products.ravel()]})


def covariance(numbers: DataFrame, size: int, centred: _Centred, basis: np.ndarray) -> np.ndarray:
    """Covariance of the vectors projected on the columns of `basis`, centred before multiplying."""
    width = basis.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for _, x in _slices(batch, size):
                own = centred(x) @ basis
                mean = own.mean(axis=0)
                own -= mean
                parts.append((0, len(own), mean, (own.T @ own).ravel()))
                if len(parts) == FAN_IN:
                    parts = list(_joined_moments(pd.DataFrame(parts, columns=["part", "count", "mean", "products"])).itertuples(index=False, name=None))
        if parts:
            whole = _joined_moments(pd.DataFrame(parts, columns=["part", "count", "mean", "products"])).iloc[0]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([_part()], pa.int32()), "count": pa.array([whole["count"]], pa.int64()),
                **{name: pa.array([whole[name]], pa.list_(pa.float64())) for name in ("mean", "products")},
            })

    row = _combined(numbers.mapInArrow(of, _MOMENTS), _joined_moments).first()
    return np.array(row["products"]).reshape(width, width) / row["count"]


def components(numbers: DataFrame, size: int, centred: _Centred) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance; the largest entry of each vector is positive."""
    basis = spectrum(numbers, size, centred)
    inner = covariance(numbers, size, centred, basis)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    vectors = (basis @ turn)[:, ::-1]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(size)]
    return np.maximum(values[::-1], 0.0), vectors * np.where(largest < 0, -1.0, 1.0)


_WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Every usable vector on each of the first `count` components: `(key, component, n, deviation, whitened, explained, identity_error)`.

    Rows whose vector is null, empty, or has null or non-finite entries are left out, and so are entries of 2^40 or more in magnitude,
    whose whole numbers could not be summed exactly, and vectors of another length than the commonest (the smaller length if two
    are as common), which have no place in one covariance. Repeated rows and null keys count like others. With fewer dimensions there are
    fewer components. A component without variance has `whitened` null, and `explained` is null where there is no variance at all.
    `deviation` is null where it exceeds 64 bits. Other columns of `rows` are not read. No usable row, no rows.
    """
    numbers, size = _numbers(rows, key, vector)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_WHITENED}"
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums = _totals(numbers, size)
    centred = _Centred(n, sums)
    values, vectors = components(numbers, size, centred)
    width = min(count, size)
    trace = float(values.sum())
    real = values[:width] > values[0] * size * EPS * 4
    basis = vectors[:, :width] / np.where(real, np.sqrt(np.where(real, values[:width], 1.0)), np.inf)
    error = None
    if real.any():
        error = float(np.abs(covariance(numbers, size, centred, basis[:, real]) - np.eye(int(real.sum()))).max())
    explained = [float(v) / trace if trace > 0 else None for v in values[:width]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, x in _slices(batch, size):
                own = centred(x) @ basis
                each = np.repeat(np.arange(len(x)), width)
                yield pa.RecordBatch.from_pydict({
                    key: keys.take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(each), n), pa.int64()), "deviation": pa.array(centred.deviations(x), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(own.ravel(), pa.float64(), mask=~np.tile(real, len(x))),
                    "explained": pa.array(explained * len(x), pa.float64()), "identity_error": pa.array([error] * len(each), pa.float64()),
                })

    return numbers.mapInArrow(of, schema)
