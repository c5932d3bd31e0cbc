"""Whitening of vectors along the leading eigenvectors of their covariance.

Entries are cut to the integers floor(256 * c); larger than 64 bits can hold they
stay at the largest one. The covariance is taken over the different integer vectors
(the fit list), so that copies have no weight. Its leading eigenvalues are found by
spectrum slicing: the inertia of the LDL' form of V - s I counts the eigenvalues above
s, halving an interval by such counts isolates one eigenvalue, Rayleigh quotient
iteration closes in on it, and two further counts around the result prove its number.

Rows with a NULL vector or one with a NULL, NaN or infinite entry are left out; an
empty vector has no components and gives no row. Vectors of different lengths are an
error. Repeated rows and NULL ids stay. Only the id and the vector are read, so other
columns cannot clash. A direction with less than ``LEAST_SHARE`` of the variance
counts as none: there doubles do not tell a component from rounding, so there may be fewer
components than asked for, and none for an empty table or a single different vector.

What reaches the driver is bounded by the dimension d: sums, a d x d matrix and
d-vectors. Partial sums are merged in two levels before that.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize

SCALE = 256.0
LEAST_SHARE = 1e-11
FAN_IN = 64
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Counts and sums of the fit list, its leading eigenpairs and how well they whiten it."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Squared distance from the mean times n * n, in integers; NULL beyond 64 bits."""
        most = self.n * int(np.abs(x.astype(object) if x.min(initial=0) == -(2**63) else x).max(initial=0))
        most += max((abs(int(s)) for s in self.sums), default=0)
        if x.shape[1] * most * most < 2**63:
            gap = self.n * x - np.array([int(s) for s in self.sums], np.int64)
            return pa.array((gap * gap).sum(axis=1))
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix, read from its LDL' form with pivots of size 1 and 2."""
    a, n, k = np.array(matrix, np.float64), len(matrix), 0
    positive = negative = 0
    limit = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max(initial=0.0)
        single = abs(a[k, k]) >= limit * largest
        if not single:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            rest = row.max()
            if abs(a[k, k]) * rest >= limit * largest * largest:
                single = True
            elif abs(a[r, r]) >= limit * rest:
                single = True
                swap(k, r)
            else:
                swap(k + 1, r)
        if single:
            pivot = a[k, k]
            positive, negative = positive + (pivot > 0), negative + (pivot < 0)
            if pivot:
                column = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(column / pivot, column)
            k += 1
        else:
            positive, negative = positive + 1, negative + 1
            columns = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(a[k : k + 2, k : k + 2], columns.T)
            k += 2
    return positive, negative


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    """(matrix - shift I)^-1 right; an exactly singular shift is moved by rounding."""
    while True:
        try:
            return np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            shift += np.finfo(float).eps * scale


def leading_pairs(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a covariance, falling, and their unit vectors as rows.

    Ends before ``count`` where the variance does. Equal eigenvalues get orthogonal vectors.
    """
    d, trace = len(v), float(np.trace(v))
    values, vectors = [], np.zeros((0, d))
    if not trace > 0:
        return np.array(values), vectors
    eps = np.finfo(float).eps
    scale = float(np.abs(v).sum(axis=1).max())
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v - shift * np.eye(d))[0]
        return counts[shift]

    def iterated(low: float, high: float) -> tuple[float, np.ndarray, float]:
        """Inverse iteration from the middle, then Rayleigh quotients; nothing of earlier vectors stays in."""
        x = np.random.default_rng(len(values)).standard_normal(d)
        shift = (low + high) / 2
        for step in range(60):
            x = x - vectors.T @ (vectors @ x)
            x /= np.linalg.norm(x)
            quotient = float(x @ v @ x)
            left = float(np.linalg.norm(v @ x - quotient * x))
            if left <= 4 * d**0.5 * eps * scale:
                break
            if step >= 3 and low - left <= quotient <= high + left:
                shift = quotient
            x = _solved(v, shift, x, scale)
        x = x - vectors.T @ (vectors @ x)
        x /= np.linalg.norm(x)
        quotient = float(x @ v @ x)
        return quotient, x, float(np.linalg.norm(v @ x - quotient * x))

    for number in range(1, min(count, d) + 1):
        low, high = LEAST_SHARE * trace, scale * (1 + 4 * eps)
        if above(low) < number:
            break
        while True:
            while above(low) - above(high) > 1 and high - low > 8 * eps * scale:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= number else (low, middle)
            value, vector, left = iterated(low, high)
            reach = max(2 * left, 16 * d**0.5 * eps * scale)
            if above(value - reach) >= number and above(value + reach) < number:
                break
            if high - low <= 8 * eps * scale:
                raise ArithmeticError("an eigenvalue could not be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, their integer entries in a row, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.array(lists.values.to_numpy(zero_copy_only=False), np.float64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    of = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(of[~np.isfinite(flat)], minlength=len(sizes)) > 0
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    good = ~(odd | missing)
    entries = np.floor(SCALE * flat[good[of]])
    x = np.clip(entries, -(2.0**63), 2.0**62).astype(np.int64)
    x[entries > 2.0**62] = [min(int(e), 2**63 - 1) if np.isfinite(e) else 2**63 - 1 for e in entries[entries > 2.0**62]]
    return np.flatnonzero(good), x, sizes[good]


def _matrix(x: np.ndarray, sizes: np.ndarray, d: int) -> np.ndarray:
    if len(x) != d * len(sizes):
        raise ValueError(f"vectors of {d} entries expected, found {sorted(set(sizes.tolist()) - {0})}")
    return x.reshape(-1, d)


def _packed(rows: DataFrame, vector: str) -> DataFrame:
    """Each usable vector as bytes of the least width that holds its entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, sizes = integers(batch.column(0))
            out = []
            for part in np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []:
                least, most = int(part.min(initial=0)), int(part.max(initial=0))
                width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= least and most < 1 << (8 * w - 1))
                if len(part):
                    out.append(bytes([width]) + part.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["packed"])

    return rows.select(vector).mapInArrow(work, "packed binary")


def _unpacked(column: pa.Array, d: int | None) -> list[np.ndarray]:
    rows = [np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64) for b in column.to_pylist()]
    if d is not None and any(len(r) != d for r in rows):
        raise ValueError(f"vectors of {d} entries expected, found {sorted({len(r) for r in rows})}")
    return rows


def _summed(fit: DataFrame, d: int, rows: int, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of a ``rows`` x m matrix of doubles, merged in two levels."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(np.array(_unpacked(batch["packed"], d)))
                total = part if total is None else total + part
        if total is not None:
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.array(list(total), kinds)], names=["i", "row"])

    def merged(table: pa.Table) -> pa.Table:
        summed = np.sum(np.array(table["row"].to_pylist(), np.float64), axis=0)
        return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([summed], pa.list_(pa.float64()))})

    kind = "i int, row array<double>"
    parts = fit.mapInArrow(partial, kind).withColumn("_salt", F.spark_partition_id() % FAN_IN)
    inner = parts.groupBy("i", "_salt").applyInArrow(lambda table: merged(table.select(["i", "row"])), kind)
    whole = inner.groupBy("i").applyInArrow(merged, kind).collect()
    return np.array([r["row"] for r in sorted(whole, key=lambda r: r["i"])])


def _moments(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Count and exact sums per dimension of the fit list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for batch in batches:
            rows = _unpacked(batch["packed"], None)
            for d in {len(r) for r in rows}:
                x = np.array([r for r in rows if len(r) == d])
                exact = x if np.abs(x.astype(np.float64)).max() * len(x) < 2**62 else x.astype(object)
                n[d] = n.get(d, 0) + len(x)
                sums[d] = sums.get(d, 0) + exact.sum(axis=0).astype(object)
        for d in n:
            texts = pa.array([[str(s) for s in sums[d]]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n[d]], pa.int64()), texts], names=["d", "n", "sums"])

    parts = fit.mapInArrow(work, "d int, n long, sums array<string>").select("d", "n", F.posexplode("sums").alias("i", "s"))
    found = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    lengths = sorted({r["d"] for r in found})
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths}")
    if not found:
        return 0, np.zeros(0, object)
    return found[0]["n"], np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["i"])], object)


def fit_whitening(rows: DataFrame, vector: str = "embedding", count: int = 4) -> Whitening:
    """The leading ``count`` components of the different integer vectors of ``rows``."""
    fit = materialize(_packed(rows, vector).distinct(), "whitening-fit")
    n, sums = _moments(fit)
    d = len(sums)
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0)
    if not n:
        return model
    mean = model.mean
    scatter = _summed(fit, d, d, lambda x: (x - mean).T @ (x - mean))
    covariance = (scatter + scatter.T) / (2 * n)
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = leading_pairs(covariance, count)
    k = len(model.values)
    if k:
        frozen = Whitening(n, sums, model.values, model.vectors, model.trace)

        def spread(x: np.ndarray) -> np.ndarray:
            w = frozen.whiten(x)
            return np.vstack([w.sum(axis=0), w.T @ w])

        total = _summed(fit, d, k + 1, spread)
        middle = total[0] / n
        model.identity_error = float(np.abs(total[1:] / n - np.outer(middle, middle) - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component, numbered from 1."""
    d, k = len(model.sums), len(model.values)
    source = rows.select(F.col(key).alias(key), F.col(vector).alias("_vector"))
    explained = model.values / model.trace if k else model.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            good, x, sizes = integers(batch.column(1))
            good, sizes = good[sizes > 0], sizes[sizes > 0]
            x = _matrix(x, sizes, d)
            take = pa.array(np.repeat(good, k))
            columns = [
                batch.column(0).take(take),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(x) * k, model.n)),
                model.deviations(x).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(model.whiten(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, model.identity_error)),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(work, f"`{key}` {source.schema[0].dataType.simpleString()}, {OUT}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
