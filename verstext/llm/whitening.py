"""Whitening of vectors by spectral divide and conquer with polar decompositions.

The covariance of the distinct vectors is summed up by Spark from centred partial products and is the
only thing, with sums and a count, that reaches the driver: its size is the square of the number of
dimensions, whatever the number of rows. There the polar factor U of the covariance less a shift, found by
the QR-based dynamically weighted Halley iteration, gives the projector (U + I) / 2 on the eigenvectors
above the shift. Range and complement of the projector are invariant subspaces, in which the
covariance is split again until every part has one dimension. Rows are whitened in tasks that get the
mean and the few leading components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verstext.runtime import materialise

EPS = float(np.finfo(np.float64).eps)
LARGEST = float(2**52)  # whole numbers below this are exact in double precision
WIDEST = 10**38


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by the QR-based dynamically weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    eye = np.eye(n)
    try:
        low = 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))
    except np.linalg.LinAlgError:
        low = 0.0
    low = float(np.clip(low, EPS / 8, 1.0))  # of the singular values
    for _ in range(40):
        before = x
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))[0]
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray, scale: float):
    """Bases of the two invariant subspaces above and below a shift, or None if all eigenvalues are equal."""
    n = len(a)
    a = (a + a.T) / 2
    middle = np.trace(a) / n
    if np.linalg.norm(a - middle * np.eye(n)) <= n * EPS * scale:
        return None
    best = None
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    # the mean always lies between the eigenvalues; the others are tried for even halves or if it meets one
    for shift in (np.median(np.diag(a)), middle, middle + 0.01 * spread / n, middle - 0.01 * spread / n):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        basis = np.random.default_rng(n).standard_normal((n, rank))
        for _ in range(2):
            basis = np.linalg.qr(projector @ basis)[0]
        whole = np.linalg.qr(basis, mode="complete")[0]
        above, below = whole[:, :rank], whole[:, rank:]
        error = np.linalg.norm(above.T @ a @ below)
        if best is None or error < best[0]:
            best = error, above, below
        if error <= 4 * n * EPS * scale:
            break
    return None if best is None else best[1:]


def leading_eigenvectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues in falling order and their unit eigenvectors as columns.

    Subspaces below the wanted ones are not split further.
    """
    scale = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    parts = [np.eye(len(a))]
    while parts and len(found) < count:
        basis = parts.pop()
        halves = split(basis.T @ a @ basis, scale) if basis.shape[1] > 1 else None
        if halves is None:
            found += list(basis.T)
        else:
            above, below = halves
            parts += [basis @ below, basis @ above]
    vectors = np.linalg.qr(np.array(found).T)[0] if found else np.zeros((len(a), 0))
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Fit:
    """Sums and count of the distinct vectors of one length, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - sum) squared, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        kind = np.int64 if len(self.sums) * largest**2 < 2**63 else object
        apart = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) for v in (apart * apart).sum(axis=1)]


def whole_vectors(vectors: DataFrame, key: str, vector: str, steps: int) -> DataFrame:
    """``key, dim, x``: floor(steps * component) of the rows whose components are all given and finite."""
    size = F.transform(vector, lambda v: F.abs(v.cast("double")) * F.lit(float(steps)))
    usable = F.forall(size, lambda v: v.isNotNull() & ~F.isnan(v) & (v < F.lit(LARGEST)))
    rows = vectors.where(F.col(vector).isNotNull()).where(F.coalesce(usable, F.lit(False)))
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(steps))).cast("long"))
    return rows.select(F.col(key).alias("key"), F.size(vector).alias("dim"), x.alias("x")).where("dim > 0")


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, positions, matrix) of the vectors of a batch."""
    lists = batch.column(column)
    dims = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, flat.astype(np.int64).reshape(len(at), dim)


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of distinct vectors and their exact sums, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in by_length(batch, 0):
                n, total = held.get(dim, (0, [0] * dim))
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                held[dim] = n + len(at), [t + (int(h) << 26) + int(v) for t, h, v in zip(total, high, low, strict=True)]
        rows = [(dim, place, n, Decimal(t)) for dim, (n, total) in held.items() for place, t in enumerate(total)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["dim", "place", "n", "total"])

    found = distinct.mapInArrow(run, "dim int, place int, n long, total decimal(38,0)")
    rows = found.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim", "place").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.total))
    return out


def products(distinct: DataFrame, prepare: dict) -> dict[int, np.ndarray]:
    """Sum of the outer products of ``prepare[dim](x)`` over the distinct vectors, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch, 0):
                if dim in prepare:
                    y = prepare[dim](x)
                    held[dim] = held.get(dim, 0) + y.T @ y
        for dim, total in held.items():
            i, j = np.triu_indices(len(total))
            columns = [np.full(len(i), dim, np.int32), i.astype(np.int32), j.astype(np.int32), total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "i", "j", "total"])

    found = distinct.mapInArrow(run, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    out: dict[int, np.ndarray] = {}
    for r in found.collect():
        square = out.setdefault(r.dim, {})
        square[r.i, r.j] = square[r.j, r.i] = r.total
    return {d: np.array([[s[i, j] for j in range(k)] for i in range(k)]) for d, s in out.items() for k in [round(len(s) ** 0.5)]}


def centred(sums: dict[int, tuple[int, list[int]]]) -> dict:
    means = {dim: np.array([s / n for s in total]) for dim, (n, total) in sums.items()}
    return {dim: lambda x, m=m: x - m for dim, m in means.items()}


def fit(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """The leading components of the vectors of each length; components without variance are left out."""
    sums = exact_sums(distinct)
    out = {}
    for dim, total in products(distinct, centred(sums)).items():
        n = sums[dim][0]
        covariance = total / n
        values, vectors = leading_eigenvectors(covariance, min(components, dim))
        real = values > dim * EPS * max(float(np.trace(covariance)), np.finfo(np.float64).tiny)
        out[dim] = Fit(n, sums[dim][1], values[real], vectors[:, real], float(np.trace(covariance)))
    return out


def whiten(vectors: DataFrame, components: int = 4, steps: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    A vector that is NULL or holds a NULL or non-finite component, or one of 2**52 steps and more, which a double
    cannot hold to the step, has no rows. The rest become whole numbers of 1/``steps``; each
    distinct vector is fitted once. Vectors of another length are another space with a fit of its own,
    empty vectors have no rows, and components without variance are left out (one vector alone has
    none). Repeated rows and NULL keys are whitened like any other. An empty table gives an empty
    result. ``deviation`` is exact (NULL if it has more than 38 digits); ``identity_error`` is measured
    over all distinct vectors.
    """
    rows = materialise(whole_vectors(vectors, key, vector, steps), "whole_vectors")
    distinct = materialise(rows.select("x").distinct(), "distinct_vectors")
    fits = {dim: f for dim, f in fit(distinct, components).items() if len(f.values)}
    errors = {d: float(np.abs(p / fits[d].n - np.eye(len(p))).max()) for d, p in products(distinct, {d: f.whiten for d, f in fits.items()}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_length(batch, 1):
                if dim not in fits:
                    continue
                f = fits[dim]
                k = len(f.values)
                each = np.repeat(at, k)
                columns = [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), f.n)),
                    pa.array([Decimal(v) if v < WIDEST else None for v in f.deviation(x) for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(f.whiten(x).ravel()), pa.array(np.tile(f.values / f.trace, len(at))),
                    pa.array(np.full(len(each), errors[dim])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    key_type = rows.schema["key"].dataType.simpleString()
    made = rows.select("key", "x").mapInArrow(
        run, f"key {key_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    return made.withColumnRenamed("key", key)
