"""Whitening against numpy's eigenvectors and exact fractions."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from verstext.llm import whitening as wh


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def slow(rows, count=4):
    """{(key, x): per component (n, deviation, |whitened|, explained)} by exact sums and numpy's eigh."""
    kept = defaultdict(list)
    for key, v in rows:
        if usable(v):
            kept[len(v)].append((key, tuple(math.floor(256 * c) for c in v)))
    out = defaultdict(list)
    for dim, own in kept.items():
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        mean = np.array([float(Fraction(s, n)) for s in sums])
        y = np.array(fit, dtype=float) - mean
        cov = y.T @ y / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][: min(count, dim)], vectors[:, ::-1][:, : min(count, dim)]
        real = values > dim * 1e-14 * max(np.trace(cov), 1e-300)
        for key, x in own:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            w = np.abs((np.array(x, dtype=float) - mean) @ vectors[:, real] / np.sqrt(values[real]))
            for k in range(int(real.sum())):
                out[key].append((k + 1, n, deviation, w[k], values[k] / np.trace(cov)))
    return out


def check(got, rows):
    want, found = slow(rows), defaultdict(list)
    for r in got.collect():
        assert 0 <= r.identity_error <= 1e-9
        found[r[0]].append((r.component, r.n, int(r.deviation), abs(r.whitened), r.explained))
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for key in want:
        for a, b in zip(sorted(found[key]), sorted(want[key]), strict=True):
            assert a[:3] == b[:3]
            assert a[3:] == pytest.approx(b[3:], rel=1e-7, abs=1e-7)


def test_small_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(wh.whiten(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 4, 2, 1, 0.5]]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(3, rows[3][1]), (3, rows[4][1])]  # copies and a repeated key
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    rows += [(210 + i, [float(i), 2.0 * i]) for i in range(6)]  # another length, one real component
    rows += [(220, [1.0, 2.0, 3.0])]  # alone: no variance
    rows += [(230, [0.0] * 5), (231, [-0.0] * 5), (None, [1.0, 1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 0, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, key int, component int, whitened double")
    got = wh.whiten(table.repartition(7))
    assert {r[0] for r in got.collect()} == set(range(60)) | set(range(100, 150)) | set(range(210, 216)) | {230, 231, None}
    check(got, rows)
    assert wh.whiten(table.limit(0)).count() == 0


def test_vectors_too_large_for_a_step_have_no_rows(spark):
    table = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in wh.whiten(table).collect()} == {1, 2}


@pytest.mark.parametrize("kind", ["random", "clustered", "low rank", "graded", "equal", "diagonal"])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 150])
def test_divide_and_conquer_finds_the_spectrum(kind, n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {
        "random": rng.random(n), "clustered": np.repeat(rng.random(n // 3 + 1), 3)[:n], "low rank": np.concatenate((rng.random(n // 2), np.zeros(n - n // 2))),
        "graded": 10.0 ** -np.arange(n) if n < 15 else np.logspace(0, -14, n), "equal": np.ones(n), "diagonal": rng.random(n),
    }[kind]
    if kind == "diagonal":
        q = np.eye(n)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = wh.leading_eigenvectors(a, n)
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * n)
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13 * n)
    assert np.abs(a @ vectors - vectors * found).max() < 1e-13 * n
    few, some = wh.leading_eigenvectors(a, min(4, n))
    assert np.allclose(few, found[: len(few)], atol=1e-13 * n)
    assert np.abs(a @ some - some * few).max() < 1e-13 * n


@pytest.mark.parametrize("n", [1, 3, 40])
def test_polar_factor_is_orthogonal_and_leaves_a_positive_part(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n)) @ np.diag(np.logspace(0, -10, n))
    u = wh.polar_factor(a)
    h = u.T @ a
    assert np.allclose(u.T @ u, np.eye(n), atol=1e-12)
    assert np.allclose(h, h.T, atol=1e-12 * np.linalg.norm(a)) and np.linalg.eigvalsh((h + h.T) / 2).min() > -1e-12 * np.linalg.norm(a)
