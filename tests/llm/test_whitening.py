"""Whitening of picture embeddings: exact polynomial and roots, components against plain linear algebra, rows that are left out."""
from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from vitrine.llm import exact_spectrum, whitening


def vectors(n, d, seed=1, scale=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, 1 + i / d) * scale for i in range(d)] for _ in range(n)]


def brute(rows):
    """n, x - S / n, covariance of the integer vectors, all as fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(v[i] for v in x), n) for i in range(d)]
    centred = [[v[i] - mean[i] for i in range(d)] for v in x]
    return n, centred, [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]


def images(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(rows)], "image_id long, embedding array<double>, whitened string, n int")


def spectrum(matrix, count=99):
    rest = {p: exact_spectrum.polynomial_mod(matrix, p) for p in exact_spectrum.primes_for(matrix)}
    polynomial = exact_spectrum.combined(rest)
    return polynomial, exact_spectrum.largest_roots(polynomial, sum(matrix[i][i] for i in range(len(matrix))), count)


def test_polynomial_and_roots():
    r = random.Random(5)
    for d in (1, 2, 3, 6):
        a = [[r.randrange(-9, 10) for _ in range(d)] for _ in range(d + 1)]
        m = [[sum(v[i] * v[j] for v in a) for j in range(d)] for i in range(d)]
        polynomial, roots = spectrum(m)
        # Leverrier's recurrence in fractions.
        want, power = [Fraction(1)], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
        for k in range(1, d + 1):
            power = np.array(m, object) @ power
            want.append(-np.trace(power) / k)
            power = power + want[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        assert polynomial == [int(c) for c in reversed(want)]
        values = np.linalg.eigvalsh(np.array(m, float))[::-1]
        found = [x / (1 << b) for x, b, many in roots for _ in range(many)]
        assert np.allclose(found, values[:len(found)], rtol=1e-9) and np.all(np.abs(values[len(found):]) < 1e-6)


@pytest.mark.parametrize("matrix, want", [
    ([[12, 0, 0], [0, 12, 0], [0, 0, 12]], [(12, 3)]), ([[2, 1, 0], [1, 2, 0], [0, 0, 3]], [(3, 2), (1, 1)]), ([[0, 0], [0, 0]], []), ([[4, 4], [4, 4]], [(8, 1)]),
    ([[10 ** 30, 0], [0, 10 ** 30 - 1]], [(10 ** 30, 1), (10 ** 30 - 1, 1)])])
def test_multiple_and_close_roots(matrix, want):
    _, roots = spectrum(matrix)
    assert [m for *_, m in roots] == [m for _, m in want]
    for (a, bits, many), (value, _) in zip(roots, want):
        assert abs(Fraction(a, 1 << bits) - value) < Fraction(value, 1 << 100)
        v = exact_spectrum.null_vectors(matrix, a, bits, many)
        assert np.allclose(v @ v.T, np.eye(many), atol=1e-14)
        assert np.allclose(np.array(matrix, float) @ v.T, value * v.T, rtol=1e-12, atol=1e-12 * value)
    if matrix[0][0] == 10 ** 30:
        assert np.allclose(np.abs(exact_spectrum.null_vectors(matrix, *roots[0])), [[1, 0]], atol=1e-15)


def test_whitened_images(spark):
    rows = vectors(60, 5)
    got = whitening.whiten_images(images(spark, rows), 4).orderBy("image_id").collect()
    n, centred, cov = brute(rows)
    assert [r["deviation"] for r in got] == [int(sum((n * c) ** 2 for c in v)) for v in centred] and {r["n"] for r in got} == {n}
    values, directions = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    want = np.array([[float(c) for c in v] for v in centred]) @ directions[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    have = np.array([r["whitened"] for r in got])
    assert np.allclose(np.abs(have), np.abs(want), rtol=1e-8, atol=1e-9)
    assert np.allclose(got[0]["explained"], values[::-1][:4] / values.sum(), rtol=1e-10)
    assert np.allclose(np.cov(have.T, bias=True), np.eye(4), atol=1e-10) and all(r["identity_error"] < 1e-10 for r in got)


def test_odd_rows_are_left_out_and_repeats_stay(spark):
    good = vectors(9, 3)
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    alone = whitening.whiten_images(images(spark, [*good, good[0]])).orderBy("image_id").collect()
    mixed = whitening.whiten_images(images(spark, [*good, good[0], *odd])).orderBy("image_id").collect()
    assert [r["image_id"] for r in mixed] == list(range(10)) and {r["n"] for r in mixed} == {10}
    assert [r["deviation"] for r in mixed] == [r["deviation"] for r in alone]
    assert np.allclose([r["whitened"] for r in mixed], [r["whitened"] for r in alone]) and mixed[0]["whitened"] == mixed[9]["whitened"]
    assert len(mixed[0]["whitened"]) == 3


def test_no_variance_and_no_rows(spark):
    same = whitening.whiten_images(images(spark, [[1.0, 2.0], [1.0, 2.0]])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, [None, None], [0.0, 0.0], 0.0)] * 2
    line = whitening.whiten_images(images(spark, [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]])).orderBy("image_id").collect()
    assert [r["whitened"][1] for r in line] == [None] * 3 and np.allclose([abs(r["whitened"][0]) for r in line], [1.5 ** 0.5, 0, 1.5 ** 0.5])
    assert line[0]["explained"] == [1.0, 0.0]
    assert whitening.whiten_images(images(spark, [])).count() == 0 and whitening.whiten_images(images(spark, [None, [float("nan")]])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [[2.0 ** 33, 1.0], [0.0, 2.0], [-2.0 ** 33, 3.0], [5.0, 2.0 ** 20]]
    n, centred, _ = brute(rows)
    want = [int(sum((n * c) ** 2 for c in v)) for v in centred]
    if max(want) < 2 ** 63:
        assert [r["deviation"] for r in whitening.whiten_images(images(spark, rows)).orderBy("image_id").collect()] == want
    count, sums, matrix = whitening.scatter(images(spark, rows), 2)
    y = [[math.floor(64 * c) for c in v] for v in rows]
    assert (count, sums) == (4, [sum(v[i] for v in y) for i in range(2)])
    assert matrix == [[4 * sum(v[i] * v[j] for v in y) - sums[i] * sums[j] for j in range(2)] for i in range(2)]
