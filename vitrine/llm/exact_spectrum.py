"""Eigenvalues and eigenvectors of a symmetric matrix of integers, from its exact characteristic polynomial.

The polynomial is found modulo many primes (Hessenberg form by similarity, then the usual recurrence) and put together by Chinese remaindering; a
bound on its coefficients says how many primes are needed, so it is exact. All its roots are real, so by Descartes' rule the sign changes of its
coefficients, shifted by s, are the number of roots above s: bisection isolates each root, multiple ones too, and signs narrow it down far below
double precision. Null-space inverse iteration in fixed point numbers of many digits gives the vectors.

Each prime and each root is work of its own, so callers may deal them over tasks. Everything here is of the size of the matrix, whatever the number of rows
it was made from.
"""
from __future__ import annotations

from math import comb

import numpy as np

#: Bits after the binary point that roots are narrowed down to, beyond their own, and of fixed point numbers.
ROOT_BITS, FIXED_BITS = 110, 256


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3,215,031,751."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(matrix: list[list[int]]) -> list[int]:
    """Primes below 2**31 whose product exceeds twice any coefficient of the polynomial of a positive semidefinite matrix: the k-th
    elementary symmetric function of its roots is at most comb(d, k) * (trace / d) ** k."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // d) if d else 0
    need = 2 * max((comb(d, k) * mean ** k for k in range(d + 1)), default=1) + 1
    out, product, n = [], 1, 2 ** 31 - 1
    while product <= need:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) modulo the prime ``p``."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
    d = len(h)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        i = k + 1 + int(rows[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        # The inverse operation on columns keeps the matrix similar; products are reduced before they are added up.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polynomials[k - 1, :-1]
        new -= h[k - 1, k - 1] * polynomials[k - 1] % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            new = (new - int(h[i - 1, k - 1]) * below % p * polynomials[i - 1]) % p
        polynomials[k] = new % p
    return polynomials[d].tolist()


def combined(remainders: dict[int, list[int]]) -> list[int]:
    """Coefficients between minus and plus half the product of the primes."""
    product, out = 1, None
    for p, found in sorted(remainders.items()):
        if out is None:
            out = list(found)
        else:
            inverse = pow(product, -1, p)
            out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, found)]
        product *= p
    return [c - product if 2 * c > product else c for c in out or [1]]


def roots_above(coefficients: list[int], a: int, bits: int) -> int:
    """Roots above a / 2**bits of a polynomial with real roots only, with their multiplicity."""
    d = len(coefficients) - 1
    shifted = [c << bits * (d - i) for i, c in enumerate(coefficients)]  # roots times 2**bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            shifted[j] += a * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coefficients: list[int], a: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(coefficients):
        value, scale = value * a + (c << scale), scale + bits
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], bound: int, count: int) -> list[tuple[int, int, int]]:
    """The ``count`` largest positive roots, or all: ``(a, bits, multiplicity)`` for a / 2**bits, off by less than 2**-ROOT_BITS of the root. ``bound`` is not
    less than any root. Roots that agree to that many bits count as one multiple root."""
    found: list[tuple[int, int, int]] = []
    zeros = next(i for i, c in enumerate(coefficients) if c)
    coefficients = coefficients[zeros:]
    # Intervals (low, high] / 2**bits with the number of roots above either end, the highest last.
    todo = [(0, bound, 0, len(coefficients) - 1, 0)]
    while todo and sum(m for *_, m in found) < count:
        low, high, bits, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if high - low == 1 or (low and (high - low) << 24 < high):
            low, high, bits = low << 16, high << 16, bits + 16
        if inside == 1:
            # The sign above the root is that of the polynomial between it and the next one up.
            upper = -1 if above_high % 2 else 1
            while (high - low) << ROOT_BITS > high:
                if high - low < 2:
                    low, high, bits = low << 16, high << 16, bits + 16
                middle = (low + high) // 2
                sign = _sign(coefficients, middle, bits)
                if sign == 0 or sign == upper:
                    high = middle
                else:
                    low = middle
                if sign == 0:
                    low = high - 1 if high > 1 else high
                    break
            found.append((high, bits, 1))
        elif (high - low) << ROOT_BITS <= high:
            found.append((high, bits, inside))
        else:
            middle = (low + high) // 2
            above = roots_above(coefficients, middle, bits)
            todo += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return found


def null_vectors(matrix: list[list[int]], a: int, bits: int, multiplicity: int) -> np.ndarray:
    """Orthonormal eigenvectors (rows) for the root a / 2**bits, by inverse iteration with one elimination."""
    d, one = len(matrix), 1 << FIXED_BITS
    m = np.array([[v << FIXED_BITS for v in row] for row in matrix], object).reshape(d, d)
    root = (a << FIXED_BITS) >> bits
    for i in range(d):
        m[i, i] -= root
    order, factors = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(m[i, k]))
        if best != k:
            m[[k, best]] = m[[best, k]]
            factors[[k, best]] = factors[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not m[k, k]:
            m[k, k] = 1  # the matrix is singular up to the last digit, which is what is wanted
        if k + 1 < d:
            f = np.array([(v << FIXED_BITS) // m[k, k] for v in m[k + 1:, k]], object)
            factors[k + 1:, k] = f
            m[k + 1:, k:] -= (f[:, None] * m[k, k:]) >> FIXED_BITS

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d - 1):
            x[k + 1:] -= (factors[k + 1:, k] * x[k]) >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << FIXED_BITS) // m[k, k]
            x[:k] -= (m[:k, k] * x[k]) >> FIXED_BITS
        most = max(abs(v) for v in x) or 1
        return np.array([(v << FIXED_BITS) // most for v in x], object)

    vectors = []
    for turn in range(multiplicity):
        x = np.array([one + one * ((i + 1) * (2 * turn + 3) * 2654435761 % 1009) // 1009 for i in range(d)], object)
        for _ in range(3):
            x = solve(x)
        vectors.append(np.array([float(v) / one if abs(v) < one << 64 else v / one for v in x], float))
    q, _ = np.linalg.qr(np.array(vectors).T)
    rows = q.T
    return rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
