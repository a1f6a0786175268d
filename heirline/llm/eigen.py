"""Eigenvalues and eigenvectors of an integer scatter matrix, from its exact characteristic polynomial.

The polynomial is found modulo many primes, by reduction to Hessenberg form, and put together by Chinese
remaindering. All its roots are real, so Descartes' rule counts those above a point exactly, with multiplicity;
halving isolates them and Newton's rule refines them. Eigenvectors come from inverse iteration in decimals of high precision.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import gcd, log2, prod

import numpy as np

# Bits to which an eigenvalue is found; roots that agree in so many are one of higher multiplicity.
ROOT_BITS = 192
# An isolated root is halved to so many bits before it is refined.
START_BITS = 40
DIGITS = 100


def primes_below(limit: int) -> Iterator[int]:
    """Primes in falling order."""
    for n in range(limit - 1 | 1, 2, -2):
        if n < limit and all(n % p for p in (3, 5, 7, 11, 13, 17, 19, 23)) and _is_prime(n):
            yield n


def _is_prime(n: int) -> bool:
    """Miller's test; these bases decide all numbers below 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def needed_primes(matrix: list[list[int]]) -> list[int]:
    """Primes whose product exceeds twice every coefficient of the polynomial of a positive semidefinite matrix.

    The sizes of the coefficients add up to the product of 1 + eigenvalue, at most (1 + trace / d) ** d.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits, chosen, primes = d * log2(1 + trace / d) + 3, [], primes_below(1 << 31)
    while bits > 0:
        chosen.append(next(primes))
        bits -= 30.9
    return chosen or [next(primes)]


def _powers(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.ones_like(base)
    base, exponent = base.copy(), exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1, out * base % p, out)
        base = base * base % p
        exponent >>= 1
    return out


def polynomials_modulo(matrix: list[list[int]], primes: np.ndarray) -> np.ndarray:
    """(primes x d+1) coefficients of the characteristic polynomial, lowest first, modulo each of the primes."""
    d, count = len(matrix), len(primes)
    whole = np.array(matrix, dtype=object).reshape(d, d)
    a = np.stack([(whole % int(p)).astype(np.int64) for p in primes])
    p1, p2, p3 = primes, primes[:, None], primes[:, None, None]
    row = np.arange(count)
    for k in range(d - 2):
        # The first entry below the diagonal that is not 0 goes next to it, in rows and columns alike.
        pivot = k + 1 + np.argmax(a[:, k + 1 :, k] != 0, axis=1)
        a[row, pivot], a[row, k + 1] = a[row, k + 1], a[row, pivot]
        a[row, :, pivot], a[row, :, k + 1] = a[row, :, k + 1], a[row, :, pivot]
        inverse = _powers(a[:, k + 1, k], p1 - 2, p1)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p2
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1, None] % p3) % p3
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None] % p3).sum(axis=2)) % p2
    # Polynomials of the leading parts, each from all smaller ones.
    made = np.zeros((count, d + 1, d + 1), np.int64)
    made[:, 0, 0] = 1
    for k in range(d):
        weights, run = np.zeros((count, k + 1), np.int64), np.ones(count, np.int64)
        for i in range(k, -1, -1):
            weights[:, i] = a[:, i, k] * run % p1
            if i:
                run = run * a[:, i, i - 1] % p1
        made[:, k + 1, 1:] = made[:, k, :-1]
        made[:, k + 1] = (made[:, k + 1] - (weights[:, :, None] * made[:, : k + 1] % p3).sum(axis=1)) % p2
    return made[:, d]


def from_remainders(primes: list[int], remainders: list[list[int]]) -> list[int]:
    """The whole numbers, of either sign, that leave these remainders; one row per prime."""
    whole = prod(primes)
    parts = [whole // p for p in primes]
    weights = [part * pow(part, -1, p) for part, p in zip(parts, primes, strict=True)]
    sums = [sum(w * r for w, r in zip(weights, column, strict=True)) % whole for column in zip(*remainders, strict=True)]
    return [s - whole if 2 * s > whole else s for s in sums]


class Roots:
    """The positive roots of a polynomial of which all roots are real and none is negative.

    Points are pairs (a, s) for a / 2**s.
    """

    def __init__(self, coefficients: list[int]):
        """Coefficients, lowest first."""
        zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[zeros:]
        self.degree = len(self.c) - 1

    def _scaled(self, s: int) -> list[int]:
        """The polynomial whose roots are 2**s times as large, times a constant."""
        if s >= 0:
            return [c << s * (self.degree - i) for i, c in enumerate(self.c)]
        return [c << -s * i for i, c in enumerate(self.c)]

    def above(self, a: int, s: int) -> int:
        """How many roots are larger than a / 2**s: the sign changes of the polynomial moved there."""
        while a and a % 2 == 0:
            a, s = a // 2, s - 1
        moved = self._scaled(s if a else 0)
        for i in range(self.degree):
            for j in range(self.degree - 1, i - 1, -1):
                moved[j] += a * moved[j + 1]
        signs = [c > 0 for c in moved if c]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def _refined(self, a: int, s: int) -> int:
        """Newton's rule from a / 2**s."""
        c = self._scaled(s)
        for _ in range(20):
            value = slope = 0
            for x in reversed(c):
                slope = slope * a + value
                value = value * a + x
            step = value // slope if slope else 0
            a -= step
            if abs(step) <= 1:
                break
        return a

    def largest(self, count: int) -> list[tuple[int, int, int]]:
        """(a, s, multiplicity) of the largest roots in falling order, until ``count`` are reached with multiplicity."""
        top = sum(abs(c) for c in self.c[-2:])
        # Every root is below the sum of all.
        s = max(0, ROOT_BITS - top.bit_length()) if self.degree else 0
        found, open_ = [], [(0, (top + 1) << s, self.degree, 0)]
        while open_ and sum(m for *_, m in found) < count:
            low, high, at_least, beyond = open_.pop()
            m = at_least - beyond
            # Places a root has at this scale beyond those that matter.
            spare = max(0, high.bit_length() - ROOT_BITS)
            if m == 1 and high - low <= high >> START_BITS:
                a = self._refined((low + high) // 2, s)
                slack = (2 << spare) + 2
                if low <= a <= high and self.above(a - slack, s) - self.above(a + slack, s) == 1:
                    found.append((a, s, 1))
                    continue
            if high - low <= 1 << spare:
                found.append((high, s, m))
                continue
            # As round a number as there is, so that the point has few digits.
            middle = (low + high) // 2
            if low:
                wide = (high - low).bit_length() - 2
                middle = middle >> wide << wide if wide > 0 and low < middle >> wide << wide else middle
            n = self.above(middle, s)
            if n < at_least:
                open_.append((low, middle, at_least, n))
            if n > beyond:
                open_.append((middle, high, n, beyond))
        return found


def null_vectors(matrix: list[list[int]], a: int, s: int, multiplicity: int) -> list[list[float]]:
    """Unit vectors, orthogonal to each other, that span the eigenspace of the eigenvalue a / 2**s."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        root = Decimal(a) / (Decimal(2) ** s)
        # A pivot is never smaller than this, so a matrix that is singular in all digits can be solved too.
        least = Decimal(10) ** (root.adjusted() - DIGITS + 10)
        rows = [[Decimal(x) - (root if i == j else 0) for j, x in enumerate(line)] for i, line in enumerate(matrix)]
        order, lower = list(range(d)), [[] for _ in range(d)]
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best] = rows[best], rows[k]
            lower[k], lower[best] = lower[best], lower[k]
            order[k], order[best] = order[best], order[k]
            if abs(rows[k][k]) < least:
                rows[k][k] = least
            pivot, tail = rows[k][k], rows[k][k + 1 :]
            for i in range(k + 1, d):
                factor = rows[i][k] / pivot
                lower[i].append(factor)
                if factor:
                    rows[i][k + 1 :] = [x - factor * y for x, y in zip(rows[i][k + 1 :], tail, strict=True)]
        draw = random.Random(1)
        vectors = [[Decimal(draw.randrange(-1 << 30, 1 << 30)) for _ in range(d)] for _ in range(multiplicity)]
        for _ in range(4):
            done: list[list[Decimal]] = []
            for v in vectors:
                x = [v[i] for i in order]
                for i in range(d):
                    x[i] -= sum((f * y for f, y in zip(lower[i], x, strict=False)), Decimal(0))
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - sum((f * y for f, y in zip(rows[i][i + 1 :], x[i + 1 :], strict=True)), Decimal(0))) / rows[i][i]
                size = max(map(abs, x))
                x = [y / size for y in x]
                for other in done:
                    inner = sum((y * z for y, z in zip(x, other, strict=True)), Decimal(0))
                    x = [y - inner * z for y, z in zip(x, other, strict=True)]
                length = sum((y * y for y in x), Decimal(0)).sqrt()
                done.append([y / length for y in x])
            vectors = done
        return [[float(y) for y in v] for v in vectors]


def content(matrix: list[list[int]]) -> int:
    """The largest whole number that divides all entries."""
    return gcd(*(x for line in matrix for x in line))
