"""Polynomials of a matrix in the standard, Chebyshev and Hermite bases.  Coefficients start at degree 0."""

from __future__ import annotations

import math

import numpy as np


def horner(a, coefficients: list[float]):
    """Powers from the highest degree down: one product a degree."""
    one = a.eye()
    out = one * coefficients[-1]
    for k, c in enumerate(reversed(coefficients[:-1])):
        # the first product would be with a multiple of the identity
        out = (a * coefficients[-1] if k == 0 else a @ out) + one * c
    return out


def paterson_stockmeyer(a, coefficients: list[float]):
    """Blocks of about sqrt(degree) terms share stored powers, so products grow with the root of the degree."""
    n = len(coefficients)
    if n < 3:
        return horner(a, coefficients)
    width = max(1, math.isqrt(n - 1))
    powers = [a.eye(), a]
    while len(powers) <= width:
        powers.append(powers[-1] @ a)
    out = None
    for at in reversed(range(0, n, width)):
        part = None
        for p, c in zip(powers, coefficients[at : at + width]):
            if c:
                part = p * c if part is None else part + p * c
        if out is None:
            out = part
        else:
            out = out @ powers[width]
            out = out if part is None else out + part
        out = a * 0.0 if out is None else out
    return out


def chebyshev(a, coefficients: list[float]):
    """Three-term recurrence; the spectrum must lie in [-1, 1]."""
    one = a.eye()
    out = one * coefficients[0]
    before, now = one, a
    for k, c in enumerate(coefficients[1:], 1):
        if k > 1:
            before, now = now, (a @ now) * 2.0 - before
        out = out + now * c
    return out


def chebyshev_factorized(a, coefficients: list[float]):
    """Divide and conquer on T(h+k) = 2 T(h) T(k) - T(h-k); any length, padded to a power of two."""
    size = 1 << max(0, (len(coefficients) - 1).bit_length())
    padded = np.zeros(size)
    padded[: len(coefficients)] = coefficients
    one = a.eye()
    double = {1: a}  # T of the powers of two
    h = 2
    while h < size:
        double[h] = (double[h // 2] @ double[h // 2]) * 2.0 - one
        h *= 2

    def value(c: np.ndarray):
        """Sum of c[k] T_k, or None for nothing."""
        if not c.any():
            return None
        if len(c) == 1:
            return one * float(c[0])
        h = len(c) // 2
        low, high = c[:h].copy(), c[h:]
        upper = 2.0 * high
        upper[0] = high[0]
        # sum high[k] T_(h+k) = T_h sum upper[k] T_k - sum over k>0 of high[k] T_(h-k)
        low[1:] -= high[:0:-1]
        left, right = value(low), value(upper)
        if right is None:
            return left
        right = double[h] @ right
        return right if left is None else left + right

    out = value(padded)
    return one * 0.0 if out is None else out


def hermite(a, coefficients: list[float]):
    """Physicists' Hermite polynomials: H(k+1) = 2 a H(k) - 2 k H(k-1)."""
    one = a.eye()
    out = one * coefficients[0]
    before, now = one, a * 2.0
    for k, c in enumerate(coefficients[1:], 1):
        if k > 1:
            before, now = now, (a @ now) * 2.0 - before * (2.0 * (k - 1))
        out = out + now * c
    return out


def chebyshev_coefficients(f, terms: int, low: float = -1.0, high: float = 1.0) -> list[float]:
    """Interpolation of a scalar function on [low, high], mapped to [-1, 1]."""
    middle, half = (high + low) / 2, (high - low) / 2
    return np.polynomial.chebyshev.chebinterpolate(lambda x: f(middle + half * x), terms - 1).tolist()
