"""Exponential, logarithm, sine and cosine."""

from __future__ import annotations

import math

import numpy as np

from .control import SolverParameters
from .inverse import DEFAULT, conjugate_gradient, square_root
from .polynomial import chebyshev_coefficients, chebyshev_factorized, horner, paterson_stockmeyer

EXP_TERMS, LOG_TERMS, COS_TERMS = 16, 32, 17
#: The logarithm's series is used on this interval, where 32 terms reach machine precision.
LOG_LOW, LOG_HIGH = 0.7, 1.42


def _radius(a) -> float:
    """Gershgorin's bound of the largest eigenvalue's magnitude."""
    low, high = a.bounds()
    return max(abs(low), abs(high))


def _halvings(radius: float, limit: float) -> int:
    return max(0, math.ceil(math.log2(radius / limit))) if radius > limit else 0


def _squared(x, times: int):
    for _ in range(times):
        x = x @ x
    return x


def exponential(a, parameters: SolverParameters = DEFAULT):
    """Halve until the spectrum is within [-1, 1], Chebyshev series, square back."""
    m = _halvings(_radius(a), 1.0)
    return _squared(chebyshev_factorized(a * 0.5**m, chebyshev_coefficients(np.exp, EXP_TERMS)), m)


def exponential_taylor(a, parameters: SolverParameters = DEFAULT, terms: int = 10):
    """Halve far, Taylor series, square back."""
    m = _halvings(_radius(a), 0.125)
    return _squared(horner(a * 0.5**m, [1.0 / math.factorial(k) for k in range(terms + 1)]), m)


#: Numerator coefficients of the [7/7] Pade approximant of exp, odd and even.
PADE_ODD = [8648640.0, 277200.0, 1512.0, 1.0]
PADE_EVEN = [17297280.0, 1995840.0, 25200.0, 56.0]


def exponential_pade(a, parameters: SolverParameters = DEFAULT):
    """[7/7] Pade approximant: the quotient is solved by conjugate gradients, then squared back."""
    m = _halvings(a.norm1(), 1.0)
    x = a * 0.5**m
    square = x @ x
    even = paterson_stockmeyer(square, PADE_EVEN)
    odd = x @ paterson_stockmeyer(square, PADE_ODD)
    fine = SolverParameters(**{**parameters.describe(), "converge_diff": min(parameters.converge_diff, 1e-12), "monitor_convergence": True, "max_iterations": 200})
    scale = 1.0 / PADE_EVEN[0]
    return _squared(conjugate_gradient((even - odd) * scale, (even + odd) * scale, fine), m)


def logarithm(a, parameters: SolverParameters = DEFAULT):
    """Square roots until the whole spectrum is near one, Chebyshev series, double back."""
    x, doublings = a, 0
    while True:
        low, high = x.bounds()
        # roots of a positive definite matrix approach one from both sides
        if low >= LOG_LOW and high <= LOG_HIGH:
            break
        if doublings > 60:
            raise ValueError("the matrix is not positive definite")
        x, doublings = square_root(x, parameters).settled(), doublings + 1
    half, middle = (LOG_HIGH - LOG_LOW) / 2, (LOG_HIGH + LOG_LOW) / 2
    mapped = (x - x.eye() * middle) * (1.0 / half)
    series = chebyshev_factorized(mapped, chebyshev_coefficients(np.log, LOG_TERMS, LOG_LOW, LOG_HIGH))
    return series * 2.0**doublings


def logarithm_taylor(a, parameters: SolverParameters = DEFAULT, terms: int = 12):
    """Square roots until within 1/8 of one, then the series of log(1 + x)."""
    x, doublings = a, 0
    while max(abs(b - 1.0) for b in x.bounds()) > 0.125:
        if doublings > 60:
            raise ValueError("the matrix is not positive definite")
        x, doublings = square_root(x, parameters).settled(), doublings + 1
    coefficients = [0.0] + [(-1.0) ** (k + 1) / k for k in range(1, terms + 1)]
    return horner(x - x.eye(), coefficients) * 2.0**doublings


def cosine(a, parameters: SolverParameters = DEFAULT):
    """Halve until within [-1, 1], even Chebyshev series in the square, double the angle back."""
    m = _halvings(_radius(a), 1.0)
    x = a * 0.5**m
    out = chebyshev_factorized(x, chebyshev_coefficients(np.cos, COS_TERMS))
    one = a.eye()
    for _ in range(m):
        out = (out @ out) * 2.0 - one
    return out


def sine(a, parameters: SolverParameters = DEFAULT):
    return cosine(a - a.eye() * (math.pi / 2), parameters)


def cosine_taylor(a, parameters: SolverParameters = DEFAULT, terms: int = 20):
    m = _halvings(_radius(a), 0.5)
    x = a * 0.5**m
    square = x @ x
    out = horner(square, [(-1.0) ** k / math.factorial(2 * k) for k in range(terms // 2 + 1)])
    one = a.eye()
    for _ in range(m):
        out = (out @ out) * 2.0 - one
    return out


def sine_taylor(a, parameters: SolverParameters = DEFAULT, terms: int = 20):
    return cosine_taylor(a - a.eye() * (math.pi / 2), parameters, terms)
