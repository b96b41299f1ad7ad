"""Inverse, square roots, general roots, sign, polar decomposition, linear systems."""

from __future__ import annotations

import math

from .control import SolverParameters, iterate

DEFAULT = SolverParameters()


def invert(a, parameters: SolverParameters = DEFAULT):
    """Newton-Schulz inverse of a Hermitian matrix."""
    one = a.eye()

    def step(x):
        ax = a @ x
        return (x * 2.0 - x @ ax).settled(), (one - ax).norm1()

    norm = a.norm1()
    return iterate(step, a * (1.0 / norm**2), parameters)


def pseudo_inverse(a, parameters: SolverParameters = DEFAULT):
    """The same iteration for singular matrices.

    Null-space noise doubles each step, so the step's change is watched: the
    iteration ends when it is tight or begins to grow again.
    """
    state = {"change": math.inf}

    def step(x):
        new = (x * 2.0 - x @ (a @ x)).settled()
        change = (new - x).norm1()
        if change > state["change"] and state["change"] < 1e-3:
            return x, None
        state["change"] = change
        return new, change

    norm = a.norm1()
    return iterate(step, a * (1.0 / norm**2), parameters)


def _roots(a, parameters: SolverParameters, order: int):
    """Square root and inverse square root of a positive definite matrix, together."""
    if order not in (2, 3, 5):
        raise ValueError("the order must be 2, 3 or 5")
    one = a.eye()
    if order == 2:

        def step2(state):
            y, z = state
            p = y @ z
            low, high = p.bounds()
            factor = 1.0 / max(abs(low), abs(high))
            p = p * factor
            t = (one * 3.0 - p) * 0.5
            grow = math.sqrt(factor)
            return (((t @ y) * grow).settled(), ((z @ t) * grow).settled()), (one - p).norm1()

        return iterate(step2, (a, one), parameters)
    low, high = a.bounds()
    factor = 1.0 / max(abs(low), abs(high))

    def step(state):
        y, z = state
        r = (z @ y - one).settled()
        value = r.norm1()
        r2 = r @ r
        x = one - r * 0.5 + r2 * 0.375
        if order == 5:
            # -5/16 r^3 + 35/128 r^4 as one product more
            x = x + r2 @ (r2 * (35.0 / 128.0) - r * (5.0 / 16.0))
        return ((y @ x), (x @ z)), value

    y, z = iterate(step, (a * factor, one), parameters)
    return y * (1.0 / math.sqrt(factor)), z * math.sqrt(factor)


def square_root(a, parameters: SolverParameters = DEFAULT, order: int = 5):
    return _roots(a, parameters, order)[0]


def inverse_square_root(a, parameters: SolverParameters = DEFAULT, order: int = 5):
    return _roots(a, parameters, order)[1]


def root(a, p: int, parameters: SolverParameters = DEFAULT):
    """p-th root; the cube root is the sixth root of the square, so it loses the sign of negative eigenvalues."""
    if p == 1:
        return a
    if p == 2:
        return square_root(a, parameters)
    if p == 3:
        return root(a @ a, 6, parameters)
    if p == 4:
        return square_root(square_root(a, parameters), parameters)
    # the inverse root is raised, not the matrix, whose high powers would drown small eigenvalues
    return a @ power(inverse_root(a, p, parameters), p - 1)


def inverse_root(a, p: int, parameters: SolverParameters = DEFAULT):
    """Inverse p-th root, by coupled Newton on the fourth root above p = 4."""
    if p == 1:
        return invert(a, parameters)
    if p == 2:
        return inverse_square_root(a, parameters)
    if p == 3:
        return invert(root(a, 3, parameters), parameters)
    if p == 4:
        return inverse_square_root(square_root(a, parameters), parameters)
    one = a.eye()
    # the inverse target-th root of the fourth root, squared `squares` times, is the result
    target, squares = {0: (p // 4, 0), 2: (p // 2, 1)}.get(p % 4, (p, 2))
    fourth = square_root(square_root(a, parameters), parameters)

    def step(state):
        o, m = state
        x = (one * (target + 1.0) - m) * (1.0 / target)
        m = power(x, target) @ m
        return ((o @ x), m), (m - one).norm1()

    scale = fourth.bounds()[1]
    out, _ = iterate(step, (one * scale ** (-1.0 / target), fourth * (1.0 / scale)), parameters)
    for _ in range(squares):
        out = out @ out
    return out


def power(a, k: int):
    """a^k by repeated squaring."""
    out = None
    while k:
        if k & 1:
            out = a if out is None else out @ a
        k >>= 1
        a = a @ a if k else a
    return out


#: Fixed value: the largest step factor of the accelerated sign iteration.
SIGN_FACTOR = 1.69770248526


def _sign(a, parameters: SolverParameters, needs_adjoint: bool):
    one = a.eye()
    low, high = (a.H @ a).bounds() if needs_adjoint else a.bounds()
    top = math.sqrt(max(abs(low), abs(high))) if needs_adjoint else max(abs(low), abs(high))
    near = math.sqrt(max(low, 0.0)) if needs_adjoint else min(abs(low), abs(high))
    # an indefinite matrix' bounds say nothing on how near to zero its spectrum comes
    state = {"x": max(near / top, 1e-3) if low > 0 or high < 0 else 1e-3}

    def step(x):
        k = state["x"]
        alpha = min(math.sqrt(3.0 / (1.0 + k + k * k)), SIGN_FACTOR)
        state["x"] = 0.5 * alpha * k * (3.0 - alpha * alpha * k * k)
        square = x.H @ x if needs_adjoint else x @ x
        new = ((x @ (one * 3.0 - square * alpha**2)) * (alpha / 2)).settled()
        return new, (new - x).norm1()

    return iterate(step, a * (1.0 / top), parameters)


def sign(a, parameters: SolverParameters = DEFAULT):
    """Sign function of a Hermitian matrix."""
    return _sign(a, parameters, False)


def polar(a, parameters: SolverParameters = DEFAULT):
    """(U, H) with a = U H, U unitary and H positive semidefinite."""
    u = _sign(a, parameters, True)
    return u, u.H @ a


def conjugate_gradient(a, b, parameters: SolverParameters = DEFAULT):
    """X with a X = b, all columns advanced by one common step."""
    x = a.eye()
    r = (b - a @ x).settled()

    def step(state):
        x, r, p, old = state
        q = a @ p
        size = old / p.dot(q)
        x = (x + p * size).settled()
        r = (r - q * size).settled()
        new = r.dot(r)
        value = abs(size) * p.norm1()
        return (x, r, (r + p * (new / old)).settled() if old else p, new), value if new > 0 else None

    start = r.dot(r)
    return x if start == 0 else iterate(step, (x, r, r, start), parameters)[0]
