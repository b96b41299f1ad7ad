"""Density matrices: purification, dense and finite-temperature solvers, extrapolation.

All take the Hamiltonian ``h``, the inverse square root ``isq`` of the overlap
and the number of occupied states ``ne`` (the trace of the orthogonal density).
"""

from __future__ import annotations

import math

import numpy as np

from .control import SolverParameters, iterate
from .inverse import DEFAULT, inverse_square_root, square_root

TINY = 1e-14


def _orthogonal(h, isq):
    return ((isq @ h) @ isq.H).settled()


def _back(x, isq):
    return (isq.H @ x) @ isq


def _bisect(scalars: list, converge_diff: float) -> float:
    """The point of [0, 1] that the recorded scalar steps map to one half."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        x = middle
        for f in scalars:
            x = f(x)
        if abs(x - 0.5) < converge_diff:
            break
        low, high = (middle, high) if x < 0.5 else (low, middle)
    return (low + high) / 2


def _purify(h, isq, start, step, parameters: SolverParameters, factor: float = 1.0):
    """The loop that purifications share.

    ``step(x) -> (new x, scalar form of the step)``.  Returns the density, the
    energy and the scalar steps before the last one.
    """
    wh = _orthogonal(h, isq)
    x = start(wh)
    state = {"energy": 0.0, "steps": []}

    def one(x):
        new, scalar = step(x)
        new = new.settled()
        energy = factor * new.dot(wh)
        value, state["energy"] = energy - state["energy"], energy
        state["steps"].append(scalar)
        return new, value

    x = iterate(one, x, parameters)
    return _back(x, isq), state["energy"], state["steps"][:-1], wh


def _linear_map(wh):
    low, high = wh.bounds()
    return (wh.eye() * high - wh) * (1.0 / (high - low))


def pm(h, isq, ne: float, parameters: SolverParameters = DEFAULT):
    """Canonical purification; returns (density, energy, chemical potential)."""
    memo = {}

    def start(wh):
        low, high = wh.bounds()
        n = wh.n
        lam = wh.trace() / n
        a = min(ne / (high - lam), (n - ne) / (lam - low))
        memo.update(lam=lam, a=a, n=n)
        return wh * (-a / n) + wh.eye() * ((a * lam + ne) / n)

    def step(x):
        x2 = x @ x
        x3 = x @ x2
        gap = x - x2
        below = gap.trace()
        s = 1.0 if abs(below) <= TINY else gap.dot(x) / below
        if s > 0.5:
            c = (0.0, 1.0 + 1.0 / s, -1.0 / s)
        else:
            c = ((1 - 2 * s) / (1 - s), (1 + s) / (1 - s), -1.0 / (1 - s))
        return x * c[0] + x2 * c[1] + x3 * c[2], lambda v: c[0] * v + c[1] * v**2 + c[2] * v**3

    k, energy, steps, _ = _purify(h, isq, start, step, parameters)
    mid = _bisect(steps, parameters.converge_diff)
    return k, energy, memo["lam"] - (memo["n"] * mid - ne) / memo["a"]


def _mu(wh_bounds, steps, parameters) -> float:
    low, high = wh_bounds
    return high + (low - high) * _bisect(steps, parameters.converge_diff)


def trs2(h, isq, ne: float, parameters: SolverParameters = DEFAULT):
    """Second-order trace resetting; returns (density, energy, chemical potential)."""

    def step(x):
        x2 = x @ x
        if x.trace() > ne:
            return x2, lambda v: v * v
        return x * 2.0 - x2, lambda v: 2 * v - v * v

    k, energy, steps, wh = _purify(h, isq, _linear_map, step, parameters)
    return k, energy, _mu(wh.bounds(), steps, parameters)


def trs4(h, isq, ne: float, parameters: SolverParameters = DEFAULT):
    """Fourth-order trace resetting; returns (density, energy, chemical potential)."""

    def step(x):
        x2 = x @ x
        f = x * 4.0 - x2 * 3.0
        g = x.eye() - x * 2.0 + x2
        below = x2.dot(g)
        s = 3.0 if abs(below) < TINY else (ne - x2.dot(f)) / below
        if s > 6:
            return x * 2.0 - x2, lambda v: 2 * v - v * v
        if s < 0:
            return x2, lambda v: v * v
        return x2 @ (f + g * s), lambda v: v * v * (4 * v - 3 * v * v + s * (1 - 2 * v + v * v))

    k, energy, steps, wh = _purify(h, isq, _linear_map, step, parameters)
    return k, energy, _mu(wh.bounds(), steps, parameters)


def hpcp(h, isq, ne: float, parameters: SolverParameters = DEFAULT):
    """Hole-particle canonical purification; returns (density, energy, chemical potential)."""
    memo = {}

    def start(wh):
        low, high = wh.bounds()
        m, b1 = wh.trace() / wh.n, ne / wh.n
        b2 = min(b1 / (high - m), (1 - b1) / (m - low))
        memo.update(m=m, b1=b1, b2=b2)
        return wh.eye() * (b1 + b2 * m) - wh * b2

    def step(x):
        hole = x.eye() - x
        xd = x @ hole
        x2d = x @ xd
        below = xd.trace()
        s = 0.5 if abs(below) <= TINY else x2d.trace() / below
        return x + x2d * 2.0 - xd * (2.0 * s), lambda v: v + 2 * v * v * (1 - v) - 2 * s * v * (1 - v)

    k, energy, steps, _ = _purify(h, isq, start, step, parameters)
    return k, energy, memo["m"] + (memo["b1"] - _bisect(steps, parameters.converge_diff)) / memo["b2"]


def scale_and_fold(h, isq, ne: float, homo: float, lumo: float, parameters: SolverParameters = DEFAULT):
    """Accelerated purification with known frontier levels; returns (density, energy), the energy counted twice."""
    memo = {}

    def start(wh):
        low, high = wh.bounds()
        memo.update(b=(high - lumo) / (high - low), c=(high - homo) / (high - low))
        return _linear_map(wh)

    def step(x):
        if x.trace() > ne:
            a = 2.0 / (2.0 - memo["b"])
            folded = x * a + x.eye() * (1 - a)
            memo.update({k: (a * memo[k] + 1 - a) ** 2 for k in "bc"})
            return folded @ folded, None
        a = 2.0 / (1.0 + memo["c"])
        memo.update({k: 2 * a * memo[k] - (a * memo[k]) ** 2 for k in "bc"})
        return x * (2 * a) - (x @ x) * a**2, None

    k, energy, _, _ = _purify(h, isq, start, step, parameters, factor=2.0)
    return k, energy


# -- dense and finite temperature ----------------------------------------


def occupations(levels: np.ndarray, ne: float, beta: float | None = None) -> tuple[np.ndarray, float]:
    """Filling of ascending levels and the chemical potential; a step at zero temperature, else Fermi's function."""
    if beta is None:
        filled = np.clip(ne - np.arange(len(levels)), 0.0, 1.0)
        top = max(0, min(len(levels) - 1, math.ceil(ne) - 1))
        above = min(len(levels) - 1, top + 1)
        return filled, float(levels[top] + levels[above]) / 2
    fermi = lambda mu: 1.0 / (1.0 + np.exp(np.clip(beta * (levels - mu), -700, 700)))
    low, high = levels[0] - 50 / beta, levels[-1] + 50 / beta
    while high - low > 1e-12 * max(1.0, abs(low), abs(high)):
        middle = (low + high) / 2
        low, high = (middle, high) if fermi(middle).sum() < ne else (low, middle)
    return fermi((low + high) / 2), (low + high) / 2


def dense_density(h, isq, ne: float, beta: float | None = None):
    """Density by eigendecomposition on one node; returns (density, energy, chemical potential).

    Larger matrices are gathered, up to what one node holds.
    """
    from ..matrix import Dense, Matrix

    if isinstance(h, Matrix):
        d, energy, mu = dense_density(Dense(h.to_numpy()), Dense(isq.to_numpy()), ne, beta)
        return Matrix.from_numpy(h.spark, d.a), energy, mu
    wh = isq.a @ h.a @ isq.a.conj().T
    levels, vectors = np.linalg.eigh(wh)
    filled, mu = occupations(levels, ne, beta)
    x = (vectors * filled) @ vectors.conj().T
    return Dense(isq.a.conj().T @ x @ isq.a), float((filled * levels).sum()), mu


def _wom(a, start, derivative, beta: float, parameters: SolverParameters):
    """Adaptive second-order Runge-Kutta in the inverse temperature."""
    w, at, h = start, 0.0, 1.0
    limit = parameters.step_thresh
    for _ in range(parameters.max_iterations):
        if at >= beta:
            break
        h = min(h, beta - at)
        k0 = derivative(w)
        while True:
            first = (w + k0 * h).settled()
            second = (w + (k0 + derivative(first)) * (h / 2)).settled()
            error = (second - first).norm1()
            if error <= 1.1 * limit:
                break
            h *= math.sqrt(limit / error)
        if (second - w).norm1() < parameters.converge_diff:
            break
        w, at = second, at + h
        if error > 0:
            h *= math.sqrt(limit / error)
    return w


def wom_gc(h, isq, mu: float, beta: float, parameters: SolverParameters = DEFAULT):
    """Wave-operator minimisation at a fixed chemical potential; returns (density, energy)."""
    wh = _orthogonal(h, isq)
    one = wh.eye()
    a = (wh - one * mu).settled()
    w = _wom(a, one * (1 / math.sqrt(2)), lambda w: ((w @ (one - w @ w)) @ a) * -0.5, beta, parameters)
    x = w @ w
    return _back(x, isq), x.dot(wh)


def wom_c(h, isq, ne: float, beta: float, parameters: SolverParameters = DEFAULT):
    """Wave-operator minimisation at a fixed trace; returns (density, energy)."""
    wh = _orthogonal(h, isq)
    one = wh.eye()

    def derivative(w):
        x = (w @ (one - w @ w)).settled()
        xa = x @ wh
        return (xa - x * (w.dot(xa) / x.dot(w))) * -0.5

    w = _wom(wh, one * math.sqrt(ne / wh.n), derivative, beta, parameters)
    x = w @ w
    return _back(x, isq), x.dot(wh)


# -- direct formulas -----------------------------------------------------


def energy_density(h, d):
    """D H D."""
    return (d @ h) @ d


def mcweeny_step(d, s=None):
    """3 D S D - 2 D S D S D; without an overlap S is one."""
    ds = d if s is None else d @ s
    dsd = ds @ d
    return dsd * 3.0 - (ds @ dsd) * 2.0


def purification_extrapolate(d, s, ne: float, parameters: SolverParameters = DEFAULT):
    """A density for a new overlap from the old one, purified in the new metric.

    The first step folds occupations above one, which the new metric makes of
    the old density's ones and which squaring would drive away.
    """
    folded = []

    def step(x):
        xsx = x @ (s @ x)
        square = bool(folded) and x.dot(s) > ne
        folded.append(True)
        new = (xsx if square else x * 2.0 - xsx).settled()
        return new, (new - x).norm1()

    return iterate(step, d, parameters)


def lowdin_extrapolate(d, s_old, s_new, parameters: SolverParameters = DEFAULT):
    """S2^-1/2 S1^1/2 D S1^1/2 S2^-1/2."""
    left = inverse_square_root(s_new, parameters) @ square_root(s_old, parameters)
    return (left @ d) @ left.H


def estimate_gap(h, k, mu: float, parameters: SolverParameters = DEFAULT) -> float:
    """Twice the distance from the chemical potential to the highest occupied level, by the power method on K (H - e_min)."""
    from .bounds import power_bounds

    low, _ = h.bounds()
    occupied = k @ (h - h.eye() * low)
    fine = SolverParameters(max_iterations=max(300, parameters.max_iterations), converge_diff=min(parameters.converge_diff, 1e-9), monitor_convergence=False)
    return 2.0 * (mu - (power_bounds(occupied, fine) + low))
