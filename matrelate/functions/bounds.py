"""Spectral bounds."""

from __future__ import annotations

import numpy as np

from .control import Monitor, SolverParameters


def _unit_row(a):
    """The first row, carried as a matrix with one row filled."""
    from ..matrix import Dense, Matrix

    if isinstance(a, Dense):
        row = np.zeros_like(a.a)
        row[0, 0] = 1
        return Dense(row, 0.0)
    row = Matrix.from_numpy(a.spark, np.array([[1.0]]))
    return a.with_df(row.df if not a.is_complex else _complex(row).df)


def _complex(m):
    from ..operators.generate import to_complex

    return to_complex(m)


def power_bounds(a, parameters: SolverParameters | None = None) -> float:
    """Largest eigenvalue in magnitude by the power method with Aitken's extrapolation.

    The vector starts at the first unit vector and cannot reach an
    eigenvector orthogonal to it.
    """
    p = parameters or SolverParameters(max_iterations=10)
    v, ritz, last = _unit_row(a), [], 0.0
    monitor = Monitor(p.converge_diff, p.monitor_convergence)
    found = 0.0
    for _ in range(p.max_iterations):
        y = v @ a
        found = value = v.dot(y) / v.dot(v)
        ritz.append(value)
        if len(ritz) >= 3:
            r1, r2, r3 = ritz[-3:]
            # as a correction of the last value, which stays exact when differences are down to rounding
            bend, step = r3 - 2 * r2 + r1, r3 - r2
            found = r3 - step * step / bend if abs(bend) > 1e-14 * abs(r3) else r3
            monitor.append(-(found - last))
            if monitor.converged() and abs(found - value) <= 1e-2 * max(1.0, abs(value)):
                break
        last = found
        norm = y.norm1()
        if norm == 0:
            return 0.0
        v = (y * (1.0 / norm)).settled()
    return found


def spectral_bounds(a) -> tuple[float, float]:
    """Gershgorin's bounds."""
    return a.bounds()
