"""Eigenvalue functions of matrices that one node holds.

These are serial by nature.  They gather the matrix (bounded by
``Matrix.to_numpy``), use a dense eigensolver, and apply the function to every
eigenvalue, zeros included.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..matrix import Matrix


def eigendecomposition(m: Matrix, count: int | None = None) -> tuple[DataFrame, Matrix]:
    """Eigenvalues (k, value) in ascending order, the lowest ``count`` of them, and vectors in columns."""
    values, vectors = np.linalg.eigh(m.to_numpy())
    count = len(values) if count is None else count
    table = m.spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(values[:count])], "k long, value double")
    return table, Matrix.from_numpy(m.spark, vectors[:, :count])


def matrix_function(m: Matrix, f: Callable[[np.ndarray], np.ndarray]) -> Matrix:
    """V f(L) V^H."""
    values, vectors = np.linalg.eigh(m.to_numpy())
    return Matrix.from_numpy(m.spark, (vectors * f(values)) @ vectors.conj().T)


def exponential(m: Matrix) -> Matrix:
    return matrix_function(m, np.exp)


def logarithm(m: Matrix) -> Matrix:
    return matrix_function(m, np.log)


def sine(m: Matrix) -> Matrix:
    return matrix_function(m, np.sin)


def cosine(m: Matrix) -> Matrix:
    return matrix_function(m, np.cos)


def invert(m: Matrix) -> Matrix:
    return matrix_function(m, lambda x: 1.0 / x)


def square_root(m: Matrix) -> Matrix:
    return matrix_function(m, np.sqrt)


def inverse_square_root(m: Matrix) -> Matrix:
    return matrix_function(m, lambda x: 1.0 / np.sqrt(x))


def sign(m: Matrix) -> Matrix:
    """Sign of every eigenvalue, +1 for zero."""
    return matrix_function(m, lambda x: np.where(x < 0, -1.0, 1.0))


def singular_values(m: Matrix) -> tuple[Matrix, DataFrame, Matrix]:
    """(left vectors, values (k, value) ascending, right vectors) by way of the polar decomposition."""
    from ..matrix import solve
    from .inverse import polar

    u, h = solve(polar, m)
    values, right = np.linalg.eigh(h.to_numpy())
    left = u.to_numpy() @ right
    table = m.spark.createDataFrame([(k + 1, float(abs(x))) for k, x in enumerate(values)], "k long, value double")
    return Matrix.from_numpy(m.spark, left), table, Matrix.from_numpy(m.spark, right)
