"""Factorisations and dimension reduction, on one node or as Spark jobs like all solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..matrix import Dense, Matrix
from .control import SolverParameters
from .density import trs4
from .inverse import DEFAULT


def cholesky(a: Dense | Matrix, threshold: float = 0.0) -> Dense | Matrix:
    """Lower factor L with L L^H = a."""
    if isinstance(a, Matrix):
        return cholesky_blocked(a, threshold=threshold)
    factor = np.linalg.cholesky(a.a)
    return Dense(np.where(np.abs(factor) > threshold, factor, 0))


def pivoted_cholesky(a: Dense | Matrix, rank: int, threshold: float = 0.0) -> Dense | Matrix:
    """First ``rank`` columns of the factor with the largest remaining diagonal as pivot; a ~ L L^H."""
    if isinstance(a, Matrix):
        return _pivoted_by_columns(a, rank, threshold)
    n = a.n
    left = np.zeros((n, n), a.a.dtype)
    rest = np.diag(a.a).real.astype(float).copy()
    free = np.ones(n, bool)
    for k in range(min(rank, n)):
        p = int(np.where(free, rest, -np.inf).argmax())
        if rest[p] <= 0:
            break
        column = a.a[:, p] - left[:, :k] @ left[p, :k].conj()
        column = np.where(free, column / np.sqrt(rest[p]), 0.0)
        left[:, k] = np.where(np.abs(column) > threshold, column, 0.0)
        rest -= np.abs(left[:, k]) ** 2
        free[p] = False
    return Dense(left)


def reduce_dimension(a: Dense | Matrix, dim: int, parameters: SolverParameters = DEFAULT) -> Dense | Matrix:
    """The matrix in the space of its ``dim`` lowest eigenvectors."""
    projector, _, _ = trs4(a, a.eye(), dim, parameters)
    basis = pivoted_cholesky(projector, dim)
    if isinstance(a, Matrix):
        from ..operators import algebra, select

        basis = basis.with_df(basis.df.where(F.col("j") <= dim), cols=dim).settled()
        return algebra.gemm(algebra.gemm(select.transpose(basis), a), basis).settled()
    basis = basis.a[:, :dim]
    return Dense(basis.conj().T @ a.a @ basis)


class _Columns:
    """A factor that grows by appending files to one folder, so its plan never grows."""

    def __init__(self, m: Matrix):
        self.m, self.path = m, scratch.path(m.spark, "factor")
        self.add(m.df.limit(0))

    def add(self, df: DataFrame) -> None:
        df.select(*self.m.df.columns).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.m.spark.read.schema(self.m.df.schema).parquet(self.path)


def cholesky_blocked(m: Matrix, panel: int = 128, threshold: float = 0.0) -> Matrix:
    """Lower factor of a large sparse matrix, one panel of columns at a time.

    The panel's diagonal block (panel x panel) is factored on the driver; the
    panel below it and the trailing update are joins on Spark.
    """
    from ..operators import algebra, kernels, select

    rest, done = m.df.where("i >= j"), _Columns(m)
    for start in range(1, m.rows + 1, panel):
        stop = min(start + panel, m.rows + 1)
        inside = (F.col("j") >= start) & (F.col("j") < stop)
        top = m.with_df(rest.where(inside & (F.col("i") < stop)).select((F.col("i") - (start - 1)).alias("i"), (F.col("j") - (start - 1)).alias("j"), *m.values), rows=stop - start, cols=stop - start).to_numpy()
        factor = np.linalg.cholesky(np.tril(top) + np.tril(top, -1).conj().T)
        moved = lambda array: m.with_df(select.shift(Matrix.from_numpy(m.spark, array).df, start - 1, start - 1))  # noqa: B023, E731
        done.add(moved(factor).df)
        if stop > m.rows:
            break
        below = m.with_df(rest.where(inside & (F.col("i") >= stop)))
        lower = algebra.gemm(below, moved(np.linalg.inv(factor).conj().T)).settled()
        done.add(lower.df)
        update = kernels.multiply(lower, lower.H)
        trailing = m.with_df(rest.where(F.col("j") >= stop))
        rest = algebra.axpy(m.with_df(update.df.where("i >= j")), trailing, -1.0).settled().df
    out = m.with_df(done.read())
    return select.filter_small(out, threshold) if threshold else out


def _pivoted_by_columns(m: Matrix, rank: int, threshold: float) -> Matrix:
    """A column at a time: the pivot's column of the matrix less what the columns so far explain of it."""
    if m.is_complex:
        raise ValueError("above one node's size the pivoted factorisation is real")
    done = _Columns(m)
    rest = scratch.settle(m.df.where("i = j").select("i", F.col("v").alias("d")))
    rows = scratch.settle(m.df.select("i").distinct().join(rest, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d")))
    for k in range(1, min(rank, m.rows) + 1):
        best = rows.agg(F.max_by(F.struct("i", "d"), F.struct("d", -F.col("i"))).alias("p")).first()["p"]
        if best is None or best["d"] <= 0:
            break
        left = done.read()
        mine = F.broadcast(left.where(F.col("i") == best["i"]).select("j", F.col("v").alias("f")))  # rank numbers at most
        explained = left.join(mine, "j").select("i", (-F.col("v") * F.col("f")).alias("v"))
        column = m.df.where(F.col("j") == best["i"]).select("i", "v").unionByName(explained).groupBy("i").agg((F.sum("v") / float(np.sqrt(best["d"]))).alias("v"))
        column = scratch.settle(column.where(F.abs("v") > threshold).join(rows.select("i"), "i", "left_semi"))
        done.add(column.select("i", F.lit(k).cast("long").alias("j"), "v"))
        used = column.withColumnRenamed("v", "u")
        rows = scratch.settle(rows.where(F.col("i") != best["i"]).join(used, "i", "left").select("i", (F.col("d") - F.coalesce(F.col("u") * F.col("u"), F.lit(0.0))).alias("d")))
    return m.with_df(done.read())
