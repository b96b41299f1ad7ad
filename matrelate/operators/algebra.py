"""Matrix algebra as joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from . import generate
from .aggregate import magnitude, norm1_table
from .select import conjugate, transpose


def _same_kind(a: Matrix, b: Matrix) -> tuple[Matrix, Matrix]:
    if a.is_complex or b.is_complex:
        return generate.to_complex(a), generate.to_complex(b)
    return a, b


def _product(a: Matrix) -> list[tuple[str, Column]]:
    """Value of the product of the columns a_* and b_*."""
    if not a.is_complex:
        return [("v", F.col("a_v") * F.col("b_v"))]
    return [
        ("re", F.col("a_re") * F.col("b_re") - F.col("a_im") * F.col("b_im")),
        ("im", F.col("a_re") * F.col("b_im") + F.col("a_im") * F.col("b_re")),
    ]


def _prefixed(m: Matrix, prefix: str, **names: str) -> DataFrame:
    return m.df.select(*[F.col(old).alias(new) for old, new in names.items()], *[F.col(c).alias(f"{prefix}_{c}") for c in m.values])


def scale(m: Matrix, factor: complex | float) -> Matrix:
    """Every entry times a factor; a complex factor makes the matrix complex."""
    if isinstance(factor, complex) and factor.imag:
        m = generate.to_complex(m)
        re, im = F.col("re"), F.col("im")
        return m.with_df(m.df.select("i", "j", (re * factor.real - im * factor.imag).alias("re"), (re * factor.imag + im * factor.real).alias("im")))
    factor = float(factor.real if isinstance(factor, complex) else factor)
    return m.with_df(m.df.select("i", "j", *[(F.col(c) * factor).alias(c) for c in m.values]))


def gemm(
    a: Matrix, b: Matrix, alpha: float = 1.0, beta: float = 0.0, c: Matrix | None = None, threshold: float = 0.0,
    transpose_a: bool = False, transpose_b: bool = False,
) -> Matrix:
    """alpha * op(a) op(b) + beta * c; product entries at or under the threshold are dropped after alpha.

    Transposing swaps column names and costs nothing.  One equi-join on the inner index and one grouped sum with partial sums
    before the shuffle.  A hub on the inner index is a skewed join partition,
    which adaptive execution splits.
    """
    a, b = transpose(a) if transpose_a else a, transpose(b) if transpose_b else b
    if a.cols != b.rows:
        raise ValueError(f"{a.rows} x {a.cols} times {b.rows} x {b.cols}")
    a, b = _same_kind(a, b)
    joined = _prefixed(a, "a", i="i", j="k").join(_prefixed(b, "b", i="k", j="j"), "k")
    sums = [(F.sum(value) * alpha).alias(name) for name, value in _product(a)]
    out = a.with_df(joined.groupBy("i", "j").agg(*sums), rows=a.rows, cols=b.cols)
    out = out.with_df(out.df.where(magnitude(out) > threshold))
    return axpy(scale(c, beta), out, 1.0, threshold) if beta and c is not None else out


def axpy(a: Matrix, b: Matrix, alpha: complex | float = 1.0, threshold: float = 0.0) -> Matrix:
    """alpha * a + b, as a union and a grouped sum."""
    a, b = _same_kind(scale(a, alpha) if alpha != 1.0 else a, b)
    df = a.df.unionByName(b.df).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in a.values])
    out = b.with_df(df)
    return out.with_df(out.df.where(magnitude(out) > threshold))


def hadamard(a: Matrix, b: Matrix) -> Matrix:
    """Entry by entry product; stored zeros stay."""
    a, b = _same_kind(a, b)
    joined = _prefixed(a, "a", i="i", j="j").join(_prefixed(b, "b", i="i", j="j"), ["i", "j"])
    return a.with_df(joined.select("i", "j", *[value.alias(name) for name, value in _product(a)]))


def dot_table(a: Matrix, b: Matrix) -> DataFrame:
    """Sum of conj(a) * b."""
    h = hadamard(conjugate(a), b)
    return h.df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in h.values])


def dot(a: Matrix, b: Matrix) -> complex:
    row = dot_table(a, b).first()
    return complex(row["re"], row["im"]) if "re" in row else complex(row["v"])


def dot_columns(m: Matrix, column: int, pivots: DataFrame | None = None) -> DataFrame:
    """(j, v): dot products of one column with every column, or with those listed in ``pivots`` (j)."""
    one = m.df.where(F.col("j") == column).select("i", F.col("v").alias("x"))
    others = m.df if pivots is None else m.df.join(pivots.select("j"), "j", "left_semi")
    return others.join(one, "i").groupBy("j").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def diagonal_scale(m: Matrix, factors: DataFrame) -> Matrix:
    """Columns times the factors (j, f); columns that are not listed stay."""
    joined = m.df.join(factors.select(F.col("j").cast("long").alias("j"), F.col("f").cast("double").alias("f")), "j", "left")
    factor = F.coalesce("f", F.lit(1.0))
    return m.with_df(joined.select("i", "j", *[(F.col(c) * factor).alias(c) for c in m.values]))


def snap(m: Matrix, pattern: Matrix) -> Matrix:
    """The pattern's coordinates, zero where the matrix has no entry."""
    joined = pattern.df.select("i", "j").join(m.df, ["i", "j"], "left")
    return m.with_df(joined.select("i", "j", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in m.values]))


def permute(m: Matrix, perm: DataFrame, undo: bool = False) -> Matrix:
    """Rows and columns moved by (idx, new_idx): two lookups, no multiplication."""
    old, new = ("new_idx", "idx") if undo else ("idx", "new_idx")
    rows = perm.select(F.col(old).alias("i"), F.col(new).alias("to_i"))
    cols = perm.select(F.col(old).alias("j"), F.col(new).alias("to_j"))
    moved = m.df.join(rows, "i").join(cols, "j")
    return m.with_df(moved.select(F.col("to_i").alias("i"), F.col("to_j").alias("j"), *m.values))


def similarity(a: Matrix, p: Matrix, p_inverse: Matrix, threshold: float = 0.0) -> Matrix:
    """p a p_inverse; nothing to do for a known identity."""
    return a if p.is_identity else gemm(gemm(p, a, threshold=threshold), p_inverse, threshold=threshold)


def asymmetry_table(m: Matrix) -> DataFrame:
    """norm1 of (m^H - m)."""
    return norm1_table(axpy(m, conjugate(transpose(m)), -1.0, threshold=-1.0))


def symmetrize(m: Matrix) -> Matrix:
    """(m + m^H) / 2."""
    return axpy(scale(m, 0.5), scale(conjugate(transpose(m)), 0.5), 1.0, threshold=-1.0)
