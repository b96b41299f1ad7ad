"""Reductions.  Each is one pass with partial aggregation before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix


def magnitude(m: Matrix) -> Column:
    return F.hypot("re", "im") if m.is_complex else F.abs("v")


def _real(m: Matrix) -> Column:
    return F.col("re" if m.is_complex else "v")


def grand_sum_table(m: Matrix) -> DataFrame:
    return m.df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in m.values])


def grand_sum(m: Matrix) -> complex | float:
    row = grand_sum_table(m).first()
    return complex(row["re"], row["im"]) if m.is_complex else row["v"]


def trace_table(m: Matrix) -> DataFrame:
    """Real part of the diagonal's sum."""
    return m.df.where("i = j").agg(F.coalesce(F.sum(_real(m)), F.lit(0.0)).alias("trace"))


def trace(m: Matrix) -> float:
    return trace_table(m).first()[0]


def column_norms(m: Matrix) -> DataFrame:
    """(j, norm): sum of magnitudes of each stored column."""
    return m.df.groupBy("j").agg(F.sum(magnitude(m)).alias("norm"))


def norm1_table(m: Matrix) -> DataFrame:
    return column_norms(m).agg(F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm"))


def norm1(m: Matrix) -> float:
    """Largest column sum of magnitudes."""
    return norm1_table(m).first()[0]


def frobenius2_table(m: Matrix) -> DataFrame:
    """Sum of squared magnitudes, the squared Frobenius norm."""
    return m.df.agg(F.coalesce(F.sum(sum((F.col(c) * F.col(c) for c in m.values), F.lit(0.0))), F.lit(0.0)).alias("norm2"))


def frobenius2(m: Matrix) -> float:
    return frobenius2_table(m).first()[0]


def sigma_table(m: Matrix) -> DataFrame:
    """1 / norm1^2, the starting factor of the inverse iteration."""
    return norm1_table(m).select((1.0 / (F.col("norm") * F.col("norm"))).alias("sigma"))


def gershgorin_table(m: Matrix) -> DataFrame:
    """Bounds of the spectrum from columns; columns without entries count as zero."""
    on, off = F.col("i") == F.col("j"), F.col("i") != F.col("j")
    centre = F.sum(F.when(on, _real(m)).otherwise(0.0))
    reach = F.sum(F.when(off, magnitude(m)).otherwise(0.0))
    per = m.df.groupBy("j").agg(centre.alias("c"), reach.alias("r"))
    both = per.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("c") - F.col("r")).alias("lo"), F.max(F.col("c") + F.col("r")).alias("hi"))
    short = F.col("n") < m.cols
    low = F.when(short, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    high = F.when(short, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi"))
    return both.select(low.alias("lower"), high.alias("upper"))


def gershgorin(m: Matrix) -> tuple[float, float]:
    row = gershgorin_table(m).first()
    return row["lower"], row["upper"]


def size_table(m: Matrix) -> DataFrame:
    """Stored entries and share of the whole."""
    return m.df.agg(F.count(F.lit(1)).alias("nnz")).select("nnz", (F.col("nnz") / float(m.rows * m.cols)).alias("fill"))


def nnz(m: Matrix) -> int:
    return m.df.count()


def load_balance_table(m: Matrix) -> DataFrame:
    """Smallest and largest number of entries among the partitions that hold any."""
    per = m.df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.min("n"), F.lit(0)).alias("smallest"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def load_balance(m: Matrix) -> tuple[int, int]:
    row = load_balance_table(m).first()
    return row["smallest"], row["largest"]


def information(m: Matrix) -> dict:
    """Dimension, entries, fill, and the smallest and largest number of entries in a partition."""
    low, high = load_balance(m)
    count = nnz(m)
    return {"rows": m.rows, "columns": m.cols, "entries": count, "fill": count / (m.rows * m.cols), "partition_min": low, "partition_max": high}


def is_identity_table(m: Matrix, tiny: float = 1e-10) -> DataFrame:
    """Whether no entry is off the diagonal and every diagonal entry is one."""
    bad = (F.col("i") != F.col("j")) | (F.abs(_real(m) - 1.0) > tiny)
    counts = m.df.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    return counts.select(((F.col("bad") == 0) & (F.col("n") == m.rows)).alias("is_identity"))


def is_identity(m: Matrix) -> bool:
    return m.is_identity or is_identity_table(m).first()[0]


def max_diagonal(m: Matrix) -> DataFrame:
    """Place and value of the largest diagonal entry, the smallest place on ties."""
    pick = F.max_by(F.struct("j", _real(m).alias("v")), F.struct(_real(m), -F.col("j")))
    return m.df.where("i = j").agg(pick.alias("p")).select("p.j", "p.v")
