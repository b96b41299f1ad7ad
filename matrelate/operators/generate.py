"""Constructors and generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import COMPLEX, REAL, Matrix


#: Indices of a random permutation that one task orders.
PERMUTATION_BUCKET = 200_000


def empty(spark: SparkSession, n: int, is_complex: bool = False) -> Matrix:
    return Matrix(spark.createDataFrame([], COMPLEX if is_complex else REAL), n, n, is_complex)


def identity(spark: SparkSession, n: int) -> Matrix:
    df = spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return Matrix(df, n, n, is_identity=True)


def dense_ones(spark: SparkSession, n: int) -> Matrix:
    """One everywhere: n*n rows made from one range, without a join."""
    cell = F.col("id")
    df = spark.range(n * n).select((F.floor(cell / n) + 1).cast("long").alias("i"), (cell % n + 1).alias("j"), F.lit(1.0).alias("v"))
    return Matrix(df, n, n)


def banded(spark: SparkSession, n: int, reach: int, value: Column) -> Matrix:
    """Entries within ``reach`` of the diagonal; ``value`` is an expression of i and j."""
    df = spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("id") - reach), F.least(F.lit(n), F.col("id") + reach))).alias("j"))
    return Matrix(df.select("i", "j", value.cast("double").alias("v")), n, n)


def permutation(spark: SparkSession, n: int, kind: str = "default", seed: int = 0, limit: int | None = None) -> DataFrame:
    """(idx, new_idx): default, reverse, random, or random on the first ``limit`` indices only."""
    ids = spark.range(1, n + 1).select(F.col("id").alias("idx"))
    if kind == "default":
        return ids.select("idx", F.col("idx").alias("new_idx"))
    if kind == "reverse":
        return ids.select("idx", (F.lit(n + 1) - F.col("idx")).alias("new_idx"))
    top = n if limit is None else limit
    # order by a seeded hash: indices are scattered into buckets, and numbered bucket by bucket
    buckets = top // PERMUTATION_BUCKET + 1
    drawn = ids.where(F.col("idx") <= top).withColumn("hash", F.xxhash64(F.lit(seed), "idx"))
    drawn = drawn.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    counts = dict(drawn.groupBy("bucket").count().collect())  # one number a bucket
    starts = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(buckets)])])
    before = F.broadcast(spark.createDataFrame([(b, int(starts[b])) for b in range(buckets)], "bucket long, before long"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("hash", "idx"))
    moved = drawn.withColumn("place", place).join(before, "bucket").select("idx", (F.col("before") + F.col("place")).cast("long").alias("new_idx"))
    return moved.unionByName(ids.where(F.col("idx") > top).select("idx", F.col("idx").alias("new_idx")))


def permutation_matrix(perm: DataFrame, n: int, by_rows: bool = True) -> Matrix:
    """P[i, p(i)] = 1 by rows, P[p(j), j] = 1 by columns."""
    i, j = ("idx", "new_idx") if by_rows else ("new_idx", "idx")
    return Matrix(perm.select(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(1.0).alias("v")), n, n)


def symmetrize_triplets(df: DataFrame, kind: str) -> DataFrame:
    """Expand one stored half: symmetric, skew-symmetric or hermitian (a real hermitian half is symmetric)."""
    if kind == "general":
        return df
    if kind not in ("symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"unknown symmetry {kind!r}")
    sign = -1.0 if kind == "skew-symmetric" else 1.0
    if "im" in df.columns:
        values = [(F.col("re") * sign).alias("re"), (F.col("im") * (-1.0 if kind == "hermitian" else sign)).alias("im")]
    else:
        values = [(F.col("v") * sign).alias("v")]
    return df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def to_complex(m: Matrix) -> Matrix:
    if m.is_complex:
        return m
    return m.with_df(m.df.select("i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im")), is_complex=True)


def to_real(m: Matrix) -> Matrix:
    """The real part."""
    return m.with_df(m.df.select("i", "j", F.col("re").alias("v")), is_complex=False) if m.is_complex else m
