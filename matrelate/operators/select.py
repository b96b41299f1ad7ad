"""Projection, selection and user functions.  None of these shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from .aggregate import magnitude


def transpose(m: Matrix) -> Matrix:
    """Plain transpose, without conjugation."""
    return m.with_df(m.df.select(F.col("j").alias("i"), F.col("i").alias("j"), *m.values), rows=m.cols, cols=m.rows)


def conjugate(m: Matrix) -> Matrix:
    return m.with_df(m.df.select("i", "j", "re", (-F.col("im")).alias("im"))) if m.is_complex else m


def filter_small(m: Matrix, threshold: float) -> Matrix:
    """Entries above the threshold in magnitude; a negative one keeps stored zeros."""
    return m.with_df(m.df.where(magnitude(m) > threshold))


def slice_range(m: Matrix, row_from: int, row_to: int, col_from: int, col_to: int) -> Matrix:
    """Inclusive ranges, re-based to 1, in a square of the larger side."""
    df = m.df.where(F.col("i").between(row_from, row_to) & F.col("j").between(col_from, col_to))
    side = max(row_to - row_from, col_to - col_from) + 1
    return m.with_df(df.select((F.col("i") - (row_from - 1)).alias("i"), (F.col("j") - (col_from - 1)).alias("j"), *m.values), rows=side, cols=side)


def block(m: Matrix, row_from: int, row_to: int, col_from: int, col_to: int) -> DataFrame:
    """Triplets of the half-open block, in global coordinates."""
    return m.df.where((F.col("i") >= row_from) & (F.col("i") < row_to) & (F.col("j") >= col_from) & (F.col("j") < col_to))


def resize(m: Matrix, n: int) -> Matrix:
    return m.with_df(m.df.where((F.col("i") <= n) & (F.col("j") <= n)), rows=n, cols=n)


def extract_row(m: Matrix, row: int) -> Matrix:
    return m.with_df(m.df.where(F.col("i") == row).withColumn("i", F.lit(1).cast("long")), rows=1)


def extract_column(m: Matrix, column: int) -> Matrix:
    return m.with_df(m.df.where(F.col("j") == column).withColumn("j", F.lit(1).cast("long")), cols=1)


def shift(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """Triplets moved by an offset."""
    return df.withColumns({"i": F.col("i") + rows, "j": F.col("j") + cols})


def map_entries(m: Matrix, keep: Column | None = None, **columns: Column) -> Matrix:
    """Entries rewritten by column expressions (i, j, v or re, im); ``keep`` drops the others."""
    df = m.df if keep is None else m.df.where(keep)
    return m.with_df(df.select(*[columns.get(c, F.col(c)).alias(c) for c in ("i", "j", *m.values)]))


def map_function(m: Matrix, function: Callable[..., pd.DataFrame], *side) -> Matrix:
    """Entries rewritten by a function of an Arrow-fed pandas batch, which may drop rows.

    ``side`` are arrays that the function gets besides (broadcast once).
    """
    shared = m.spark.sparkContext.broadcast(side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch, *shared.value)

    return m.with_df(m.df.mapInPandas(run, m.df.schema))


def sort_triplets(df: DataFrame) -> DataFrame:
    """By column, then row."""
    return df.orderBy("j", "i")


def merge_lists(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for df in lists[1:]:
        out = out.unionByName(df)
    return out


def redistribute(m: Matrix, partitions: int, by: str = "j") -> Matrix:
    """The entries spread over a number of partitions by row, column or both (hashed), or in turn by column ("cyclic")."""
    if by == "cyclic":
        return m.with_df(m.df.repartitionById(partitions, (F.col("j") % partitions).cast("int")))
    keys = ["i", "j"] if by == "ij" else [by]
    return m.with_df(m.df.repartition(partitions, *keys))


class ProcessGrid:
    """A grid of partitions: entry blocks are dealt out by row block and column block."""

    def __init__(self, rows: int, cols: int):
        if rows < 1 or cols < 1:
            raise ValueError("a grid has a row and a column at least")
        self.rows, self.cols = rows, cols

    def cell(self, m: Matrix) -> Column:
        """Number of the grid cell that an entry belongs to, row by row."""
        across = F.floor((F.col("i") - 1) * self.rows / m.rows)
        along = F.floor((F.col("j") - 1) * self.cols / m.cols)
        return (across * self.cols + along).cast("int")

    def place(self, m: Matrix) -> Matrix:
        """The same matrix, a partition for each cell."""
        return m.with_df(m.df.repartitionById(self.rows * self.cols, self.cell(m)))

    def split(self) -> tuple[ProcessGrid, ProcessGrid]:
        """Two grids for two independent computations, cut along the longer side."""
        if self.rows >= self.cols:
            return ProcessGrid((self.rows + 1) // 2, self.cols), ProcessGrid(max(1, self.rows // 2), self.cols)
        return ProcessGrid(self.rows, (self.cols + 1) // 2), ProcessGrid(self.rows, max(1, self.cols // 2))


def together(*jobs: Callable):
    """Results of independent computations that run as Spark jobs side by side."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


# -- triplet lists: DataFrames of (i, j, values) ------------------------------


def triplet_at(df: DataFrame, i: int, j: int):
    """One entry of a triplet list, or None."""
    return df.where((F.col("i") == i) & (F.col("j") == j)).first()


def set_triplet(df: DataFrame, i: int, j: int, *value: float) -> DataFrame:
    """The list with the given value (or real and imaginary part) at a place, and no other there."""
    one = df.sparkSession.createDataFrame([(i, j, *map(float, value))], df.schema)
    return df.where((F.col("i") != i) | (F.col("j") != j)).unionByName(one)


def list_size(df: DataFrame) -> int:
    return df.count()


def resize_list(df: DataFrame, size: int) -> DataFrame:
    """The first entries in column order; missing ones are zeros at (0, 0)."""
    count = df.count()
    if size <= count:
        return df.orderBy("j", "i").limit(size)
    zero = df.sparkSession.range(size - count).select(*[F.lit(0).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(zero)


def compare_triplets(a, b) -> int:
    """-1, 0 or 1: the order of two entries by column, then row."""
    x, y = (a["j"], a["i"]), (b["j"], b["i"])
    return (x > y) - (x < y)


def map_list(df: DataFrame, keep: Column | None = None, **columns: Column) -> DataFrame:
    """Entries of a list rewritten by expressions of their columns; ``keep`` drops the others."""
    df = df if keep is None else df.where(keep)
    return df.select(*[columns.get(c, F.col(c)).alias(c) for c in df.columns])


def gather_list(df: DataFrame, most: int = 1_000_000) -> list:
    """A small list on the driver, by column, then row."""
    rows = df.orderBy("j", "i").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    return rows


def compose(grid: list[list[Matrix]]) -> Matrix:
    """One matrix from a grid of blocks."""
    top, parts = 0, []
    for line in grid:
        left = 0
        for m in line:
            parts.append(shift(m.df, top, left))
            left += m.cols
        top += line[0].rows
    return grid[0][0].with_df(merge_lists(*parts), rows=top, cols=sum(m.cols for m in grid[0]))


def gather_compose(grid: list[list[Matrix]], partitions: int) -> Matrix:
    """One settled matrix from blocks that lie anywhere, spread evenly over a number of partitions."""
    return redistribute(compose(grid), partitions, "ij").settled()


def split(m: Matrix, row_sizes: list[int], col_sizes: list[int]) -> list[list[Matrix]]:
    """A grid of blocks with the given sizes."""
    grid, top = [], 0
    for r in row_sizes:
        line, left = [], 0
        for c in col_sizes:
            df = shift(block(m, top + 1, top + r + 1, left + 1, left + c + 1), -top, -left)
            line.append(m.with_df(df, rows=r, cols=c))
            left += c
        grid.append(line)
        top += r
    return grid
