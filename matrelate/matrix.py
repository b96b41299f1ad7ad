"""Matrices as relations.

A ``Matrix`` is a DataFrame of stored entries with 1-based coordinates:
(i, j, v) for real values, (i, j, re, im) for complex ones.  Absent rows are
zeros; stored zeros are legal and count as entries.  Instances are immutable
and lazy; arithmetic builds plans, and products are settled so that loops keep
short plans.

``Dense`` has the same interface on a NumPy array, for matrices that one node
holds easily.  Solvers are written once against that interface.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Square matrices up to this dimension are solved on the driver (2 MB of doubles).
LOCAL_LIMIT = 512
#: A matrix of at most this dimension is gathered where a method needs it in one place (512 MB of doubles).
GATHER_LIMIT = 16 * LOCAL_LIMIT

REAL = "i long, j long, v double"
COMPLEX = "i long, j long, re double, im double"


@dataclass(frozen=True)
class Matrix:
    """Stored entries, dimensions, and the threshold at which products drop entries."""

    df: DataFrame
    rows: int
    cols: int
    is_complex: bool = False
    threshold: float = 0.0
    is_identity: bool = False
    #: what has been found out about the entries, such as their number
    known: dict = field(default_factory=dict, compare=False, repr=False)

    # -- construction ----------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, rows: int, cols: int | None = None, threshold: float = 0.0) -> Matrix:
        """A matrix over a DataFrame whose coordinates are distinct already."""
        is_complex = "im" in df.columns
        values = [F.col(c).cast("double").alias(c) for c in (("re", "im") if is_complex else ("v",))]
        df = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *values)
        return cls(df, rows, rows if cols is None else cols, is_complex, threshold)

    @classmethod
    def from_triplets(cls, df: DataFrame, rows: int, cols: int | None = None) -> Matrix:
        """A matrix from a triplet list; entries of equal coordinates are summed."""
        m = cls.of(df, rows, cols)
        return m.with_df(m.df.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in m.values]))

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, keep_zeros: bool = False) -> Matrix:
        """Entries of a small array."""
        i, j = np.nonzero(np.ones(array.shape, bool) if keep_zeros else array)
        cells, is_complex = array[i, j], np.iscomplexobj(array)
        parts = {"re": cells.real, "im": cells.imag} if is_complex else {"v": cells}
        table = pa.table({"i": pa.array(i + 1, pa.int64()), "j": pa.array(j + 1, pa.int64()), **{k: pa.array(np.ascontiguousarray(x, float)) for k, x in parts.items()}})
        if not len(i):
            return cls(spark.createDataFrame([], COMPLEX if is_complex else REAL), *array.shape, is_complex)
        return cls(spark.createDataFrame(table), *array.shape, is_complex)

    # -- views -----------------------------------------------------------

    @property
    def values(self) -> tuple[str, ...]:
        return ("re", "im") if self.is_complex else ("v",)

    @property
    def n(self) -> int:
        if self.rows != self.cols:
            raise ValueError(f"the matrix is {self.rows} x {self.cols}, not square")
        return self.rows

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, **changes) -> Matrix:
        return replace(self, df=df, is_identity=False, known={}, **changes)

    def settled(self) -> Matrix:
        return replace(self, df=scratch.settle(self.df))

    def entries(self) -> int:
        """Stored entries, counted once."""
        if "entries" not in self.known:
            self.known["entries"] = self.n if self.is_identity else self.df.count()
        return self.known["entries"]

    def to_numpy(self) -> np.ndarray:
        """The whole matrix on the driver; bounded by the dimensions."""
        if max(self.rows, self.cols) > GATHER_LIMIT:
            raise ValueError(f"{self.rows} x {self.cols} is too large for one node; methods that need the whole matrix stop at {GATHER_LIMIT}")
        out = np.zeros((self.rows, self.cols), complex if self.is_complex else float)
        data = self.df.toPandas()
        cells = data["re"].to_numpy() + 1j * data["im"].to_numpy() if self.is_complex else data["v"].to_numpy()
        np.add.at(out, (data["i"].to_numpy(int) - 1, data["j"].to_numpy(int) - 1), cells)
        return out

    # -- the interface shared with Dense ---------------------------------

    def eye(self) -> Matrix:
        from .operators import generate

        return replace(generate.identity(self.spark, self.n), threshold=self.threshold)

    def __matmul__(self, other: Matrix) -> Matrix:
        from .operators import kernels

        if self.is_identity:
            return other
        if other.is_identity:
            return self
        return kernels.multiply(self, other, threshold=self.threshold).settled()

    def __add__(self, other: Matrix) -> Matrix:
        from .operators import algebra

        return algebra.axpy(self, other, 1.0, threshold=self.threshold)

    def __sub__(self, other: Matrix) -> Matrix:
        from .operators import algebra

        return algebra.axpy(other, self, -1.0, threshold=self.threshold)

    def __mul__(self, factor: float) -> Matrix:
        from .operators import algebra

        return algebra.scale(self, factor)

    __rmul__ = __mul__

    def __neg__(self) -> Matrix:
        return self * -1.0

    @property
    def H(self) -> Matrix:  # noqa: N802
        from .operators import select

        return select.conjugate(select.transpose(self))

    def trace(self) -> float:
        from .operators import aggregate

        return aggregate.trace(self)

    def norm1(self) -> float:
        from .operators import aggregate

        return aggregate.norm1(self)

    def dot(self, other: Matrix) -> float:
        from .operators import algebra

        return algebra.dot(self, other).real

    def bounds(self) -> tuple[float, float]:
        from .operators import aggregate

        return aggregate.gershgorin(self)

    def release(self) -> Matrix:
        return self


@dataclass(frozen=True)
class Dense:
    """The interface of ``Matrix`` on one node."""

    a: np.ndarray
    threshold: float = 0.0

    @property
    def n(self) -> int:
        return self.a.shape[0]

    def _new(self, a: np.ndarray) -> Dense:
        if self.threshold > 0:
            a = np.where(np.abs(a) > self.threshold, a, 0)
        return Dense(a, self.threshold)

    def eye(self) -> Dense:
        return Dense(np.eye(self.n), self.threshold)

    def __matmul__(self, other: Dense) -> Dense:
        return self._new(self.a @ other.a)

    def __add__(self, other: Dense) -> Dense:
        return self._new(self.a + other.a)

    def __sub__(self, other: Dense) -> Dense:
        return self._new(self.a - other.a)

    def __mul__(self, factor: float) -> Dense:
        return Dense(self.a * factor, self.threshold)

    __rmul__ = __mul__

    def __neg__(self) -> Dense:
        return self * -1.0

    @property
    def H(self) -> Dense:  # noqa: N802
        return Dense(self.a.conj().T, self.threshold)

    def settled(self) -> Dense:
        return self

    def trace(self) -> float:
        return float(np.trace(self.a).real)

    def norm1(self) -> float:
        return float(np.abs(self.a).sum(axis=0).max()) if self.a.size else 0.0

    def dot(self, other: Dense) -> float:
        return float(np.vdot(self.a, other.a).real)

    def bounds(self) -> tuple[float, float]:
        centre = np.diag(self.a).real
        reach = np.abs(self.a).sum(axis=0) - np.abs(np.diag(self.a))
        return float((centre - reach).min()), float((centre + reach).max())


def solve(solver, *matrices: Matrix, distributed: bool | None = None, threshold: float = 0.0, **options):
    """Run a solver on matrices: on the driver up to ``LOCAL_LIMIT``, as Spark jobs above it.

    ``distributed`` forces either.  Matrices in the result come back as
    ``Matrix``; other values as they are.
    """
    spark = matrices[0].spark
    if distributed is None:
        distributed = max(m.rows for m in matrices) > LOCAL_LIMIT
    if distributed:
        with scratch.folder(spark):
            out = solver(*[replace(m.settled(), threshold=threshold) for m in matrices], **options)
            kept = lambda x: replace(x, df=scratch.settle(x.df, keep=True)) if isinstance(x, Matrix) else x
            return tuple(map(kept, out)) if isinstance(out, tuple) else kept(out)
    out = solver(*[Dense(m.to_numpy(), threshold) for m in matrices], **options)
    back = lambda x: Matrix.from_numpy(spark, x.a) if isinstance(x, Dense) else x
    return tuple(map(back, out)) if isinstance(out, tuple) else back(out)
