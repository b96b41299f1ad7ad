"""The solvers under the class names that users of matrix-function libraries know.

Results are returned, not written into arguments.  Matrices are ``Matrix``
objects; every method takes ``params`` (``SolverParameters``) where it
iterates, and ``distributed`` to force or forbid Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from .functions import analysis, bounds, dense, density, inverse, polynomial, transcendental
from pyspark.sql import Column, DataFrame, SparkSession

from .functions.control import Logger, SolverParameters, Timers
from .matrix import COMPLEX, REAL, Matrix, solve
from .operators import aggregate, algebra, generate, select
from .sources import binary, matrix_market


def _method(function: Callable, count: int, iterates: bool = True) -> staticmethod:
    """A static method whose first ``count`` arguments are matrices."""

    def call(*args, params: SolverParameters | None = None, distributed: bool | None = None, **options):
        if iterates:
            options["parameters"] = params or SolverParameters()
        threshold = params.threshold if params else 0.0
        names = function.__code__.co_varnames[count : function.__code__.co_argcount]
        return solve(function, *args[:count], distributed=distributed, threshold=threshold, **dict(zip(names, args[count:])), **options)

    call.__name__, call.__doc__ = function.__name__, function.__doc__
    return staticmethod(call)


class DensityMatrixSolvers:
    PM = _method(density.pm, 2)
    TRS2 = _method(density.trs2, 2)
    TRS4 = _method(density.trs4, 2)
    HPCP = _method(density.hpcp, 2)
    ScaleAndFold = _method(density.scale_and_fold, 2)
    DenseDensity = _method(density.dense_density, 2, False)
    EnergyDensityMatrix = _method(density.energy_density, 2, False)

    @staticmethod
    def McWeenyStep(d: Matrix, s: Matrix | None = None) -> Matrix:  # noqa: N802
        return solve(density.mcweeny_step, d) if s is None else solve(density.mcweeny_step, d, s)


class FermiOperator:
    ComputeDenseFOE = _method(density.dense_density, 2, False)
    WOM_GC = _method(density.wom_gc, 2)
    WOM_C = _method(density.wom_c, 2)


class GeometryOptimization:
    PurificationExtrapolate = _method(density.purification_extrapolate, 2)
    LowdinExtrapolate = _method(density.lowdin_extrapolate, 3)


class ExponentialSolvers:
    ComputeExponential = _method(transcendental.exponential, 1)
    ComputeExponentialPade = _method(transcendental.exponential_pade, 1)
    ComputeExponentialTaylor = _method(transcendental.exponential_taylor, 1)
    ComputeLogarithm = _method(transcendental.logarithm, 1)
    ComputeLogarithmTaylor = _method(transcendental.logarithm_taylor, 1)
    ComputeDenseExponential = staticmethod(dense.exponential)
    ComputeDenseLogarithm = staticmethod(dense.logarithm)


class TrigonometrySolvers:
    Sine = _method(transcendental.sine, 1)
    Cosine = _method(transcendental.cosine, 1)
    DenseSine = staticmethod(dense.sine)
    DenseCosine = staticmethod(dense.cosine)


class InverseSolvers:
    Invert = _method(inverse.invert, 1)
    PseudoInverse = _method(inverse.pseudo_inverse, 1)
    DenseInvert = staticmethod(dense.invert)


class SquareRootSolvers:
    SquareRoot = _method(inverse.square_root, 1)
    InverseSquareRoot = _method(inverse.inverse_square_root, 1)
    DenseSquareRoot = staticmethod(dense.square_root)
    DenseInverseSquareRoot = staticmethod(dense.inverse_square_root)


class RootSolvers:
    ComputeRoot = _method(inverse.root, 1)
    ComputeInverseRoot = _method(inverse.inverse_root, 1)


class SignSolvers:
    ComputeSign = _method(inverse.sign, 1)
    ComputePolarDecomposition = _method(inverse.polar, 1)
    ComputeDenseSign = staticmethod(dense.sign)


class LinearSolvers:
    CGSolver = _method(inverse.conjugate_gradient, 2)
    CholeskyDecomposition = _method(analysis.cholesky, 1, False)


class Analysis:
    PivotedCholeskyDecomposition = _method(analysis.pivoted_cholesky, 1, False)
    ReduceDimension = _method(analysis.reduce_dimension, 1)


class EigenBounds:
    GershgorinBounds = staticmethod(aggregate.gershgorin)
    PowerBounds = _method(bounds.power_bounds, 1)


class EigenSolvers:
    EigenDecomposition = staticmethod(dense.eigendecomposition)
    SingularValueDecomposition = staticmethod(dense.singular_values)
    EstimateGap = _method(density.estimate_gap, 2)

    @staticmethod
    def EigenValues(m: Matrix, count: int | None = None):  # noqa: N802
        return dense.eigendecomposition(m, count)[0]


class LoadBalancer:
    PermuteMatrix = staticmethod(algebra.permute)

    @staticmethod
    def UndoPermuteMatrix(m: Matrix, perm) -> Matrix:  # noqa: N802
        return algebra.permute(m, perm, undo=True)


class MatrixConversion:
    SnapMatrixToSparsityPattern = staticmethod(algebra.snap)


class MatrixMapper:
    Map = staticmethod(select.map_function)


class TripletList:
    """Entries (i, j, v) or (i, j, re, im) before they are a matrix; places may repeat.  Methods return new lists."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def Of(cls, spark: SparkSession, rows: list[tuple], is_complex: bool = False) -> TripletList:  # noqa: N802
        return cls(spark.createDataFrame(rows, COMPLEX if is_complex else REAL))

    @classmethod
    def OfMatrix(cls, m: Matrix) -> TripletList:  # noqa: N802
        return cls(m.df)

    def Append(self, *rows: tuple) -> TripletList:  # noqa: N802
        return TripletList(select.merge_lists(self.df, self.df.sparkSession.createDataFrame(list(rows), self.df.schema)))

    def Merge(self, *others: TripletList) -> TripletList:  # noqa: N802
        return TripletList(select.merge_lists(self.df, *[x.df for x in others]))

    def SetTriplet(self, i: int, j: int, *value: float) -> TripletList:  # noqa: N802
        return TripletList(select.set_triplet(self.df, i, j, *value))

    def GetTriplet(self, i: int, j: int):  # noqa: N802
        return select.triplet_at(self.df, i, j)

    def Size(self) -> int:  # noqa: N802
        return select.list_size(self.df)

    def Resize(self, size: int) -> TripletList:  # noqa: N802
        return TripletList(select.resize_list(self.df, size))

    def Sort(self) -> TripletList:  # noqa: N802
        return TripletList(select.sort_triplets(self.df))

    def Shift(self, rows: int, cols: int) -> TripletList:  # noqa: N802
        return TripletList(select.shift(self.df, rows, cols))

    def Symmetrize(self, kind: str) -> TripletList:  # noqa: N802
        return TripletList(generate.symmetrize_triplets(self.df, kind))

    def Map(self, keep: Column | None = None, **columns: Column) -> TripletList:  # noqa: N802
        return TripletList(select.map_list(self.df, keep, **columns))

    def Gather(self) -> list:  # noqa: N802
        return select.gather_list(self.df)

    def FillMatrix(self, rows: int, cols: int | None = None) -> Matrix:  # noqa: N802
        return Matrix.from_triplets(self.df, rows, cols)


class Permutation:
    """A reordering of 1 .. n: default, reverse, or random on the first ``limit`` indices."""

    def __init__(self, spark: SparkSession, n: int, kind: str = "default", seed: int = 0, limit: int | None = None):
        self.n, self.table = n, generate.permutation(spark, n, kind, seed, limit)

    def Matrix(self, by_rows: bool = True) -> Matrix:  # noqa: N802
        return generate.permutation_matrix(self.table, self.n, by_rows)

    def Apply(self, m: Matrix, undo: bool = False) -> Matrix:  # noqa: N802
        return algebra.permute(m, self.table, undo=undo)


#: Partitions in a grid of row blocks and column blocks.
ProcessGrid = select.ProcessGrid
#: Nested log lines, and named wall-clock timers.
Logging, Timer = Logger, Timers


class MatrixFiles:
    ReadMatrixMarket = staticmethod(matrix_market.read)
    WriteMatrixMarket = staticmethod(matrix_market.write)
    ReadBinary = staticmethod(binary.read)
    WriteBinary = staticmethod(binary.write)


class MatrixReduction:
    Compose = staticmethod(select.compose)
    GatherAndCompose = staticmethod(select.gather_compose)
    Split = staticmethod(select.split)
    RunTogether = staticmethod(select.together)


class _Coefficients:
    """Coefficients by degree, from 0."""

    def __init__(self, size: int):
        self.coefficients = [0.0] * size

    def SetCoefficient(self, degree: int, value: float) -> None:  # noqa: N802
        self.coefficients[degree] = value

    def _run(self, function, m: Matrix, **options) -> Matrix:
        return solve(function, m, coefficients=self.coefficients, **options)


class Polynomial(_Coefficients):
    def HornerCompute(self, m: Matrix, **options) -> Matrix:  # noqa: N802
        return self._run(polynomial.horner, m, **options)

    def PatersonStockmeyerCompute(self, m: Matrix, **options) -> Matrix:  # noqa: N802
        return self._run(polynomial.paterson_stockmeyer, m, **options)


class ChebyshevPolynomial(_Coefficients):
    def Compute(self, m: Matrix, **options) -> Matrix:  # noqa: N802
        return self._run(polynomial.chebyshev, m, **options)

    def ComputeFactorized(self, m: Matrix, **options) -> Matrix:  # noqa: N802
        return self._run(polynomial.chebyshev_factorized, m, **options)


class HermitePolynomial(_Coefficients):
    def Compute(self, m: Matrix, **options) -> Matrix:  # noqa: N802
        return self._run(polynomial.hermite, m, **options)
