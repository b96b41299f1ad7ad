import numpy as np
import pytest

from matrelate import api
from matrelate.functions.control import SolverParameters
from matrelate.matrix import Matrix


@pytest.fixture(scope="module")
def spd(spark):
    a = np.random.default_rng(1).random((6, 6))
    a = a @ a.T / 6 + np.eye(6)
    return a, Matrix.from_numpy(spark, a)


def test_functions(spd):
    a, m = spd
    p = SolverParameters(converge_diff=1e-10)
    values, vectors = np.linalg.eigh(a)
    f = lambda g: (vectors * g(values)) @ vectors.T
    near = lambda x, y: np.allclose(x.to_numpy(), y, atol=1e-6)
    assert near(api.InverseSolvers.Invert(m, params=p), np.linalg.inv(a))
    assert near(api.SquareRootSolvers.SquareRoot(m, params=p, order=3), f(np.sqrt))
    assert near(api.RootSolvers.ComputeRoot(m, 5, params=p), f(lambda x: x**0.2))
    assert near(api.ExponentialSolvers.ComputeExponential(m), f(np.exp))
    assert near(api.TrigonometrySolvers.DenseCosine(m), f(np.cos))
    assert near(api.LinearSolvers.CGSolver(m, m, params=p), np.eye(6))
    assert near(api.LinearSolvers.CholeskyDecomposition(m), np.linalg.cholesky(a))
    low, high = api.EigenBounds.GershgorinBounds(m)
    assert low <= values[0] and values[-1] <= high
    assert np.allclose([r["value"] for r in api.EigenSolvers.EigenValues(m, 2).orderBy("k").collect()], values[:2])


def test_density_and_polynomials(spark, spd):
    a, m = spd
    values, vectors = np.linalg.eigh(a)
    one = Matrix.from_numpy(spark, np.eye(6))
    k, energy, mu = api.DensityMatrixSolvers.TRS4(m, one, 5.0, params=SolverParameters(converge_diff=1e-9))
    assert np.allclose(k.to_numpy(), vectors[:, :5] @ vectors[:, :5].T, atol=1e-4) and values[4] < mu < values[5]
    assert np.allclose(api.DensityMatrixSolvers.McWeenyStep(k).to_numpy(), k.to_numpy(), atol=1e-6)
    poly = api.Polynomial(3)
    for degree, c in enumerate((1.0, 0.5, 0.25)):
        poly.SetCoefficient(degree, c)
    expected = np.eye(6) + a / 2 + a @ a / 4
    assert np.allclose(poly.HornerCompute(m).to_numpy(), expected)
    assert np.allclose(poly.PatersonStockmeyerCompute(m, distributed=True).to_numpy(), expected)


def test_triplet_lists_and_permutations(spark):
    from matrelate import api

    a = api.TripletList.Of(spark, [(1, 1, 2.0), (2, 1, 3.0)]).Append((1, 1, 1.0), (3, 3, 5.0))
    assert a.Size() == 4 and a.GetTriplet(3, 3)["v"] == 5.0 and a.Resize(2).Size() == 2
    assert np.allclose(a.FillMatrix(3).to_numpy(), [[3, 0, 0], [3, 0, 0], [0, 0, 5]])
    assert [tuple(r) for r in a.SetTriplet(1, 1, 9.0).Shift(1, 0).Gather()] == [(2, 1, 9.0), (3, 1, 3.0), (4, 3, 5.0)]
    m = a.FillMatrix(3)
    p = api.Permutation(spark, 3, "reverse")
    assert np.allclose(p.Apply(m).to_numpy(), m.to_numpy()[::-1, ::-1]) and np.allclose(p.Apply(p.Apply(m), undo=True).to_numpy(), m.to_numpy())
    assert np.allclose(p.Matrix().to_numpy(), np.eye(3)[::-1])
    grid = api.ProcessGrid(1, 3)
    assert grid.place(m).df.rdd.getNumPartitions() == 3


def test_matrix_files(spark, tmp_path):
    from matrelate import api

    m = api.TripletList.Of(spark, [(1, 2, 0.5, -1.0)], is_complex=True).FillMatrix(2)
    for write, read, name in ((api.MatrixFiles.WriteMatrixMarket, api.MatrixFiles.ReadMatrixMarket, "a"), (api.MatrixFiles.WriteBinary, api.MatrixFiles.ReadBinary, "b")):
        write(m, f"{tmp_path}/{name}")
        assert np.allclose(read(spark, f"{tmp_path}/{name}").to_numpy(), [[0, 0.5 - 1j], [0, 0]])
