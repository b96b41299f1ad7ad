"""Solvers against dense linear algebra, on one node and as Spark jobs."""

import numpy as np
import pytest

from matrelate.functions import analysis, bounds, dense, density, inverse, polynomial, transcendental
from matrelate.functions.control import Logger, Monitor, SolverParameters, Timers
from matrelate.matrix import Dense, Matrix, solve

TIGHT = SolverParameters(converge_diff=1e-10, max_iterations=300)
SIZE = 31


def random_symmetric(seed, is_complex=False, n=SIZE):
    r = np.random.default_rng(seed)
    a = r.random((n, n)) + (1j * r.random((n, n)) if is_complex else 0)
    return a + a.conj().T


def spd(seed, is_complex=False, n=SIZE):
    a = random_symmetric(seed, is_complex, n)
    return a @ a.conj().T / n + np.eye(n)


def f_of(a, f):
    values, vectors = np.linalg.eigh(a)
    return (vectors * f(values)) @ vectors.conj().T


def near(m, expected, tolerance=1e-4):
    return np.linalg.norm(m.a - expected) <= tolerance * np.linalg.norm(expected)


@pytest.mark.parametrize("is_complex", [False, True])
class TestFunctions:
    def test_invert(self, is_complex):
        a = spd(1, is_complex)
        assert near(inverse.invert(Dense(a), TIGHT), np.linalg.inv(a))

    def test_pseudo_inverse_of_singular(self, is_complex):
        a = random_symmetric(2, is_complex)
        values, vectors = np.linalg.eigh(a)
        values[:11] = 0
        values[11:] = np.linspace(1, 3, 20)
        a = (vectors * values) @ vectors.conj().T
        assert near(inverse.pseudo_inverse(Dense(a)), np.linalg.pinv(a, hermitian=True))

    @pytest.mark.parametrize("order", [2, 3, 5])
    def test_square_roots(self, is_complex, order):
        a = spd(3, is_complex)
        assert near(inverse.square_root(Dense(a), TIGHT, order), f_of(a, np.sqrt))
        assert near(inverse.inverse_square_root(Dense(a), TIGHT, order), f_of(a, lambda x: x**-0.5))

    @pytest.mark.parametrize("p", [1, 2, 3, 4, 5, 6, 7, 8])
    def test_roots(self, is_complex, p):
        a = spd(4, is_complex)
        assert near(inverse.root(Dense(a), p, TIGHT), f_of(a, lambda x: x ** (1 / p)))
        assert near(inverse.inverse_root(Dense(a), p, TIGHT), f_of(a, lambda x: x ** (-1 / p)))

    def test_sign_and_polar(self, is_complex):
        a = random_symmetric(5, is_complex)
        assert near(inverse.sign(Dense(a), TIGHT), f_of(a, np.sign))
        b = a + np.triu(a)
        u, h = inverse.polar(Dense(b), TIGHT)
        left, s, right = np.linalg.svd(b)
        assert near(u, left @ right) and near(h, right.conj().T @ np.diag(s) @ right)

    def test_exponentials(self, is_complex):
        a = random_symmetric(6, is_complex) / 8
        for f in (transcendental.exponential, transcendental.exponential_pade, transcendental.exponential_taylor):
            assert near(f(Dense(a), TIGHT), f_of(a, np.exp))

    def test_logarithms(self, is_complex):
        a = spd(7, is_complex)
        for f in (transcendental.logarithm, transcendental.logarithm_taylor):
            assert near(f(Dense(a), TIGHT), f_of(a, np.log))

    def test_trigonometry(self, is_complex):
        a = random_symmetric(8, is_complex) / 4
        for f, g in [(transcendental.cosine, np.cos), (transcendental.sine, np.sin), (transcendental.cosine_taylor, np.cos), (transcendental.sine_taylor, np.sin)]:
            assert near(f(Dense(a), TIGHT), f_of(a, g))

    def test_conjugate_gradient(self, is_complex):
        a, b = spd(9, is_complex), random_symmetric(10, is_complex)
        assert near(inverse.conjugate_gradient(Dense(a), Dense(b), TIGHT), np.linalg.solve(a, b))


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 8, 16, 17])
def test_polynomials(length):
    a = random_symmetric(11)
    a = a / np.abs(np.linalg.eigvalsh(a)).max()
    c = [0.5**k for k in range(length)]
    assert near(polynomial.horner(Dense(a), c), f_of(a, lambda x: np.polynomial.polynomial.polyval(x, c)))
    assert near(polynomial.paterson_stockmeyer(Dense(a), c), f_of(a, lambda x: np.polynomial.polynomial.polyval(x, c)))
    assert near(polynomial.chebyshev(Dense(a), c), f_of(a, lambda x: np.polynomial.chebyshev.chebval(x, c)))
    assert near(polynomial.chebyshev_factorized(Dense(a), c), f_of(a, lambda x: np.polynomial.chebyshev.chebval(x, c)))
    assert near(polynomial.hermite(Dense(a), c), f_of(a, lambda x: np.polynomial.hermite.hermval(x, c)))


def test_paterson_stockmeyer_uses_few_products():
    products = []

    class Counting(Dense):
        def __matmul__(self, other):
            products.append(1)
            return Counting(self.a @ other.a)

        def __mul__(self, factor):
            return Counting(self.a * factor)

        __rmul__ = __mul__

        def __add__(self, other):
            return Counting(self.a + other.a)

        def eye(self):
            return Counting(np.eye(self.n))

    polynomial.paterson_stockmeyer(Counting(np.eye(3)), [1.0] * 26)
    assert len(products) <= 10


def hamiltonian(n=7, occupied=5, seed=12, is_complex=False):
    a = random_symmetric(seed, is_complex, n)
    values, vectors = np.linalg.eigh(a)
    values[:occupied] -= 2
    return (vectors * values) @ vectors.conj().T


@pytest.mark.parametrize("is_complex", [False, True])
@pytest.mark.parametrize("name", ["pm", "trs2", "trs4", "hpcp", "scale_and_fold", "dense_density"])
def test_density(name, is_complex):
    h, s = hamiltonian(is_complex=is_complex), spd(13, is_complex, 7)
    isq = f_of(s, lambda x: x**-0.5)
    wh = isq @ h @ isq.conj().T
    levels, vectors = np.linalg.eigh(wh)
    d = vectors[:, :5] @ vectors[:, :5].conj().T
    expected = isq.conj().T @ d @ isq
    options = {"homo": levels[4], "lumo": levels[5]} if name == "scale_and_fold" else {}
    if name != "dense_density":
        options["parameters"] = TIGHT
    out = getattr(density, name)(Dense(h), Dense(isq), 5.0, **options)
    assert near(out[0], expected)
    energy = levels[:5].sum() * (2 if name == "scale_and_fold" else 1)
    assert abs(out[1] - energy) < 1e-4
    if len(out) > 2:
        assert levels[4] - 1e-6 <= out[2] <= levels[5] + 1e-6


def test_finite_temperature():
    h = hamiltonian()
    one = Dense(np.eye(7))
    levels, vectors = np.linalg.eigh(h)
    beta, p = 2.0, SolverParameters(step_thresh=1e-5, converge_diff=1e-9)
    filled, mu = density.occupations(levels, 5.0, beta)
    expected = (vectors * filled) @ vectors.T
    assert near(density.dense_density(Dense(h), one, 5.0, beta)[0], expected)
    assert near(density.wom_gc(Dense(h), one, mu, beta, p)[0], expected, 1e-2)
    assert near(density.wom_c(Dense(h), one, 5.0, beta, p)[0], expected, 1e-2)
    assert np.isclose(density.occupations(levels, 4.5)[0].sum(), 4.5)


def test_chemistry_formulas():
    h, s = hamiltonian(), spd(14, n=7)
    levels, vectors = np.linalg.eigh(h)
    d = vectors[:, :5] @ vectors[:, :5].T
    assert near(density.energy_density(Dense(h), Dense(d)), d @ h @ d)
    assert near(density.mcweeny_step(Dense(d)), d)
    assert near(density.mcweeny_step(Dense(d), Dense(s)), 3 * d @ s @ d - 2 * d @ s @ d @ s @ d)
    # a density in the metric of s keeps being one after a change of metric
    s2 = s + 0.01 * spd(15, n=7)
    old = f_of(s, lambda x: x**-0.5) @ d @ f_of(s, lambda x: x**-0.5)
    for out in (density.lowdin_extrapolate(Dense(old), Dense(s), Dense(s2), TIGHT), density.purification_extrapolate(Dense(old), Dense(s2), 5.0, TIGHT)):
        assert np.allclose(out.a @ s2 @ out.a, out.a, atol=1e-5) and abs(np.trace(out.a @ s2) - 5) < 1e-4
    k, _, mu = density.trs4(Dense(h), Dense(np.eye(7)), 5.0, TIGHT)
    assert abs(density.estimate_gap(Dense(h), k, mu, TIGHT) - 2 * (mu - levels[4])) < 0.5


def test_power_bounds_and_factorizations():
    a = spd(16)
    assert abs(bounds.power_bounds(Dense(a), SolverParameters(max_iterations=100, converge_diff=1e-9)) - np.linalg.eigvalsh(a).max()) < 1e-3
    assert near(analysis.cholesky(Dense(a)), np.linalg.cholesky(a))
    low = random_symmetric(17)[:, :6]
    low = low @ low.T
    factor = analysis.pivoted_cholesky(Dense(low), 6).a
    assert np.allclose(factor @ factor.T, low, atol=1e-8) and not factor[:, 6:].any()
    small = analysis.reduce_dimension(Dense(hamiltonian()), 5, TIGHT).a
    assert np.allclose(np.linalg.eigvalsh(small), np.linalg.eigvalsh(hamiltonian())[:5], atol=1e-5)


def test_distributed_matches_local(spark):
    a = spd(18, n=6)
    m = Matrix.from_numpy(spark, a)
    loose = SolverParameters(converge_diff=1e-6)
    assert np.allclose(solve(inverse.invert, m, distributed=True, parameters=loose).to_numpy(), np.linalg.inv(a), atol=1e-5)
    assert np.allclose(solve(inverse.square_root, m, distributed=True, parameters=loose).to_numpy(), f_of(a, np.sqrt), atol=1e-5)
    assert np.allclose(solve(polynomial.chebyshev_factorized, m, distributed=True, coefficients=[1, 0.5, 0.25]).to_numpy(), f_of(a, lambda x: np.polynomial.chebyshev.chebval(x, [1, 0.5, 0.25])), atol=1e-6)
    assert np.allclose(analysis.cholesky_blocked(m, panel=4).to_numpy(), np.linalg.cholesky(a), atol=1e-8)


def test_distributed_density(spark):
    h = hamiltonian(5, 2)
    levels, vectors = np.linalg.eigh(h)
    one = Matrix.from_numpy(spark, np.eye(5))
    k, energy, _ = solve(density.trs2, Matrix.from_numpy(spark, h), one, distributed=True, ne=2.0, parameters=SolverParameters(converge_diff=1e-5))
    assert np.allclose(k.to_numpy(), vectors[:, :2] @ vectors[:, :2].T, atol=1e-3) and abs(energy - levels[:2].sum()) < 1e-3


def test_dense_functions(spark):
    a = spd(19, n=8)
    m = Matrix.from_numpy(spark, a)
    for f, g in [(dense.exponential, np.exp), (dense.logarithm, np.log), (dense.sine, np.sin), (dense.cosine, np.cos), (dense.invert, lambda x: 1 / x), (dense.square_root, np.sqrt), (dense.inverse_square_root, lambda x: x**-0.5), (dense.sign, np.sign)]:
        assert np.allclose(f(m).to_numpy(), f_of(a, g))
    values, vectors = dense.eigendecomposition(m, 3)
    assert np.allclose([r["value"] for r in values.orderBy("k").collect()], np.linalg.eigvalsh(a)[:3]) and vectors.cols == 3
    left, s, right = dense.singular_values(m)
    middle = np.diag([r["value"] for r in s.orderBy("k").collect()])
    assert np.allclose(left.to_numpy() @ middle @ right.to_numpy().T, a, atol=1e-4)


def test_monitor():
    m = Monitor(1e-6)
    m.append(1e-7)
    assert m.converged()
    m = Monitor(1e-12)
    for _ in range(6):
        m.append(1e-5)
    assert m.converged()
    m = Monitor(1e-12, automatic=False)
    for _ in range(9):
        m.append(1e-5)
    assert not m.converged()
    m = Monitor(1e-12)
    for v in [1, 0.1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6]:
        m.append(v)
        assert not m.converged()


def test_logger_and_timers():
    import io

    out = io.StringIO()
    log = Logger(True, out)
    with log.section("Solver"):
        log.element("Threshold", 0.1)
        log.item("Round", 0, Convergence=0.5)
    assert out.getvalue() == "Solver:\n  Threshold: 0.1\n  - Round: 0\n    Convergence: 0.5\n"
    timers = Timers()
    with timers.run("x"):
        pass
    assert timers.report().startswith("x: 0.")


@pytest.mark.parametrize("is_complex", [False, True])
def test_cholesky_as_spark_jobs(spark, is_complex):
    r = np.random.default_rng(8)
    x = r.random((9, 9)) + (1j * r.random((9, 9)) if is_complex else 0)
    a = x @ x.conj().T + 9 * np.eye(9)
    m = Matrix.from_numpy(spark, a)
    assert np.allclose(solve(analysis.cholesky, m, distributed=True).to_numpy(), np.linalg.cholesky(a))
    assert np.allclose(analysis.cholesky_blocked(m, panel=4).to_numpy(), np.linalg.cholesky(a))


@pytest.mark.parametrize("rank", [2, 4, 6])
def test_pivoted_cholesky_as_spark_jobs(spark, rank):
    """Also of a matrix of lower rank, where it ends early."""
    x = np.random.default_rng(9).random((6, 4))
    a = x @ x.T
    m = Matrix.from_numpy(spark, a)
    near, far = (solve(analysis.pivoted_cholesky, m, rank=rank, distributed=d).to_numpy() for d in (False, True))
    assert np.allclose(near[:, :4], far[:, :4], atol=1e-6)
    if rank >= 4:
        assert np.allclose(far @ far.T, a)


def test_reduce_dimension_and_dense_density_above_one_node(spark, monkeypatch):
    """Solvers that run on arrays below the limit run as jobs, or gather, above it."""
    from matrelate import matrix

    monkeypatch.setattr(matrix, "LOCAL_LIMIT", 4)
    a = np.diag([-3.0, -2.0, 1.0, 2.0, 3.0, 4.0]) + 0.05
    m, one = Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, np.eye(6))
    reduced = solve(analysis.reduce_dimension, m, dim=2)
    assert reduced.rows == reduced.cols == 2
    assert np.allclose(np.linalg.eigvalsh(reduced.to_numpy()), np.linalg.eigvalsh(a)[:2], atol=1e-4)
    d, energy, mu = solve(density.dense_density, m, one, ne=2.0)
    assert abs(energy - np.linalg.eigvalsh(a)[:2].sum()) < 1e-9 and abs(np.trace(d.to_numpy()) - 2) < 1e-9 and -2 < mu < 1
    monkeypatch.setattr(matrix, "GATHER_LIMIT", 5)
    with pytest.raises(ValueError, match="too large for one node"):
        solve(density.dense_density, m, one, ne=2.0)


def test_filled_products_of_solvers_use_tiles(spark, monkeypatch):
    from matrelate.operators import kernels

    monkeypatch.setattr(kernels, "DENSE_SIDE", 4)
    a = np.eye(6) * 2 + 0.1
    out = solve(inverse.invert, Matrix.from_numpy(spark, a), distributed=True, parameters=SolverParameters(converge_diff=1e-7))
    assert np.allclose(out.to_numpy(), np.linalg.inv(a))


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e-5])
def test_power_bounds_of_a_dominant_eigenvalue(scale):
    """Where the iteration settles to rounding, extrapolation must not amplify it."""
    a = (np.ones((25, 25)) + 0.03 * random_symmetric(21, n=25)) * scale
    found = bounds.power_bounds(Dense(a), SolverParameters(max_iterations=60, converge_diff=1e-9 * scale))
    assert abs(found / np.linalg.eigvalsh(a).max() - 1) < 1e-9
