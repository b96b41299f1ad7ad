"""Operators against NumPy on random sparse matrices, real and complex."""

import numpy as np
import pytest

from matrelate.matrix import Matrix
from matrelate.operators import aggregate, algebra, generate, kernels, select

THRESHOLD = 1e-4


def sparse(rows, cols, density, is_complex, seed):
    r = np.random.default_rng(seed)
    a = r.random((rows, cols)) * (r.random((rows, cols)) < density)
    return a + 1j * r.random((rows, cols)) * (a != 0) if is_complex else a


def close(m, array):
    return np.linalg.norm(m.to_numpy() - array) < THRESHOLD


KINDS = [(False, False), (True, True), (False, True), (True, False)]
DENSITIES = [(1, 1), (0.2, 0.2), (0, 0), (1, 0), (0, 1)]


@pytest.mark.parametrize("kinds", KINDS)
@pytest.mark.parametrize("density", DENSITIES)
def test_algebra(spark, kinds, density):
    a, b = (sparse(11, 11, d, k, s) for s, (d, k) in enumerate(zip(density, kinds)))
    x, y = Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, b)
    assert close(algebra.axpy(x, y, 0.5), 0.5 * a + b)
    assert close(algebra.gemm(x, y), a @ b)
    assert close(algebra.hadamard(x, y), a * b)
    assert abs(algebra.dot(x, y) - np.vdot(a, b)) < THRESHOLD


def test_gemm_beta_and_threshold(spark):
    a = sparse(9, 9, 0.5, False, 1)
    m = Matrix.from_numpy(spark, a)
    assert close(algebra.gemm(m, m, 2.0, 3.0, m), 2 * a @ a + 3 * a)
    cut = algebra.gemm(m, m, threshold=1.0).to_numpy()
    assert np.allclose(cut, np.where(np.abs(a @ a) > 1, a @ a, 0))


def test_rectangular(spark):
    a, b = sparse(2, 4, 1, False, 2), sparse(4, 3, 1, False, 3)
    assert close(algebra.gemm(Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, b)), a @ b)
    with pytest.raises(ValueError):
        algebra.gemm(Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, a))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        a = sparse(13, 13, 0.4, False, 4)
        m = Matrix.from_numpy(spark, a)
        assert close(algebra.gemm(m, select.transpose(m)), a @ a.T)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocked_kernel(spark):
    a, b = sparse(20, 17, 0.9, False, 5), sparse(17, 9, 0.9, False, 6)
    x, y = Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, b)
    assert close(kernels.gemm_blocked(x, y, alpha=0.5, size=6), 0.5 * a @ b)
    assert close(kernels.multiply(x, y), a @ b)


def test_projections(spark):
    a = sparse(8, 8, 0.6, True, 7)
    m = Matrix.from_numpy(spark, a)
    assert close(select.transpose(m), a.T)
    assert close(select.conjugate(m), a.conj())
    assert close(m.H, a.conj().T)
    assert close(select.filter_small(m, 0.7), np.where(np.abs(a) > 0.7, a, 0))
    assert close(select.slice_range(m, 2, 5, 3, 6), a[1:5, 2:6])
    assert close(select.resize(m, 4), a[:4, :4])
    assert np.allclose(select.extract_row(m, 3).to_numpy(), a[2:3])
    assert np.allclose(select.extract_column(m, 3).to_numpy(), a[:, 2:3])
    parts = select.split(m, [3, 5], [6, 2])
    assert close(parts[1][0], a[3:, :6])
    assert close(select.compose(parts), a)
    assert {(r["i"], r["j"]) for r in select.block(m, 2, 4, 5, 7).collect()} == {(i + 1, j + 1) for i, j in np.argwhere(a) if 1 <= i < 3 and 4 <= j < 6}


def test_generators_and_permutations(spark):
    a = sparse(6, 6, 0.7, False, 8)
    m = Matrix.from_numpy(spark, a)
    assert close(generate.identity(spark, 5), np.eye(5))
    assert close(generate.dense_ones(spark, 3), np.ones((3, 3)))
    assert generate.empty(spark, 4, True).df.count() == 0
    perm = generate.permutation(spark, 6, "random", seed=3)
    p = generate.permutation_matrix(perm, 6, by_rows=False).to_numpy()
    assert close(algebra.permute(m, perm), p @ a @ p.T)
    assert close(algebra.permute(algebra.permute(m, perm), perm, undo=True), a)
    assert sorted(r["new_idx"] for r in generate.permutation(spark, 6, "random", seed=1, limit=4).where("idx <= 4").collect()) == [1, 2, 3, 4]
    half = np.tril(a)
    sym = generate.symmetrize_triplets(Matrix.from_numpy(spark, half).df, "symmetric")
    assert close(Matrix.of(sym, 6), half + half.T - np.diag(np.diag(half)))
    with pytest.raises(ValueError):
        generate.symmetrize_triplets(m.df, "none")
    c = Matrix.from_numpy(spark, np.tril(sparse(5, 5, 1, True, 9), -1))
    h = Matrix.of(generate.symmetrize_triplets(c.df, "hermitian"), 5).to_numpy()
    assert np.allclose(h, h.conj().T)


def test_duplicate_triplets_are_summed(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (2, 1, 5.0)], "i long, j long, v double")
    assert close(Matrix.from_triplets(df, 2), np.array([[3.0, 0], [5, 0]]))


def test_joins_with_vectors_and_patterns(spark):
    a = sparse(5, 5, 0.6, False, 10)
    m = Matrix.from_numpy(spark, a)
    factors = spark.createDataFrame([(2, 3.0), (4, 0.0)], "j long, f double")
    d = np.diag([1, 3.0, 1, 0, 1])
    assert close(algebra.diagonal_scale(m, factors), a @ d)
    pattern = np.eye(5)
    snapped = algebra.snap(m, Matrix.from_numpy(spark, pattern))
    assert snapped.df.count() == 5 and close(snapped, a * pattern)
    assert close(algebra.similarity(m, m, m), a @ a @ a)
    assert algebra.similarity(m, generate.identity(spark, 5), generate.identity(spark, 5)) is m


def test_aggregates(spark):
    a = sparse(7, 7, 0.5, True, 11)
    m = Matrix.from_numpy(spark, a)
    assert np.isclose(aggregate.grand_sum(m), a.sum())
    assert np.isclose(aggregate.trace(m), np.trace(a).real)
    assert np.isclose(aggregate.norm1(m), np.abs(a).sum(0).max())
    assert np.isclose(aggregate.sigma_table(m).first()[0], 1 / np.abs(a).sum(0).max() ** 2)
    assert aggregate.nnz(m) == np.count_nonzero(a)
    assert not aggregate.is_identity(m)
    off = np.abs(a).sum(0) - np.abs(np.diag(a))
    assert np.allclose(aggregate.gershgorin(m), ((np.diag(a).real - off).min(), (np.diag(a).real + off).max()))
    low, high = aggregate.load_balance(m)
    assert low <= high
    real = np.diag([1.0, 5, 5, 2])
    assert tuple(aggregate.max_diagonal(Matrix.from_numpy(spark, real)).first()) == (2, 5.0)
    assert np.isclose(algebra.asymmetry_table(m).first()[0], np.abs(a.conj().T - a).sum(0).max())
    assert close(algebra.symmetrize(m), (a + a.conj().T) / 2)


def test_empty_matrix(spark):
    e = generate.empty(spark, 3)
    assert aggregate.trace(e) == 0 and aggregate.norm1(e) == 0 and aggregate.gershgorin(e) == (0, 0)
    assert close(algebra.gemm(e, e), np.zeros((3, 3)))


def test_maps(spark):
    from pyspark.sql import functions as F

    a = sparse(6, 6, 0.8, False, 12)
    m = Matrix.from_numpy(spark, a)
    assert close(select.map_entries(m, F.col("i") <= F.col("j"), v=F.col("v") * 2), np.triu(a) * 2)

    def double(batch, factors):
        batch = batch[batch["i"] != 3].copy()
        batch["v"] *= factors[batch["j"].to_numpy() - 1]
        return batch

    expected = a * np.arange(6)
    expected[2] = 0
    assert close(select.map_function(m, double, np.arange(6.0)), expected)


@pytest.mark.parametrize("kinds", KINDS)
def test_tiles(spark, kinds):
    """Blocked products, real, complex and mixed, with tiles that do not divide the sides, and partial sums that overflow their bound."""
    a, b = sparse(11, 17, 0.6, kinds[0], 1), sparse(17, 9, 0.6, kinds[1], 2)
    x, y = Matrix.from_numpy(spark, a), Matrix.from_numpy(spark, b)
    assert close(kernels.gemm_blocked(x, y, 0.5, size=4), 0.5 * a @ b)


def test_tiles_flush(spark, monkeypatch):
    monkeypatch.setattr(kernels, "HELD_BYTES", 1)
    a = sparse(12, 12, 0.9, False, 1)
    x = Matrix.from_numpy(spark, a)
    assert close(kernels.gemm_blocked(x, x, size=5), a @ a)


def test_kernel_choice(spark, monkeypatch):
    monkeypatch.setattr(kernels, "DENSE_SIDE", 4)
    full, thin = (Matrix.from_numpy(spark, sparse(12, 12, d, False, 1)) for d in (1.0, 0.05))
    for x, y in ((full, full), (full, thin), (thin, thin)):
        assert close(kernels.multiply(x, y), x.to_numpy() @ y.to_numpy())
    assert full.known["entries"] == 144


@pytest.mark.parametrize("limit", [None, 37])
def test_random_permutation(spark, monkeypatch, limit):
    monkeypatch.setattr(generate, "PERMUTATION_BUCKET", 10)
    rows = sorted(tuple(r) for r in generate.permutation(spark, 60, "random", seed=5, limit=limit).collect())
    top = limit or 60
    assert [i for i, _ in rows] == list(range(1, 61)) and sorted(x for _, x in rows) == list(range(1, 61))
    assert all(i == x for i, x in rows if i > top) and sum(i == x for i, x in rows if i <= top) < 10


def test_triplet_lists(spark):
    m = Matrix.from_numpy(spark, np.array([[1.0, 2.0], [0.0, 4.0]]))
    changed = select.set_triplet(select.set_triplet(m.df, 1, 2, 9.0), 2, 1, 5.0)
    assert [tuple(r) for r in select.gather_list(changed)] == [(1, 1, 1.0), (2, 1, 5.0), (1, 2, 9.0), (2, 2, 4.0)]
    assert select.list_size(changed) == 4 and select.triplet_at(changed, 2, 1)["v"] == 5.0
    assert [tuple(r) for r in select.gather_list(select.resize_list(changed, 2))] == [(1, 1, 1.0), (2, 1, 5.0)]
    assert [tuple(r) for r in select.resize_list(m.df.limit(0), 2).collect()] == [(0, 0, 0.0)] * 2
    a, b = select.gather_list(changed)[1:3]
    assert (select.compare_triplets(a, b), select.compare_triplets(b, a), select.compare_triplets(a, a)) == (-1, 1, 0)
    with pytest.raises(ValueError):
        select.gather_list(changed, most=3)


def test_grids(spark):
    a = sparse(10, 10, 1, False, 3)
    m = select.ProcessGrid(2, 3).place(Matrix.from_numpy(spark, a))
    assert m.df.rdd.getNumPartitions() == 6 and close(m, a)
    halves = select.ProcessGrid(3, 2).split()
    assert [(g.rows, g.cols) for g in halves] == [(2, 2), (1, 2)]
    left, right = select.together(lambda: aggregate.trace(m), lambda: aggregate.frobenius2(m))
    assert abs(left - np.trace(a)) < 1e-9 and abs(right - (a**2).sum()) < 1e-9
    parts = select.split(Matrix.from_numpy(spark, a), [4, 6], [7, 3])
    assert close(select.gather_compose(parts, 3), a)


def test_frobenius_norm_of_complex(spark):
    a = sparse(6, 6, 0.7, True, 4)
    assert abs(aggregate.frobenius2(Matrix.from_numpy(spark, a)) - np.linalg.norm(a) ** 2) < 1e-9
