"""Matrix files: round trips, headers, symmetries."""

import numpy as np
import pytest

from matrelate.matrix import Matrix
from matrelate.sources import binary, matrix_market


def sample(is_complex):
    r = np.random.default_rng(1)
    a = r.random((5, 5)) * (r.random((5, 5)) < 0.6)
    return a + 1j * a.T if is_complex else a


@pytest.mark.parametrize("is_complex", [False, True])
def test_round_trips(spark, tmp_path, is_complex):
    a = sample(is_complex)
    m = Matrix.from_numpy(spark, a)
    matrix_market.write(m, f"{tmp_path}/mm")
    assert np.allclose(matrix_market.read(spark, f"{tmp_path}/mm").to_numpy(), a)
    binary.write_file(m, f"{tmp_path}/m.bin")
    assert np.allclose(binary.read(spark, f"{tmp_path}/m.bin").to_numpy(), a)
    binary.write(m.with_df(m.df.repartition(3)), f"{tmp_path}/m.parts")
    assert np.allclose(binary.read(spark, f"{tmp_path}/m.parts").to_numpy(), a)
    matrix_market.write(m, f"{tmp_path}/array", "array")
    assert np.allclose(matrix_market.read(spark, f"{tmp_path}/array").to_numpy(), a)
    binary.write_parquet(m, f"{tmp_path}/m.parquet")
    assert np.allclose(binary.read_parquet(spark, f"{tmp_path}/m.parquet").to_numpy(), a)


@pytest.mark.parametrize(
    "field, symmetry, lines, expected",
    [
        ("real", "general", ["1 1 2", "2 1 3.5"], [[2, 0], [3.5, 0]]),
        ("real", "symmetric", ["1 1 2", "2 1 3.5"], [[2, 3.5], [3.5, 0]]),
        ("integer", "skew-symmetric", ["2 1 3"], [[0, -3], [3, 0]]),
        ("pattern", "symmetric", ["2 1"], [[0, 1], [1, 0]]),
        ("complex", "hermitian", ["2 1 1 2"], [[0, 1 - 2j], [1 + 2j, 0]]),
        ("integer", "general", ["2 2 2", "2 1 1"], [[0, 0], [1, 2]]),
    ],
)
def test_read(spark, tmp_path, field, symmetry, lines, expected):
    path = tmp_path / "x.mtx"
    path.write_text("\n".join([f"%%MatrixMarket matrix coordinate {field} {symmetry}", "% a comment", "", f"2 2 {len(lines)}", *lines, ""]))
    assert np.allclose(matrix_market.read(spark, str(path)).to_numpy(), np.array(expected))


def test_bad_headers(spark, tmp_path):
    for line in ("%%MatrixMarket matrix sparse real general", "%%MatrixMarket matrix coordinate quaternion general", "%%Market"):
        with pytest.raises(ValueError):
            matrix_market.parse_header(line)
    path = tmp_path / "wide.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n2 3 1\n1 1 1.0\n")
    with pytest.raises(ValueError):
        matrix_market.read(spark, str(path))
    assert matrix_market.read(spark, str(path), square=False).cols == 3


def test_print(spark):
    text = matrix_market.print_matrix(Matrix.from_numpy(spark, np.array([[0, 1.5], [2, 0]])))
    assert text.splitlines() == ["%%MatrixMarket matrix coordinate real general", "%", "2 2 2", "2 1 2.0", "1 2 1.5"]


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
def test_array_files(spark, tmp_path, symmetry):
    """Dense files list values column by column; of symmetric ones the lower half."""
    n = 7
    a = np.arange(1.0, n * n + 1).reshape(n, n)
    if symmetry != "general":
        low = np.tril(a, -1)
        a = low + low.T + np.diag(np.diag(a)) if symmetry == "symmetric" else low - low.T
    values = [a[i, j] for j in range(n) for i in range(0 if symmetry == "general" else j + (symmetry != "symmetric"), n)]
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix array real {symmetry}\n% words\n{n} {n}\n" + "\n".join(map(str, values)) + "\n")
    assert np.allclose(matrix_market.read(spark, str(tmp_path / "m.mtx")).to_numpy(), a)


def test_array_over_many_splits(spark, tmp_path):
    r = np.random.default_rng(3)
    a = r.integers(1, 10**9, (60, 60)).astype(float)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix array real general\n60 60\n" + "\n".join(f"{x:.0f}" for x in a.T.ravel()) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        m = matrix_market.read(spark, str(tmp_path / "m.mtx"))
        assert np.array_equal(m.to_numpy(), a)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["coordinate real general\n2 2 3\n1 1 5\n", "array real general\n2 2\n1\n2\n3\n", "array pattern general\n1 1\n1\n", "sparse real general\n1 1 0\n"])
def test_wrong_files(spark, tmp_path, text):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix " + text)
    with pytest.raises(ValueError):
        matrix_market.read(spark, str(tmp_path / "m.mtx"))
